"""Column roles: which columns are numeric, ignored, the label and the row key.

A column that is neither ignored nor numeric is categorical. Ignore is tested first, so a
name listed in both lists is ignored.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Roles:
    numeric: tuple[str, ...]
    ignore: tuple[str, ...]
    target: str | None = "isDefault"
    key: str = "loan_id"
    extra: dict = field(default_factory=dict, compare=False)

    def kind(self, col: str) -> str:
        if col in self.ignore:
            return "ignore"
        if col in self.numeric:
            return "numeric"
        return "categorical"

    def used(self, columns: list[str]) -> list[str]:
        """Feature columns in schema order (never set order)."""
        return [c for c in columns if self.kind(c) != "ignore"]

    def categorical(self, columns: list[str]) -> list[str]:
        return [c for c in columns if self.kind(c) == "categorical"]

    def numeric_in(self, columns: list[str]) -> list[str]:
        return [c for c in columns if self.kind(c) == "numeric"]

    def validate(self, columns: list[str]) -> list[str]:
        """Warn about role names that match no column (a misspelt ignore entry would
        silently turn the real column into a categorical feature)."""
        missing = [c for c in (*self.numeric, *self.ignore) if c not in columns]
        if missing:
            warnings.warn(f"role names not in the schema: {missing}", stacklevel=2)
        return missing

    def with_(self, **kw) -> "Roles":
        return replace(self, **kw)


# The column roles of the loan tables the reference was written for.
LOAN_NUMERIC = (
    "total_loan", "year_of_loan", "interest", "monthly_payment", "f0", "f1", "f2", "f3", "f4",
    "early_return_amount", "early_return_amount_3mon", "debt_loan_ratio", "del_in_18month",
    "scoring_low", "scoring_high", "pub_dero_bankrup", "recircle_b", "recircle_u", "title",
    "issue_date_y", "issue_date_m", "issue_date_diff", "use", "post_code",
)
LOAN_IGNORE = (
    "loan_id", "user_id", "earlies_credit_mon", "isDefault", "policy_code", "f1", "title",
    "knowing_outstanding_loan", "known_dero",
)
LOAN_TARGET = "isDefault"

LOAN_ROLES = Roles(numeric=LOAN_NUMERIC, ignore=LOAN_IGNORE, target=LOAN_TARGET, key="loan_id")

# Roles of the loan-shaped fixture built from the provided tables (sources.fixtures).
APP_ROLES = Roles(
    numeric=("total_loan", "f0", "f1", "f2", "issue_date_y", "issue_date_m", "issue_date_diff"),
    ignore=("loan_id", "user_id", "slice", "isDefault", "f1"),
    target="isDefault",
    key="loan_id",
)
