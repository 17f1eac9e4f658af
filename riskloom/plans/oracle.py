"""DuckDB oracle SQL for the registered queries (same column names and types).

Every statement reads the pre-registered views of the provided tables. Floats are rounded
to 6 places and integers cast to BIGINT, as ``plans.common.finalize`` does on the Spark side.
"""

from __future__ import annotations

from ..functions.maps import CLASS_MAP, PRIORITY_CLASS_MAP, WORK_YEAR_MAP
from ..sources.fixtures import APP_SQL

SEED = 42
K = 3
R = 6


def _case(col: str, mapping: dict) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items())
    return f"CASE {col} {arms} END"


def _hash(key: str, seed=SEED) -> str:
    return f"md5(CAST({key} AS VARCHAR) || ':{seed}')"


ALIGNED = ("loan_id", "user_id", "slice", "total_loan", "f0", "f1", "f2", "class_raw",
           "employer_type", "industry", "work_year", "issue_date")
_TYPES = {"loan_id": "i", "user_id": "i", "slice": "i", "total_loan": "d", "f0": "d", "f1": "d",
          "f2": "d", "class_raw": "s", "employer_type": "s", "industry": "s", "work_year": "s",
          "issue_date": "t", "isDefault": "i", "is_default": "i"}


def _fin(cols, types=None, prefix="") -> str:
    types = {**_TYPES, **(types or {})}
    out = []
    for c in cols:
        t = types.get(c, "s")
        e = f"{prefix}{c}"
        if t == "i":
            out.append(f"CAST({e} AS BIGINT) AS {c}")
        elif t == "d":
            out.append(f"round(CAST({e} AS DOUBLE), {R}) AS {c}")
        elif t == "t":
            out.append(f"CAST({e} AS VARCHAR) AS {c}")
        else:
            out.append(f"{e} AS {c}")
    return ", ".join(out)


# ------------------------------------------------------------------ shared CTEs
SCORED = """scored AS (
  SELECT event_id, user_id, value / 500.0 AS p,
         CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y FROM events)"""

FOLDED_EVENTS = SCORED + f""",
folded AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY y ORDER BY {_hash('event_id')}, event_id) - 1)
                 % {K} AS INTEGER) AS fold FROM scored)"""

DICTS = """dict_employer_type AS (
  SELECT employer_type AS value, count(*) AS cnt, min(loan_id) AS first_seen,
         row_number() OVER (ORDER BY count(*) DESC, min(loan_id)) - 1 AS code
  FROM app WHERE slice = 0 AND employer_type IS NOT NULL GROUP BY employer_type),
dict_industry AS (
  SELECT industry AS value, count(*) AS cnt, min(loan_id) AS first_seen,
         row_number() OVER (ORDER BY count(*) DESC, min(loan_id)) - 1 AS code
  FROM app WHERE slice = 0 AND industry IS NOT NULL GROUP BY industry)"""


def _encoded(name: str, slice_: int, fill: str, labelled: bool) -> str:
    label = "a.is_default AS isDefault," if labelled else ""
    return f"""{name} AS (
  SELECT a.loan_id, a.user_id, a.slice, a.total_loan, a.f0, a.f1, a.f2,
         {_case('a.class_raw', PRIORITY_CLASS_MAP)} AS class_raw,
         de.code AS employer_type, di.code AS industry,
         {_case(f"coalesce(a.work_year, '{fill}')", WORK_YEAR_MAP)} AS work_year,
         {label}
         year(a.issue_date) AS issue_date_y, month(a.issue_date) AS issue_date_m,
         CAST(a.issue_date AS DATE) - DATE '2007-06-01' AS issue_date_diff
  FROM app a LEFT JOIN dict_employer_type de ON a.employer_type = de.value
             LEFT JOIN dict_industry di ON a.industry = di.value
  WHERE a.slice = {slice_})"""


TRAIN_COLS = ("loan_id", "user_id", "slice", "total_loan", "f0", "f1", "f2", "class_raw",
              "employer_type", "industry", "work_year", "isDefault", "issue_date_y",
              "issue_date_m", "issue_date_diff")
TEST_COLS = tuple(c for c in TRAIN_COLS if c != "isDefault")
NUMERIC = ("total_loan", "f0", "f1", "f2", "issue_date_y", "issue_date_m", "issue_date_diff")
PREP_TYPES = {"class_raw": "i", "employer_type": "i", "industry": "i", "work_year": "i",
              "issue_date_y": "i", "issue_date_m": "i", "issue_date_diff": "i"}
SCALED_TYPES = {**PREP_TYPES, **{c: "d" for c in NUMERIC}}


def _bfill(name: str, src: str, cols, key="loan_id", partition="") -> str:
    part = f"PARTITION BY {partition} " if partition else ""
    sel = ", ".join(c if c in (key, partition) else f"first_value({c} IGNORE NULLS) OVER w AS {c}"
                    for c in cols)
    return f"""{name} AS (
  SELECT {sel} FROM {src}
  WINDOW w AS ({part}ORDER BY {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def _scaled(name: str, src: str, cols, numeric) -> str:
    sel = ", ".join(
        f"({c} - min({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0) AS {c}" if c in numeric
        else c for c in cols)
    return f"{name} AS (SELECT {sel} FROM {src})"


PREPARED = ",\n".join([
    APP_SQL, DICTS,
    _encoded("enc_train", 1, "10+ years", True),
    _encoded("enc_test", 2, "work_year", False),
    _bfill("raw", "enc_train", TRAIN_COLS),
    _bfill("test_clean", "enc_test", TEST_COLS),
    _scaled("scaled", "raw", TRAIN_COLS, NUMERIC),
    f"""balanced AS (
  SELECT * FROM scaled WHERE isDefault = 1
  UNION ALL
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (ORDER BY {_hash('loan_id')}, loan_id) AS rn
    FROM scaled WHERE isDefault = 0)
  WHERE rn <= (SELECT count(*) FROM scaled WHERE isDefault = 1))""",
])

STRAT_APP = f"""folds AS (
  SELECT loan_id, is_default,
         CAST((row_number() OVER (PARTITION BY is_default ORDER BY {_hash('loan_id')}, loan_id) - 1)
              % {K} AS INTEGER) AS fold FROM app)"""

_AUC_FROM = """auc_t AS (
  SELECT {by} p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM {src} GROUP BY {by} p),
auc_r AS (
  SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         AS below FROM auc_t)"""


def _auc(src: str, by: str = "") -> str:
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return _AUC_FROM.format(by=b, src=src, part=part)


SQL: dict[str, str] = {}

SQL["app_fixture"] = f"WITH {APP_SQL} SELECT {_fin(ALIGNED + ('is_default',))} FROM app"

SQL["align_common_columns"] = f"""WITH {APP_SQL}
SELECT 'bank' AS source, {_fin(ALIGNED)}, CAST(is_default AS BIGINT) AS isDefault FROM app WHERE slice = 0
UNION ALL
SELECT 'internet' AS source, {_fin(ALIGNED)}, CAST(is_default AS BIGINT) AS isDefault FROM app WHERE slice = 1"""

SQL["project_unlabelled"] = f"WITH {APP_SQL} SELECT {_fin(ALIGNED)} FROM app WHERE slice = 2"

SQL["filter_label"] = f"""WITH {APP_SQL}
SELECT CAST(loan_id AS BIGINT) AS loan_id, round(total_loan, {R}) AS total_loan,
       CAST(is_default AS BIGINT) AS isDefault FROM app WHERE slice = 1 AND is_default = 1"""

SQL["parse_date"] = "SELECT event_id, epoch_us(ts) AS ts_micros FROM events"

SQL["date_features"] = f"""WITH {APP_SQL}
SELECT loan_id, year(issue_date) AS issue_date_y, month(issue_date) AS issue_date_m,
       CAST(CAST(issue_date AS DATE) - DATE '2007-06-01' AS BIGINT) AS issue_date_diff, 'app' AS src FROM app
UNION ALL
SELECT event_id, year(ts), month(ts), CAST(CAST(ts AS DATE) - DATE '2007-06-01' AS BIGINT), 'events' FROM events"""

SQL["fill_constant"] = f"""WITH {APP_SQL}
SELECT loan_id, coalesce(work_year, '10+ years') AS work_year FROM app"""

SQL["map_literal"] = f"""WITH {APP_SQL}
SELECT loan_id,
       CAST({_case("coalesce(work_year, '10+ years')", WORK_YEAR_MAP)} AS BIGINT) AS work_year,
       CAST({_case('class_raw', PRIORITY_CLASS_MAP)} AS BIGINT) AS class_code FROM app"""

SQL["map_class_letters"] = f"""SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag,
       CAST({_case('l_returnflag', CLASS_MAP)} AS BIGINT) AS class_code FROM lineitem"""

SQL["categorical_codes"] = f"""WITH {APP_SQL},
codes AS (SELECT industry, row_number() OVER (ORDER BY industry) - 1 AS code
          FROM (SELECT DISTINCT industry FROM app WHERE industry IS NOT NULL))
SELECT loan_id, CAST(coalesce(code, -1) AS BIGINT) AS code FROM app LEFT JOIN codes USING (industry)"""

SQL["freq_dictionary"] = f"""WITH {APP_SQL}, {DICTS}
SELECT 'industry' AS field, value, CAST(code AS BIGINT) AS code, cnt, first_seen FROM dict_industry
UNION ALL
SELECT 'employer_type', value, CAST(code AS BIGINT), cnt, first_seen FROM dict_employer_type"""

SQL["apply_dictionary"] = f"""WITH {APP_SQL}, {DICTS}
SELECT a.loan_id, CAST(d.code AS BIGINT) AS industry
FROM app a LEFT JOIN dict_industry d ON a.industry = d.value WHERE a.slice = 1"""

SQL["distinct_first_seen"] = f"""WITH {APP_SQL}
SELECT value, first_seen, row_number() OVER (ORDER BY first_seen) - 1 AS position FROM (
  SELECT employer_type AS value, min(loan_id) AS first_seen FROM app
  WHERE employer_type IS NOT NULL GROUP BY employer_type)"""

_BF_COLS = ("loan_id", "f0", "f2", "class_raw", "work_year")
SQL["backfill_global"] = f"""WITH {APP_SQL}, {_bfill('bf', 'app', _BF_COLS)}
SELECT {_fin(_BF_COLS)} FROM bf"""

_BFK_COLS = ("loan_id", "user_id", "f0", "f2", "class_raw", "work_year")
SQL["backfill_by_key"] = f"""WITH {APP_SQL}, {_bfill('bf', 'app', _BFK_COLS, partition='user_id')}
SELECT {_fin(_BFK_COLS)} FROM bf"""

SQL["column_stats"] = f"WITH {APP_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column, round(min({c}), {R}) AS min, round(stddev_pop({c}), {R}) AS std_pop, "
    f"count({c}) AS non_null FROM app" for c in ("total_loan", "f0", "f1", "f2"))

_SC = ("loan_id", "total_loan", "f0", "f1", "f2")
SQL["scale_min_std"] = f"""WITH {APP_SQL}, {_scaled('sc', 'app', _SC, _SC[1:])}
SELECT {_fin(_SC)} FROM sc"""

SQL["prepare_train"] = f"WITH {PREPARED} SELECT {_fin(TRAIN_COLS, SCALED_TYPES)} FROM scaled"
SQL["prepare_raw_twin"] = f"WITH {PREPARED} SELECT {_fin(TRAIN_COLS, PREP_TYPES)} FROM raw"
SQL["prepare_test"] = f"WITH {PREPARED} SELECT {_fin(TEST_COLS, PREP_TYPES)} FROM test_clean"
SQL["undersample_balance"] = f"""WITH {PREPARED}
SELECT {_fin(('loan_id', 'isDefault', 'total_loan'), SCALED_TYPES)} FROM balanced"""
SQL["union_classes"] = f"""WITH {PREPARED}
SELECT {_fin(('loan_id', 'isDefault', 'f0', 'industry'), SCALED_TYPES)} FROM balanced"""

SQL["renumber_rows"] = f"""WITH {APP_SQL}
SELECT loan_id, row_number() OVER (ORDER BY loan_id) - 1 AS "index" FROM app WHERE slice = 1"""

SQL["stratified_kfold"] = f"""WITH {APP_SQL}, {STRAT_APP}
SELECT loan_id, CAST(is_default AS BIGINT) AS is_default, CAST(fold AS BIGINT) AS fold FROM folds"""

SQL["plain_kfold"] = f"""WITH {APP_SQL}
SELECT loan_id, (row_number() OVER (ORDER BY {_hash('loan_id')}, loan_id) - 1) % {K} AS fold FROM app"""

SQL["expand_folds"] = f"""WITH {APP_SQL}, {STRAT_APP}
SELECT loan_id, CAST(s.split AS BIGINT) AS split, CASE WHEN fold = s.split THEN 'valid' ELSE 'train' END AS role
FROM folds JOIN (SELECT range AS split FROM range(0, {K})) s ON TRUE"""

SQL["take_fold"] = f"""WITH {APP_SQL}, {STRAT_APP}
SELECT loan_id, CAST(is_default AS BIGINT) AS is_default FROM folds WHERE fold <> 0"""

SQL["shuffle_rows"] = f"""WITH {APP_SQL}
SELECT loan_id, row_number() OVER (ORDER BY {_hash('loan_id')}, loan_id) - 1 AS position FROM app"""

SQL["batch_rows"] = f"""WITH {APP_SQL},
pos AS (SELECT loan_id, row_number() OVER (ORDER BY {_hash('loan_id')}, loan_id) - 1 AS position FROM app)
SELECT loan_id, CAST(floor(position / 32) AS BIGINT) AS batch_id FROM pos
WHERE position < (SELECT (count(*) // 32) * 32 FROM app)"""

SQL["class_counts"] = f"WITH {APP_SQL} SELECT CAST(is_default AS BIGINT) AS is_default, count(*) AS n FROM app GROUP BY 1"
SQL["value_counts"] = f"WITH {APP_SQL} SELECT industry, count(*) AS n FROM app GROUP BY 1"

SQL["auc_exact"] = f"""WITH {SCORED}, {_auc('scored')}
SELECT round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), {R}) AS auc FROM auc_r"""

SQL["auc_exact_by_fold"] = f"""WITH {FOLDED_EVENTS}, {_auc('folded', 'fold')}
SELECT CAST(fold AS BIGINT) AS fold, round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), {R}) AS auc
FROM auc_r GROUP BY fold"""

SQL["auc_thresholded"] = f"""WITH {SCORED},
b AS (SELECT least(greatest(1, CAST(ceil(round(p * 199, 9)) AS INTEGER)), 200) AS b,
             sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM scored GROUP BY 1),
tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM b),
grid AS (SELECT range AS j FROM range(0, 200)),
cnt AS (SELECT j, coalesce(sum(pos), 0) AS tp, coalesce(sum(neg), 0) AS fp
        FROM grid LEFT JOIN b ON b.b > grid.j GROUP BY j),
rates AS (SELECT j, tp / (SELECT P FROM tot) AS tpr, fp / (SELECT N FROM tot) AS fpr FROM cnt),
seg AS (SELECT tpr, fpr, lead(tpr) OVER (ORDER BY j) AS tpr2, lead(fpr) OVER (ORDER BY j) AS fpr2 FROM rates)
SELECT round(sum((fpr - fpr2) * (tpr + tpr2) / 2.0), {R}) AS auc FROM seg WHERE tpr2 IS NOT NULL"""

SQL["log_loss"] = f"""WITH {APP_SQL}
SELECT round(avg(-is_default * ln(total_loan / 500000.0 + 1e-7)
                 - (1 - is_default) * ln(1 - total_loan / 500000.0 + 1e-7)), {R}) AS log_loss FROM app"""

_P_LAB = "((doc_id * 37) % 100 + 0.5) / 100.0"
SQL["two_head_loss"] = f"""WITH l AS (SELECT quality, toxic, {_P_LAB} AS p FROM labels),
m AS (SELECT avg(-quality * ln(p + 1e-7) - (1 - quality) * ln(1 - p + 1e-7)) AS loss1,
             avg(-toxic * ln(p + 1e-7) - (1 - toxic) * ln(1 - p + 1e-7)) AS loss2 FROM l)
SELECT round(loss1, {R}) AS loss1, round(loss2, {R}) AS loss2, round(loss1 + loss2, {R}) AS loss FROM m"""

SQL["accuracy_exact"] = f"""WITH {SCORED}
SELECT round(avg(CASE WHEN least(greatest(p * 3 - 1, 0.0), 1.0) = y THEN 1.0 ELSE 0.0 END), {R}) AS accuracy FROM scored"""

SQL["accuracy_at"] = f"""WITH {SCORED}
SELECT round(avg(CASE WHEN (CASE WHEN p > 0.1 THEN 1.0 ELSE 0.0 END) = y THEN 1.0 ELSE 0.0 END), {R})
       AS accuracy FROM scored"""

SQL["cv_summary"] = f"""WITH {FOLDED_EVENTS}, {_auc('folded', 'fold')},
per_fold AS (SELECT fold, sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc FROM auc_r GROUP BY fold),
pooled_t AS (SELECT p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM folded GROUP BY p),
pooled_r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             AS below FROM pooled_t)
SELECT 'value' AS model, round((SELECT avg(auc) FROM per_fold), {R}) AS mean_fold_auc,
       (SELECT count(*) FROM per_fold) AS folds,
       round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), {R}) AS pooled_auc FROM pooled_r"""

SQL["early_stop_epoch"] = f"""WITH h AS (
  SELECT user_id, event_id, value,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS t,
         max(value) OVER (PARTITION BY user_id ORDER BY event_id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best,
         max(value) OVER (PARTITION BY user_id ORDER BY event_id
                          ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS win_max
  FROM events)
SELECT user_id, min(t) AS stop_t, arg_min(event_id, t) AS stop_epoch, round(arg_min(best, t), {R}) AS best
FROM h WHERE t > 15 AND win_max < best GROUP BY user_id"""


def oracle() -> dict[str, str]:
    return dict(SQL)

SQL["fold_profile"] = f"""WITH {PREPARED},
f AS (SELECT *, CAST((row_number() OVER (PARTITION BY isDefault ORDER BY {_hash('loan_id')}, loan_id) - 1)
                     % {K} AS BIGINT) AS fold FROM scaled)
SELECT fold, CAST(isDefault AS BIGINT) AS isDefault, count(*) AS n,
       round(avg(total_loan), {R}) AS mean_scaled_loan FROM f GROUP BY fold, isDefault"""


# ------------------------------------------------------------------ feature dictionary / encoding
def fd_sql(prefix: str, src: str, fields, key: str) -> str:
    """CTEs ``{prefix}_offs`` and ``{prefix}`` (ord, field, kind, value, feature_id)."""
    vals = ", ".join(f"({i}, '{f}', '{k}')" for i, (f, k) in enumerate(fields))
    cats = [f for f, k in fields if k == "categorical"]
    union = " UNION ALL ".join(
        f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value, {key} AS okey FROM {src}" for c in cats)
    return f"""{prefix}_fields(ord, field, kind) AS (VALUES {vals}),
{prefix}_cats AS ({union}),
{prefix}_firsts AS (SELECT field, value, min(okey) AS first_seen FROM {prefix}_cats
                    WHERE value IS NOT NULL GROUP BY field, value),
{prefix}_sizes AS (SELECT f.ord, f.field, f.kind,
                   CASE WHEN f.kind = 'numeric' THEN 1
                        ELSE (SELECT count(*) FROM {prefix}_firsts x WHERE x.field = f.field) END AS size
                   FROM {prefix}_fields f),
{prefix}_offs AS (SELECT *, coalesce(sum(size) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING
                                                      AND 1 PRECEDING), 0) AS off FROM {prefix}_sizes),
{prefix} AS (
  SELECT o.ord, o.field, o.kind, CAST(NULL AS VARCHAR) AS value, o.off AS feature_id
  FROM {prefix}_offs o WHERE o.kind = 'numeric'
  UNION ALL
  SELECT o.ord, o.field, o.kind, f.value,
         o.off + row_number() OVER (PARTITION BY f.field ORDER BY f.first_seen) - 1
  FROM {prefix}_firsts f JOIN {prefix}_offs o ON f.field = o.field)"""


def _pick(fd: str, field: str, seed=SEED) -> str:
    return (f"(SELECT CASE WHEN instr('13579bdf', substr(md5('{field}:{seed}'), 1, 1)) > 0 "
            f"THEN max(feature_id) ELSE min(feature_id) END FROM {fd} WHERE field = '{field}')")


def enc_sql(name: str, src: str, fd: str, fields, key: str, label: str | None) -> str:
    """CTE ``name`` (key, xi BIGINT[], xv_sum, label) of ``src`` encoded against ``fd``."""
    xi, xv, joins = [], [], []
    for i, (f, k) in enumerate(fields):
        if k == "numeric":
            xi.append(f"(SELECT feature_id FROM {fd} WHERE field = '{f}')")
            xv.append(f"CAST(CAST(s.{f} AS FLOAT) AS DOUBLE)")
        else:
            joins.append(f"LEFT JOIN (SELECT value AS v{i}, feature_id AS id{i} FROM {fd} "
                         f"WHERE field = '{f}') d{i} ON CAST(s.{f} AS VARCHAR) = d{i}.v{i}")
            xi.append(f"coalesce(d{i}.id{i}, {_pick(fd, f)})")
            xv.append("1.0")
    lab = f", CAST(CAST(s.{label} AS FLOAT) AS DOUBLE) AS label" if label else ""
    return f"""{name} AS (
  SELECT s.{key} AS {key}, [{', '.join(xi)}] AS xi, [{', '.join(xv)}] AS xv,
         ({' + '.join(xv)}) AS xv_sum{lab}
  FROM {src} s {' '.join(joins)})"""


APP_FIELDS = (("total_loan", "numeric"), ("f0", "numeric"), ("f2", "numeric"),
              ("class_raw", "categorical"), ("employer_type", "categorical"),
              ("industry", "categorical"), ("work_year", "categorical"),
              ("issue_date_y", "numeric"), ("issue_date_m", "numeric"), ("issue_date_diff", "numeric"))

ENCODED = ",\n".join([
    PREPARED,
    fd_sql("fd", "scaled", APP_FIELDS, "loan_id"),
    enc_sql("enc", "scaled", "fd", APP_FIELDS, "loan_id", "isDefault"),
    enc_sql("enc_te", "test_clean", "fd", APP_FIELDS, "loan_id", None),
    f"""enc_folds AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY {_hash('loan_id')}, loan_id) - 1)
                 % {K} AS BIGINT) AS fold FROM enc),
expanded AS (
  SELECT e.*, s.split AS fold_id,
         CASE WHEN e.fold = s.split THEN 'valid' ELSE 'train' END AS role
  FROM enc_folds e JOIN (SELECT range AS split FROM range(0, {K})) s ON TRUE)""",
])

SQL["feature_dictionary"] = f"""WITH {ENCODED}
SELECT CAST(ord AS BIGINT) AS ord, field, kind, value, CAST(feature_id AS BIGINT) AS feature_id FROM fd"""

SQL["feature_dims"] = f"""WITH {ENCODED}
SELECT CAST((SELECT sum(size) FROM fd_sizes) AS BIGINT) AS feature_dim,
       (SELECT count(*) FROM fd_sizes) AS field_size, (SELECT count(*) FROM scaled) AS rows_count"""

SQL["encode_xi_xv"] = f"""WITH {ENCODED}
SELECT loan_id, array_to_string(xi, ',') AS xi, round(xv_sum, {R}) AS xv_sum, round(label, {R}) AS label FROM enc"""

SQL["export_folds"] = f"""WITH {ENCODED}
SELECT loan_id, role, CAST(fold_id AS BIGINT) AS fold_id, array_to_string(xi, ',') AS xi,
       round(xv_sum, {R}) AS xv_sum, round(label, {R}) AS label FROM expanded"""

SQL["sink_folds"] = f"""WITH {ENCODED}
SELECT role, CAST(fold_id AS BIGINT) AS fold_id, count(*) AS n, round(sum(label), {R}) AS label_sum,
       round(sum(xv_sum), {R - 2}) AS xv_total, CAST(sum(list_sum(xi)) AS BIGINT) AS xi_total
FROM expanded GROUP BY role, fold_id"""

SQL["scan_fold"] = f"""WITH {ENCODED}
SELECT loan_id, role, CAST(fold_id AS BIGINT) AS fold_id, array_to_string(xi, ',') AS xi, round(label, {R}) AS label
FROM expanded"""

SQL["scan_unlabelled"] = f"""WITH {ENCODED}
SELECT loan_id, array_to_string(xi, ',') AS xi, round(xv_sum, {R}) AS xv_sum FROM enc_te"""

ORDER_FIELDS = (("o_custkey", "categorical"), ("o_totalprice", "numeric"),
                ("o_orderpriority", "categorical"))
SQL["impute_unknown_id"] = "WITH " + ",\n".join([
    "fit AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01')",
    fd_sql("ofd", "fit", ORDER_FIELDS, "o_orderkey"),
    enc_sql("oenc", "orders", "ofd", ORDER_FIELDS, "o_orderkey", None),
]) + f"""
SELECT o_orderkey, array_to_string(xi, ',') AS xi, round(xv_sum, {R}) AS xv_sum FROM oenc"""


# ------------------------------------------------------------------ interaction blocks and scores
def w_dense(l, i, j) -> str:
    return f"(((({i}) * 7 + ({j}) * 13 + {l} * 5) % 29) / 29.0 - 0.5)"


def w_bias(l, j) -> str:
    return f"(((({j}) * 3 + {l}) % 7) / 7.0 - 0.5)"


def w_emb(i, k) -> str:
    return f"(((({i}) * 31 + ({k}) * 17) % 101) / 101.0 - 0.5)"


def w_first(i) -> str:
    return f"(((({i}) * 13 + 7) % 97) / 97.0 - 0.5)"


def w_expert(d, u, x) -> str:
    return f"(((({d}) * 7 + ({u}) * 13 + ({x}) * 5) % 31) / 31.0 - 0.5)"


def w_att_h(t) -> str:
    return f"(((({t}) * 5 + 1) % 7) / 7.0 - 0.5)"


def w_ln(x, k) -> str:
    return f"(({x}) * (0.5 + ((({k}) * 5 + 3) % 11) / 11.0) + (((({k}) * 7 + 2) % 13) / 13.0 - 0.5))"


EMB_LONG = """el AS (
  SELECT vec_id, idx // 16 AS f, idx % 16 AS k, v FROM (
    SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(0, 64)) AS idx FROM embeddings))"""

SQL["fm_second_order"] = f"""WITH {EMB_LONG}
SELECT vec_id, CAST(k AS BIGINT) AS k, round(0.5 * (sum(v) * sum(v) - sum(v * v)), {R}) AS fm2
FROM el GROUP BY vec_id, k"""

SQL["pairwise_interactions"] = f"""WITH {EMB_LONG}
SELECT a.vec_id, CAST(a.f AS BIGINT) AS i, CAST(b.f AS BIGINT) AS j, round(sum(a.v * b.v), {R}) AS dot
FROM el a JOIN el b ON a.vec_id = b.vec_id AND a.k = b.k AND a.f < b.f GROUP BY a.vec_id, a.f, b.f"""

SQL["layer_norm"] = f"""WITH {EMB_LONG}
SELECT vec_id, CAST(f AS BIGINT) AS f, CAST(k AS BIGINT) AS k,
       round({w_ln("(v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-12)", "k")}, {R}) AS v
FROM el WINDOW w AS (PARTITION BY vec_id, f)"""

SQL["attention_pool"] = f"""WITH {EMB_LONG},
pairs AS (SELECT a.vec_id, a.f AS i, b.f AS j, a.k, a.v * b.v AS p
          FROM el a JOIN el b ON a.vec_id = b.vec_id AND a.k = b.k AND a.f < b.f),
hid AS (SELECT p.vec_id, p.i, p.j, t.t,
               greatest(sum(p.p * {w_dense(10, 'p.k', 't.t')}) + {w_bias(10, 't.t')}, 0) AS h
        FROM pairs p CROSS JOIN (SELECT range AS t FROM range(0, 4)) t GROUP BY p.vec_id, p.i, p.j, t.t),
sc AS (SELECT vec_id, i, j, sum(h * {w_att_h('t')}) AS s FROM hid GROUP BY vec_id, i, j),
sc2 AS (SELECT vec_id, i, j, s - max(s) OVER (PARTITION BY vec_id) AS s FROM sc),
att AS (SELECT vec_id, i, j, exp(s) / sum(exp(s)) OVER (PARTITION BY vec_id) AS a FROM sc2)
SELECT p.vec_id, CAST(p.k AS BIGINT) AS k, round(sum(p.p), {R}) AS afm_ref, round(sum(att.a * p.p), {R}) AS afm_paper
FROM pairs p JOIN att USING (vec_id, i, j) GROUP BY p.vec_id, p.k"""

SQL["dense_layer"] = f"""WITH x AS (
  SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, 64)) AS d FROM embeddings)
SELECT vec_id, CAST(u.u AS BIGINT) AS u,
       round(greatest(sum(x * {w_dense(5, 'd', 'u.u')}) + {w_bias(5, 'u.u')}, 0), {R}) AS y
FROM x CROSS JOIN (SELECT range AS u FROM range(0, 4)) u GROUP BY vec_id, u.u"""

SQL["softmax_gate"] = f"""WITH x AS (
  SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, 64)) AS d FROM embeddings),
z AS (SELECT vec_id, e.e, sum(x * {w_dense(31, 'd', 'e.e')}) + {w_bias(31, 'e.e')} AS z
      FROM x CROSS JOIN (SELECT range AS e FROM range(0, 4)) e GROUP BY vec_id, e.e),
z2 AS (SELECT vec_id, e, z - max(z) OVER (PARTITION BY vec_id) AS z FROM z)
SELECT vec_id, CAST(e AS BIGINT) AS expert,
       round(exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id), {R}) AS gate FROM z2"""

# app records in long form: (loan_id, f, fid, xv)
def _rec(src: str) -> str:
    return f"""{ENCODED},
rec AS (SELECT loan_id, unnest(xi) AS fid, unnest(xv) AS xv, unnest(range(0, 10)) AS f FROM {src}),
nn AS (SELECT loan_id, count(xv) AS nn FROM rec GROUP BY loan_id),
e AS (SELECT r.loan_id, r.f, r.fid, kk.k, {w_emb('r.fid', 'kk.k')} AS w, {w_emb('r.fid', 'kk.k')} * r.xv AS v
      FROM rec r CROSS JOIN (SELECT range AS k FROM range(0, 8)) kk)"""


REC = _rec("enc")

SQL["embedding_lookup"] = f"""WITH {REC}
SELECT loan_id, CAST(f AS BIGINT) AS field, CAST(fid AS BIGINT) AS feature_id, CAST(k AS BIGINT) AS k,
       round(w, {R}) AS w FROM e"""

SQL["embedding_scaled"] = f"""WITH {REC}
SELECT loan_id, CAST(f AS BIGINT) AS field, CAST(k AS BIGINT) AS k, round(v, {R}) AS v FROM e"""

SQL["fm_first_order"] = f"""WITH {REC}
SELECT loan_id, round(sum({w_first('fid')} * xv), {R}) AS fm1 FROM rec GROUP BY loan_id
HAVING count(xv) = 10
UNION ALL
SELECT loan_id, NULL FROM rec GROUP BY loan_id HAVING count(xv) < 10"""


def _deepfm_sql(layers=(32, 32), F_=10, K_=8, fm=True, deep=True) -> str:
    ctes = [f"""ln AS (SELECT loan_id, f, k, {w_ln("(v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-12)", "k")} AS v
       FROM e WINDOW w AS (PARTITION BY loan_id, f))""",
            f"y1 AS (SELECT loan_id, f AS i, {w_first('fid')} * xv AS x FROM rec)",
            f"""y2 AS (SELECT loan_id, {F_} + k AS i, 0.5 * (sum(v) * sum(v) - sum(v * v)) AS x
       FROM ln GROUP BY loan_id, k)""",
            f"h0 AS (SELECT loan_id, f * {K_} + k AS d, v AS x FROM ln)"]
    for l, width in enumerate(layers):
        ctes.append(f"""h{l + 1} AS (SELECT h.loan_id, j.j AS d,
         greatest(sum(h.x * {w_dense(l, 'h.d', 'j.j')}) + {w_bias(l, 'j.j')}, 0) AS x
       FROM h{l} h CROSS JOIN (SELECT range AS j FROM range(0, {width})) j GROUP BY h.loan_id, j.j)""")
    last = len(layers)
    parts = ["SELECT loan_id, i, x FROM y1", "SELECT loan_id, i, x FROM y2"] if fm else []
    parts += [f"SELECT loan_id, {F_ + K_ if fm else 0} + d AS i, x FROM h{last}"] if deep else []
    ctes.append(f"cat AS ({' UNION ALL '.join(parts)})")
    ctes.append(f"z AS (SELECT loan_id, sum(x * {w_dense(9, 'i', 0)}) + 0.01 AS z FROM cat GROUP BY loan_id)")
    return ",\n".join(ctes)


SQL["score_deepfm"] = f"""WITH {REC},
{_deepfm_sql()}
SELECT z.loan_id, CASE WHEN nn.nn < 10 THEN NULL ELSE round(1 / (1 + exp(-z)), {R}) END AS score
FROM z JOIN nn USING (loan_id)"""

for _name, _on in (("score_fm_only", {"deep": False}), ("score_deep_only", {"fm": False})):
    SQL[_name] = f"""WITH {REC},
{_deepfm_sql(**_on)}
SELECT z.loan_id, CASE WHEN nn.nn < 10 THEN NULL ELSE round(1 / (1 + exp(-z)), {R}) END AS score
FROM z JOIN nn USING (loan_id)"""

_AFM = f"""y1 AS (SELECT loan_id, sum({w_first('fid')} * xv * {w_dense(20, 'f', 0)}) + {w_bias(20, 0)} AS y
       FROM rec GROUP BY loan_id),
fm2 AS (SELECT loan_id, k, 0.5 * (sum(v) * sum(v) - sum(v * v)) AS x FROM e GROUP BY loan_id, k),
y2 AS (SELECT loan_id, sum(x * {w_dense(21, 'k', 0)}) + {w_bias(21, 0)} AS y FROM fm2 GROUP BY loan_id),
pairs AS (SELECT a.loan_id, a.k, sum(a.v * b.v) AS x
          FROM e a JOIN e b ON a.loan_id = b.loan_id AND a.k = b.k AND a.f < b.f GROUP BY a.loan_id, a.k),
ya AS (SELECT loan_id, sum(x * {w_dense(22, 'k', 0)}) + {w_bias(22, 0)} AS y FROM pairs GROUP BY loan_id)"""

SQL["score_afm"] = f"""WITH {REC},
{_AFM}
SELECT y1.loan_id, CASE WHEN nn.nn < 10 THEN NULL
                   ELSE round(1 / (1 + exp(-(y1.y + y2.y + ya.y))), {R}) END AS score
FROM y1 JOIN y2 USING (loan_id) JOIN ya USING (loan_id) JOIN nn USING (loan_id)"""


def _mmoe_sql(units=16, experts=4, hidden=(2, 4, 2), F_=10, K_=8) -> str:
    ctes = [f"x AS (SELECT loan_id, f * {K_} + k AS d, v AS x FROM e)",
            f"""ex AS (SELECT x.loan_id, g.u, g.x AS ex,
         greatest(sum(x.x * {w_expert('x.d', 'g.u', 'g.x')}) + {w_bias(30, 'g.x')}, 0) AS o
       FROM x CROSS JOIN (SELECT a.range AS u, b.range AS x FROM range(0, {units}) a CROSS JOIN range(0, {experts}) b) g
       GROUP BY x.loan_id, g.u, g.x)"""]
    sizes = [units, *hidden, 1]
    for g in (1, 2):
        ctes.append(f"""gz{g} AS (SELECT x.loan_id, e.e, sum(x.x * {w_dense(30 + g, 'x.d', 'e.e')}) + {w_bias(30 + g, 'e.e')} AS z
       FROM x CROSS JOIN (SELECT range AS e FROM range(0, {experts})) e GROUP BY x.loan_id, e.e)""")
        ctes.append(f"""gs{g} AS (SELECT loan_id, e, z - max(z) OVER (PARTITION BY loan_id) AS z FROM gz{g})""")
        ctes.append(f"""gate{g} AS (SELECT loan_id, e, exp(z) / sum(exp(z)) OVER (PARTITION BY loan_id) AS a
       FROM gs{g})""")
        ctes.append(f"""t{g}_0 AS (SELECT ex.loan_id, ex.u AS d, sum(ex.o * gate{g}.a) AS x
       FROM ex JOIN gate{g} ON ex.loan_id = gate{g}.loan_id AND ex.ex = gate{g}.e GROUP BY ex.loan_id, ex.u)""")
        for l in range(len(sizes) - 1):
            lid = 40 + 10 * g + l
            act = "greatest({}, 0)" if l < len(sizes) - 2 else "{}"
            body = f"sum(h.x * {w_dense(lid, 'h.d', 'j.j')}) + {w_bias(lid, 'j.j')}"
            ctes.append(f"""t{g}_{l + 1} AS (SELECT h.loan_id, j.j AS d, {act.format(body)} AS x
       FROM t{g}_{l} h CROSS JOIN (SELECT range AS j FROM range(0, {sizes[l + 1]})) j GROUP BY h.loan_id, j.j)""")
    return ",\n".join(ctes)


SQL["score_mmoe"] = f"""WITH {REC},
{_mmoe_sql()},
s AS (SELECT a.loan_id, 1 / (1 + exp(-a.x)) AS s1, 1 / (1 + exp(-b.x)) AS s2
      FROM t1_4 a JOIN t2_4 b USING (loan_id))
SELECT s.loan_id, CASE WHEN nn.nn < 10 THEN NULL ELSE round(0.5 * s1 + 0.5 * s2, {R}) END AS score,
       CASE WHEN nn.nn < 10 THEN NULL ELSE round(s1, {R}) END AS score_1,
       CASE WHEN nn.nn < 10 THEN NULL ELSE round(s2, {R}) END AS score_2
FROM s JOIN nn USING (loan_id)"""

SQL["score_batch"] = f"""WITH {_rec('enc_te')},
{_deepfm_sql()}
SELECT z.loan_id, CASE WHEN nn.nn < 10 THEN NULL ELSE round(1 / (1 + exp(-z)), {R}) END AS score
FROM z JOIN nn USING (loan_id)"""


# ------------------------------------------------------------------ round trips, search, assembly
SQL["scan_csv"] = SQL["app_fixture"]

SQL["scan_clean_bundle"] = f"""WITH {PREPARED}
SELECT loan_id, round(total_loan, {R}) AS total_loan, round(f0, {R}) AS f0, CAST(industry AS BIGINT) AS industry, 'scaled' AS role FROM scaled
UNION ALL SELECT loan_id, round(total_loan, {R}), round(f0, {R}), CAST(industry AS BIGINT), 'raw' FROM raw
UNION ALL SELECT loan_id, round(total_loan, {R}), round(f0, {R}), CAST(industry AS BIGINT), 'test' FROM test_clean"""

SQL["metrics_history"] = f"""WITH h AS (
  SELECT user_id AS run, event_id, value AS metric,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS t,
         max(value) OVER (PARTITION BY user_id ORDER BY event_id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best,
         max(value) OVER (PARTITION BY user_id ORDER BY event_id
                          ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS win_max
  FROM events),
st AS (SELECT run, min(t) AS stop_t FROM h WHERE t > 15 AND win_max < best GROUP BY run)
SELECT h.run, t - 1 AS epoch_no, round(metric, {R}) AS metric, round(best, {R}) AS best,
       CAST(CASE WHEN t = st.stop_t THEN 1 ELSE 0 END AS BIGINT) AS is_stop
FROM h LEFT JOIN st USING (run)"""

SQL["model_roundtrip"] = SQL["score_deepfm"]

SQL["apply_columns"] = f"""WITH {APP_SQL}
SELECT loan_id, round(ln(1 + abs(total_loan)), {R}) AS total_loan, round(ln(1 + abs(f0)), {R}) AS f0,
       round(ln(1 + abs(f2)), {R}) AS f2 FROM app"""

SQL["oof_assemble"] = f"""WITH {APP_SQL}, {STRAT_APP.replace('SELECT loan_id, is_default,', 'SELECT loan_id, is_default, industry,')},
st AS (SELECT industry, fold, sum(is_default) AS s, count(*) AS n FROM folds GROUP BY industry, fold),
tot AS (SELECT industry, sum(s) AS s_all, sum(n) AS n_all FROM st GROUP BY industry)
SELECT f.loan_id, CAST(f.fold AS BIGINT) AS fold,
       round(CAST(tot.s_all - st.s AS DOUBLE) / nullif(tot.n_all - st.n, 0), {R}) AS oof
FROM folds f JOIN st ON f.industry = st.industry AND f.fold = st.fold JOIN tot ON f.industry = tot.industry"""


def _u(name: str) -> str:
    return f"('0x' || substr(md5(CAST(trial_id AS VARCHAR) || ':{name}:{SEED}'), 1, 8))::BIGINT / 4294967296.0"


_TRIALS = f"""{SCORED},
params AS (
  SELECT trial_id,
         CAST(1 + floor({_u('threshold_step')} * 99) AS BIGINT) AS threshold_step,
         {0.001!r} + {_u('lr')} * {0.01 - 0.001!r} AS lr,
         CAST(4 + floor({_u('emb_dim')} * 13) AS BIGINT) AS emb_dim,
         {0.3!r} + {_u('dropout_fm_0')} * {0.8 - 0.3!r} AS dropout_fm_0,
         ['adam', 'sgd'][1 + CAST(floor({_u('optimizer')} * 2) AS INTEGER)] AS optimizer
  FROM (SELECT range AS trial_id FROM range(0, 20))),
cells AS (SELECT least(greatest(ceil(round(p * 100, 9)), 0), 100) AS c, y FROM scored),
acc AS (SELECT k.k, avg(CASE WHEN (c > k.k) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy
        FROM (SELECT range AS k FROM range(0, 101)) k CROSS JOIN cells GROUP BY k.k),
trials AS (SELECT p.*, a.accuracy AS objective FROM params p LEFT JOIN acc a ON p.threshold_step = a.k)"""

_TRIAL_COLS = (f"trial_id, threshold_step, round(lr, {R}) AS lr, emb_dim, round(dropout_fm_0, {R}) AS dropout_fm_0, "
               f"optimizer, round(objective, {R}) AS objective")
SQL["sample_trials"] = f"WITH {_TRIALS} SELECT {_TRIAL_COLS} FROM trials"
SQL["best_trial"] = f"""WITH {_TRIALS}
SELECT {_TRIAL_COLS} FROM trials ORDER BY objective DESC, trial_id LIMIT 1"""

SQL["stream_score"] = SQL["score_batch"]

SQL["union_train"] = f"""WITH {APP_SQL}
SELECT loan_id, slice, round(total_loan, {R}) AS total_loan, CAST(is_default AS BIGINT) AS isDefault
FROM app WHERE slice IN (0, 1)"""


# ------------------------------------------------------------------ missing values, text keys
_MISSING = SCORED + """,
part AS (SELECT * FROM scored WHERE event_id % 5 <> 0 AND event_id % 7 <> 0)"""
SQL["auc_with_missing_scores"] = f"""WITH {_MISSING}, {_auc('part')},
b AS (SELECT least(greatest(1, CAST(ceil(round(p * 199, 9)) AS INTEGER)), 200) AS b,
             sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM part GROUP BY 1),
cnt AS (SELECT j, coalesce(sum(pos), 0) AS tp, coalesce(sum(neg), 0) AS fp
        FROM (SELECT range AS j FROM range(0, 200)) g LEFT JOIN b ON b.b > g.j GROUP BY j),
rates AS (SELECT j, tp / (SELECT sum(pos) FROM b) AS tpr, fp / (SELECT sum(neg) FROM b) AS fpr FROM cnt),
seg AS (SELECT tpr, fpr, lead(tpr) OVER (ORDER BY j) AS tpr2, lead(fpr) OVER (ORDER BY j) AS fpr2 FROM rates)
SELECT 'auc_exact' AS name, round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), {R}) AS value FROM auc_r
UNION ALL SELECT 'auc_thresholded', round(sum((fpr - fpr2) * (tpr + tpr2) / 2.0), {R}) FROM seg WHERE tpr2 IS NOT NULL
UNION ALL SELECT 'missing', count(*)::DOUBLE FROM scored WHERE event_id % 5 = 0 OR event_id % 7 = 0"""

_NAN = """gaps AS (SELECT loan_id, CASE WHEN loan_id % 7 = 0 THEN NULL ELSE total_loan END AS total_loan,
  CASE WHEN loan_id % 11 = 0 THEN NULL ELSE f0 END AS f0, f1, f2 FROM app)"""
SQL["scale_with_nan"] = f"""WITH {APP_SQL}, {_NAN}, {_scaled('sc', 'gaps', _SC, _SC[1:])}
SELECT {_fin(_SC)} FROM sc"""
SQL["backfill_with_nan"] = f"""WITH {APP_SQL}, {_NAN}, {_bfill('bf', 'gaps', _SC)}
SELECT {_fin(_SC)} FROM bf"""

SQL["renumber_text_keys"] = """WITH k AS (SELECT l_orderkey || '-' || l_linenumber AS line_key FROM lineitem)
SELECT line_key, row_number() OVER (ORDER BY line_key) - 1 AS "index" FROM k"""

# ------------------------------------------------------------------ one training step, evaluation by head
# training counts a missing value as 0
REC0 = REC.replace("rec AS (SELECT loan_id, unnest(xi) AS fid, unnest(xv) AS xv, unnest(range(0, 10)) AS f FROM enc)",
                   "rec AS (SELECT loan_id, fid, coalesce(xv, 0) AS xv, f FROM (SELECT loan_id, unnest(xi) AS fid, "
                   "unnest(xv) AS xv, unnest(range(0, 10)) AS f FROM enc))")

SQL["gradient_step_deepfm"] = f"""WITH {REC0},
{_deepfm_sql()},
s AS (SELECT z.loan_id, e.label AS y, 1 / (1 + exp(-z)) AS p FROM z JOIN enc e ON e.loan_id = z.loan_id),
d AS (SELECT *, -y * ln(p + 1e-7) - (1 - y) * ln(1 - p + 1e-7) AS l,
             2 * (-y / (p + 1e-7) + (1 - y) / (1 - p + 1e-7)) * p * (1 - p) AS dz FROM s),
g AS (SELECT fid, sum(dz * {w_dense(9, 'f', 0)} * xv) AS v FROM rec JOIN d USING (loan_id) GROUP BY fid)
SELECT 'loss' AS name, -1 AS i, round(2 * sum(l), 4) AS value FROM d
UNION ALL SELECT 'rows', -1, count(*)::DOUBLE FROM d
UNION ALL SELECT 'bout', -1, round(sum(dz), 4) FROM d
UNION ALL SELECT 'w1', i, round(coalesce(v, 0), 4) FROM (SELECT range AS i FROM range(0, (SELECT sum(size) FROM fd_sizes)::BIGINT)) r
LEFT JOIN g ON g.fid = r.i"""

_DZ = """d AS (SELECT *, 2 * (-y / (p + 1e-7) + (1 - y) / (1 - p + 1e-7)) * p * (1 - p) AS dz FROM s)"""
_IDS = "(SELECT range AS i FROM range(0, (SELECT sum(size) FROM fd_sizes)::BIGINT)) r"
SQL["gradient_step_sparse"] = f"""SELECT * FROM (WITH {REC0},
{_AFM},
s AS (SELECT y1.loan_id, en.label AS y, 1 / (1 + exp(-(y1.y + y2.y + ya.y))) AS p
      FROM y1 JOIN y2 USING (loan_id) JOIN ya USING (loan_id) JOIN enc en ON en.loan_id = y1.loan_id),
{_DZ},
sk AS (SELECT loan_id, k, sum(v) AS s FROM e GROUP BY loan_id, k),
g AS (SELECT e.fid, e.k, sum(d.dz * ({w_dense(21, 'e.k', 0)} + {w_dense(22, 'e.k', 0)}) * (sk.s - e.v) * rec.xv) AS g
      FROM e JOIN d USING (loan_id) JOIN sk ON sk.loan_id = e.loan_id AND sk.k = e.k
      JOIN rec ON rec.loan_id = e.loan_id AND rec.f = e.f GROUP BY e.fid, e.k
      UNION ALL SELECT fid, 8, sum(dz * {w_dense(20, 'f', 0)} * xv) FROM rec JOIN d USING (loan_id) GROUP BY fid)
SELECT 'afm' AS model, r.i AS feature_id, kk.k, round(CASE WHEN kk.k < 8 THEN {w_emb('r.i', 'kk.k')} ELSE {w_first('r.i')} END
         - coalesce(g.g, 0) / (SELECT count(*) FROM d), {R}) AS w
FROM {_IDS} CROSS JOIN (SELECT range AS k FROM range(0, 9)) kk LEFT JOIN g ON g.fid = r.i AND g.k = kk.k)
UNION ALL SELECT * FROM (WITH {REC0},
{_deepfm_sql()},
s AS (SELECT z.loan_id, en.label AS y, 1 / (1 + exp(-z)) AS p FROM z JOIN enc en ON en.loan_id = z.loan_id),
{_DZ},
g AS (SELECT fid, sum(dz * {w_dense(9, 'f', 0)} * xv) AS g FROM rec JOIN d USING (loan_id) GROUP BY fid)
SELECT 'deepfm' AS model, r.i AS feature_id, 8 AS k, round({w_first('r.i')} - coalesce(g.g, 0) / (SELECT count(*) FROM d), {R}) AS w
FROM {_IDS} LEFT JOIN g ON g.fid = r.i)"""

_HEAD_AUC = """b{h} AS (SELECT least(greatest(1, CAST(ceil(round(s{h} * 199, 9)) AS INTEGER)), 200) AS b,
             sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM s GROUP BY 1),
c{h} AS (SELECT j, coalesce(sum(pos), 0) AS tp, coalesce(sum(neg), 0) AS fp
        FROM (SELECT range AS j FROM range(0, 200)) g LEFT JOIN b{h} ON b{h}.b > g.j GROUP BY j),
r{h} AS (SELECT j, tp / (SELECT sum(pos) FROM b{h}) AS tpr, fp / (SELECT sum(neg) FROM b{h}) AS fpr FROM c{h}),
q{h} AS (SELECT tpr, fpr, lead(tpr) OVER (ORDER BY j) AS tpr2, lead(fpr) OVER (ORDER BY j) AS fpr2 FROM r{h}),
a{h} AS (SELECT sum((fpr - fpr2) * (tpr + tpr2) / 2.0) AS auc FROM q{h} WHERE tpr2 IS NOT NULL)"""
SQL["mmoe_head_metrics"] = f"""WITH {REC0},
{_mmoe_sql()},
s AS (SELECT a.loan_id, 1 / (1 + exp(-a.x)) AS s1, 1 / (1 + exp(-b.x)) AS s2, e.label AS y
      FROM t1_4 a JOIN t2_4 b USING (loan_id) JOIN enc e ON e.loan_id = a.loan_id),
{_HEAD_AUC.format(h=1)},
{_HEAD_AUC.format(h=2)}
SELECT round(avg(-y * ln(s1 + 1e-7) - (1 - y) * ln(1 - s1 + 1e-7) - y * ln(s2 + 1e-7) - (1 - y) * ln(1 - s2 + 1e-7)), {R}) AS loss,
       round((SELECT auc FROM a1), {R}) AS auc, round((SELECT auc FROM a2), {R}) AS auc_2, count(*) AS n FROM s"""

SQL["oof_predictions_once"] = f"""WITH {PREPARED}
SELECT loan_id, CAST((row_number() OVER (PARTITION BY isDefault ORDER BY {_hash('loan_id')}, loan_id) - 1) % {K} AS BIGINT) AS fold,
       CAST(1 AS BIGINT) AS times, CAST(isDefault AS DOUBLE) AS label, CAST(1 AS BIGINT) AS is_probability FROM scaled"""

SQL["score_deepfm_joined"] = SQL["score_deepfm"]

SQL["saved_scorers"] = f"""WITH {PREPARED}
SELECT kind, CAST((row_number() OVER (PARTITION BY kind, isDefault ORDER BY {_hash('loan_id')}, loan_id) - 1) % {K} AS BIGINT) AS fold,
       loan_id, CAST(1 AS BIGINT) AS times, CAST(1 AS BIGINT) AS same
FROM scaled JOIN (VALUES ('trees'), ('fm'), ('mlp')) AS kinds(kind) ON TRUE"""
