"""Secret scans: patterned credentials plus sliding-window entropy of candidate strings.

Everything is a built-in column expression, so a scan is one narrow pass over the texts.

* Patterned kinds (``assign``, ``access``, ``hex``): leftmost non-overlapping matches.
* Entropy kinds (``ent_b64``, ``ent_hex``): a candidate is a maximal run of the class's
  characters, at least one window long. The window's symbol counts and its sum of
  ``c * log2(c)`` (in integer millionths) are updated by the symbol that enters and the one
  that leaves. A span runs from the first window whose entropy reaches the class's limit to
  the last. The allow-list (plain words, numbers, placeholders) suppresses candidates, and
  spans that lie inside a patterned one are not repeated.

Defined results: null text scans as the empty text; an empty text has no span; ids may be null
or repeated (each row is scanned by itself); other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column

# The patterned kinds, in the order in which equal starts are listed.
ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
          r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_ASSIGNED = 12

KINDS = ("assign", "access", "hex", "ent_b64", "ent_hex")

# Entropy classes: alphabet, candidate pattern, window and lowest entropy in bits per symbol.
WINDOW = 20
CLASSES = {
    "ent_b64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-",
                r"[A-Za-z0-9+/_-]{%d,}" % WINDOW, 3.65),
    "ent_hex": ("0123456789abcdefABCDEF", r"[0-9a-fA-F]{%d,}" % WINDOW, 3.0),
}
# Allow-list: words joined by - _ / or +, and plain numbers.
ALLOWED = r"^[0-9]+$|^([A-Z]?[a-z]+|[A-Z]+)([-_/+]+([A-Z]?[a-z]+|[A-Z]+))*$"
# Placeholders, in either case: no window holds a part of one.
PLACEHOLDERS = ("placeholder", "changeme", "example", "xxxxxx")

SPAN = "struct<start:int,rank:int,end:int>"
SPANS = f"array<{SPAN}>"
BLOCK = 256


def clog2(window: int = WINDOW) -> list[int]:
    """round(1e6 * c * log2 c) for c = 0..window + 1 (one symbol enters before one leaves)."""
    return [0] + [round(1e6 * c * math.log2(c)) for c in range(1, window + 2)]


def sum_limit(bits: float, window: int = WINDOW) -> int:
    """Entropy >= bits means: the window's sum of c log2 c is at most this (in millionths)."""
    return math.floor(1e6 * window * (math.log2(window) - bits))


def _running(lengths: Column) -> Column:
    """Exclusive running sums of an array of int, block by block so that long arrays stay cheap."""
    def scan(arr, first):
        return F.aggregate(
            arr, F.struct(first.cast("int").alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, x: F.struct((acc["at"] + x).cast("int").alias("at"),
                                    F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")),
                         lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: (s + x).cast("int")))
    return F.flatten(F.zip_with(blocks, scan(sums, F.lit(0)), lambda b, at: scan(b, at)))


def _located(text: Column, pattern: str) -> tuple[Column, Column]:
    """(matches, starts): the pattern's matches and their first code points.

    The pieces between matches and the matches alternate, so the running sum of their lengths
    gives each start.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found,
                       lambda gap, m: (F.length(gap) + F.length(m)).cast("int"))
    starts = F.zip_with(F.zip_with(_running(steps), steps, lambda at, s: at + s), found,
                        lambda end, m: (end - F.length(m)).cast("int"))
    return found, starts


def _plain_spans(text: Column, kind: str, pattern: str, keep=None) -> Column:
    found, starts = _located(text, pattern)
    rank = KINDS.index(kind)
    spans = F.zip_with(found, starts, lambda m, at: F.struct(
        at.alias("start"), F.lit(rank).alias("rank"), (at + F.length(m)).cast("int").alias("end"),
        (F.lit(True) if keep is None else keep(m)).alias("keep")))
    spans = F.transform(F.filter(spans, lambda s: s["keep"]),
                        lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"),
                                           s["end"].alias("end")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPANS)).cast(SPANS)


def window_run(candidate: Column, kind: str) -> Column:
    """struct(first, last): starts of the first and last windows of the candidate whose entropy
    reaches the limit (-1: none). Counts are kept per symbol and updated one step at a time."""
    alphabet, _, bits = CLASSES[kind]
    table = F.array(*[F.lit(v) for v in clog2()])
    symbols = F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""),
                          lambda c: F.expr("0") + F.instr(F.lit(alphabet), c) - 1)
    # each step: the symbol that enters and the one that leaves (-1 while the window fills)
    steps = F.zip_with(symbols, F.concat(F.array_repeat(F.lit(-1), WINDOW),
                                         F.slice(symbols, F.lit(1), F.size(symbols) - WINDOW)),
                       lambda into, out: F.struct(into.alias("into"), out.alias("out")))
    zero = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0).alias("sum"),
                    F.lit(0).alias("at"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def step(acc, s):
        c_in = F.get(acc["counts"], s["into"])
        c_out = F.get(acc["counts"], s["out"]) + F.when(s["into"] == s["out"], 1).otherwise(0)
        total = (acc["sum"] + F.get(table, c_in + 1) - F.get(table, c_in)
                 + F.coalesce(F.get(table, c_out - 1) - F.get(table, c_out), F.lit(0)))
        counts = F.transform(acc["counts"], lambda c, j: c + F.when(j == s["into"], 1).otherwise(0)
                             - F.when(j == s["out"], 1).otherwise(0))
        hit = (acc["at"] >= WINDOW - 1) & (total <= sum_limit(bits))
        at = acc["at"] - (WINDOW - 1)
        return F.struct(counts.alias("counts"), total.cast("int").alias("sum"), (acc["at"] + 1).alias("at"),
                        F.when(hit & (acc["first"] < 0), at).otherwise(acc["first"]).alias("first"),
                        F.when(hit, at).otherwise(acc["last"]).alias("last"))

    return F.aggregate(steps, zero, step,
                       lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _entropy_spans(text: Column, kind: str) -> Column:
    pattern = CLASSES[kind][1]
    rank = KINDS.index(kind)
    found, starts = _located(text, pattern)
    runs = F.zip_with(found, starts, lambda m, at: F.struct(
        at.alias("at"),
        F.when(~m.rlike(ALLOWED), window_run(m, kind)).alias("run")))
    runs = F.filter(runs, lambda r: F.coalesce(r["run"]["first"], F.lit(-1)) >= 0)
    spans = F.transform(runs, lambda r: F.struct(
        (r["at"] + r["run"]["first"]).alias("start"), F.lit(rank).alias("rank"),
        (r["at"] + r["run"]["last"] + WINDOW).alias("end")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPANS)).cast(SPANS)


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" for c in word)


def blanked(text: Column) -> Column:
    """The text with a blank for every character of a placeholder, so that positions stay."""
    clean = text
    for word in PLACEHOLDERS:
        clean = F.regexp_replace(clean, any_case(word), " " * len(word))
    return F.when(text.rlike("|".join(map(any_case, PLACEHOLDERS))), clean).otherwise(text)


def base_spans(text: Column) -> Column:
    assign = _plain_spans(text, "assign", ASSIGN,
                          lambda m: F.length(F.regexp_extract(m, f"^{ASSIGN}$", 2)) >= MIN_ASSIGNED)
    return F.array_sort(F.concat(assign, _plain_spans(text, "access", ACCESS), _plain_spans(text, "hex", HEX)))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, the text, ``base`` and ``spans`` (arrays of start, rank of kind, end;
    sorted). Code points, end exclusive."""
    t = df.select(*[column(k) for k in keep], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    t = t.withColumn("base", base_spans(F.col("_text")))
    t = t.withColumn("_clean", blanked(F.col("_text")))
    t = t.withColumn("_ent", F.concat(*[_entropy_spans(F.col("_clean"), k) for k in CLASSES]))
    extra = F.filter(F.col("_ent"), lambda e: ~F.exists(
        F.col("base"), lambda b: (b["start"] <= e["start"]) & (e["end"] <= b["end"])))
    return t.select(*keep, F.col("_text").alias("scanned_text"), "base",
                    F.array_sort(F.concat(F.col("base"), extra)).alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by ``mark``; overlapping spans become one."""
    state = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
            s["end"].alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(
                F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))))).alias("out"))))
    rest = F.substring(text, state["at"] + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(state["out"], ""), rest)).otherwise(text)


def digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: counts per patterned kind, digest of the patterned spans, all spans."""
    found = scan(df, text, (doc_id,))

    def count(kind):
        return F.size(F.filter(F.col("base"), lambda s: s["rank"] == KINDS.index(kind))).cast("long")

    return found.select(doc_id, *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
                        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))
