"""Vector code compression: every vector becomes one code per part, found by an exact integer search.

Components are scaled and floored to integers, vectors are cut into equal parts, and every part
position has a codebook that a few rounds of assigning and averaging refine. The nearest entry is
searched in the Walsh-Hadamard domain: parts and entries are padded with zeros to a power of two
and transformed by additions alone. The transform multiplies every squared distance by the padded
length, so scaled squared differences, added up coefficient by coefficient in sequency order
(slowly varying patterns, which hold most of a difference, first), never exceed the scaled
distance. An entry whose sum passes the distance of a first candidate is out. Everything is
integer arithmetic; where 64 bits could overflow, Python's integers take over.

The codebooks (parts x entries x part length numbers, whatever the table's size) are broadcast; a
task returns sums and counts per entry, never rows. No row is grouped by its code or label.

Defined results: rows whose vector is null or holds a null or a non-finite component are dropped;
rows with a null id stay and come last in the order of ids; repeated ids are rows of their own, in
the order of their vectors; with fewer rows than entries the codebooks are smaller; vectors whose
length the parts do not divide, or that are shorter than others, are padded with zeros at the
end; ties go to the lower index; an entry without parts stays as it was; null labels are one label;
scaled components beyond 2**62 count as that bound and errors beyond a long as the largest long;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from decimal import Decimal
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from ..session import ship_package
from .common import staged

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
MOST = float(1 << 62)  # of a scaled component
LONG = (1 << 63) - 1
SLICE = 8_192  # parts that are compared with a codebook at a time


@dataclass(frozen=True)
class Codebooks:
    """``entries[part][entry]``: integer components."""
    entries: np.ndarray  # (parts, entries, length), int64 or Python integers
    scale: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for v in self.entries.ravel()).encode()).hexdigest()


def integer_rows(df: DataFrame, vec_id: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """id, label, values (array of bigint) of the rows that take part."""
    x = F.col(vector)
    fits = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    floor = F.transform(x, lambda c: F.floor(F.least(F.greatest(F.lit(float(scale)) * c.cast("double"), F.lit(-MOST)), F.lit(MOST))).cast("bigint"))
    return df.where(F.coalesce(fits, F.lit(False))).select(F.col(vec_id).alias("id"), F.col(label).alias("label"), floor.alias("values"))


def padded(rows: DataFrame, width: int) -> DataFrame:
    return rows.withColumn("values", F.concat("values", F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size("values"))))


# ---------------------------------------------------------------- the transform and the search
def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the last axis (a power of two), in sequency order."""
    size = x.shape[-1]
    return _butterflies(x)[..., sequency(size)]


def _butterflies(x: np.ndarray) -> np.ndarray:
    size, half = x.shape[-1], 1
    while half < size:
        pairs = x.reshape(*x.shape[:-1], size // (2 * half), 2, half)
        a, b = pairs[..., 0, :], pairs[..., 1, :]
        x = np.stack([a + b, a - b], axis=-2).reshape(*x.shape)
        half *= 2
    return x


@lru_cache
def sequency(size: int) -> np.ndarray:
    """The transform's rows by their number of sign changes."""
    signs = _butterflies(np.eye(size, dtype=np.int64)).T
    return np.argsort((np.diff(signs, axis=1) != 0).sum(axis=1), kind="stable")


def transformed(x: np.ndarray) -> np.ndarray:
    """The last axis padded with zeros to a power of two and transformed."""
    length = x.shape[-1]
    size = 1 << max(0, (length - 1).bit_length()) if length else 1
    filled = np.zeros((*x.shape[:-1], size), x.dtype)
    filled[..., :length] = x
    return transform(filled)


def exact(x: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """``x`` as int64 where no sum of the search can overflow, else as Python integers."""
    most = max((int(abs(int(v))) for a in (x, *others) if a.size for v in (a.min(), a.max())), default=0)
    size = 2 * max(1, x.shape[-1])
    return x.astype(np.int64) if 4 * size ** 3 * most ** 2 <= LONG else x.astype(object)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, scaled squared distance) of the nearest entry of every transformed row of ``x``;
    ties go to the lower index."""
    index, far = np.empty(len(x), np.int64), np.empty(len(x), x.dtype)
    for a in range(0, len(x), SLICE):
        near = x[a:a + SLICE]
        first = (near[:, :1] - entries[:, 0]) ** 2
        guess = entries[first.argmin(axis=1)]
        bound = ((near - guess) ** 2).sum(axis=1)  # the nearest is no farther than this one
        row, entry = np.nonzero(first <= bound[:, None])
        total = first[row, entry]
        for s in range(1, x.shape[1]):
            total = total + (near[row, s] - entries[entry, s]) ** 2
            stay = total <= bound[row]
            row, entry, total = row[stay], entry[stay], total[stay]
        begin = np.searchsorted(row, np.arange(len(near)))
        best = np.minimum.reduceat(total, begin)
        tied = np.flatnonzero(total == best[row])  # entries ascend within a row
        index[a:a + SLICE] = entry[tied[np.searchsorted(row[tied], np.arange(len(near)))]]
        far[a:a + SLICE] = best
    return index, far


def assign(values: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, parts) and squared distances of integer vectors (rows, parts * length)."""
    parts, _, length = entries.shape
    cut = values.reshape(len(values), parts, length)
    x, c = transformed(exact(cut, entries)), transformed(exact(entries, cut))
    codes, far = np.empty((len(values), parts), np.int64), np.empty((len(values), parts), x.dtype)
    for p in range(parts):
        codes[:, p], far[:, p] = nearest(x[:, p], c[p])
    return codes, far // x.shape[-1]  # exact: every scaled distance is a multiple


def _vectors(batch: pa.RecordBatch, column: int, width: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, width)


# ---------------------------------------------------------------- fitting and coding
def refined(rows: DataFrame, entries: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floored mean of the parts that are nearest to it."""
    parts, n_entries, length = entries.shape
    shared = rows.sparkSession.sparkContext.broadcast(entries)

    def run(batches):
        book = shared.value
        count = np.zeros((parts, n_entries), np.int64)
        total = np.zeros((parts, n_entries, length), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _vectors(batch, 0, parts * length)
            codes, _ = assign(values, book)
            cut = exact(values.reshape(len(values), parts, length))
            small = cut.dtype != object and len(cut) * int(np.abs(cut).max(initial=0)) <= LONG
            for p in range(parts):
                count[p] += np.bincount(codes[:, p], minlength=n_entries)
                part = np.zeros((n_entries, length), np.int64 if small else object)
                np.add.at(part, codes[:, p], cut[:, p] if small else cut[:, p].astype(object))
                total[p] += part
        at = np.argwhere(count > 0)
        if len(at):
            p, e = np.repeat(at, length, axis=0).T
            place = np.tile(np.arange(length), len(at))
            sums = [Decimal(int(v)) for v in total[p, e, place]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(place, pa.int32()),
                 pa.array(count[p, e], pa.int64()), pa.array(sums, pa.decimal128(38, 0))], names=["p", "e", "i", "n", "s"])

    sums = rows.select("values").mapInArrow(run, "p int, e int, i int, n bigint, s decimal(38,0)")
    out = entries.astype(object)
    # at most parts x entries x length rows
    for r in sums.groupBy("p", "e", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        out[r["p"], r["e"], r["i"]] = int(r["s"]) // int(r["n"])  # rounds down
    shared.unpersist()
    return exact(out)


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks from ``rows`` (id, values of equal length, a multiple of ``parts``). They start as
    the parts of the rows with the smallest ids."""
    ship_package(rows.sparkSession)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "values").limit(entries).select("values").collect()
    book = np.array([r["values"] for r in first], np.int64).reshape(len(first), parts, -1).swapaxes(0, 1) if first else np.zeros((parts, 0, 0), np.int64)
    for _ in range(rounds if first else 0):
        book = refined(rows, book)
    return Codebooks(book, scale)


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """id, label, code (two hex digits per part), error (squared distance, all parts)."""
    ship_package(rows.sparkSession)
    parts, n_entries, length = books.entries.shape
    if n_entries > 256:
        raise ValueError("a code has two hex digits: 256 entries at most")
    shared = rows.sparkSession.sparkContext.broadcast(books.entries)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, far = assign(_vectors(batch, 2, parts * length), shared.value)
            text = codes.astype(np.uint8).tobytes().hex()
            width = 2 * parts
            error = [min(LONG, int(v)) for v in far.astype(object).sum(axis=1)] if far.dtype == object else far.sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([text[i:i + width] for i in range(0, len(text), width)]),
                 pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.select("id", "label", "values").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint")


def decode(coded: DataFrame, books: Codebooks, code: str = "code", out: str = "vector") -> DataFrame:
    """Add the vectors that the codes stand for, in the scale of the input."""
    parts, n_entries, length = books.entries.shape
    table = F.array(*[F.array(*[F.array(*[F.lit(int(v) / books.scale) for v in e]) for e in part]) for part in books.entries])
    return coded.withColumn(out, F.flatten(F.transform(
        F.sequence(F.lit(0), F.lit(parts - 1)),
        lambda p: F.get(F.get(table, p), F.conv(F.substring(code, 2 * p + 1, F.lit(2)), 16, 10).cast("int")))))


def compress(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """Staged (id, label, code, error) rows, and the codebooks fitted on all rows."""
    rows = staged(integer_rows(df, vec_id, vector, label, scale), "codes-vectors")
    longest = rows.agg(F.max(F.size("values"))).first()[0] or 0
    rows = padded(rows, parts * -(-longest // parts))
    books = fit(rows, parts, entries, rounds, scale)
    return staged(encode(rows, books), "codes-coded"), books


def digest(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    coded, books = compress(df, vec_id, vector, label)
    key = F.to_json(F.struct(F.col("label").alias("l")))  # a null label has a key too
    whole = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("bigint")
    sums = staged(coded.groupBy(key.alias("label_key")).agg(whole.alias("label_error")), "codes-labels")
    out = lookup_join(coded, sums, key, "label_key")
    return out.select(F.col("id").alias(vec_id), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
