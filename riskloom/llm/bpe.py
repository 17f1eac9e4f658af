"""Byte-level BPE encoding and decoding of whole texts with a given vocabulary.

Long texts are cut into overlapping chunks that are rows of their own, so that many tasks
pre-tokenise one text. Every chunk finds its pre-token starts. Two neighbours are stitched at the
first start inside their overlap that both have: from a common start on, pre-tokenisation does
not depend on what came before. Where an overlap has none (a pre-token longer than the overlap),
the left chunk's last sure pre-token is scanned on into the right chunk until both agree. The
segments between stitches are then encoded on their own, and their ids concatenated. A text of
one chunk is one segment. Decoding concatenates the raw bytes of the ids.

Defined results: null text is the empty text (no ids); ids of documents may be null or repeated
(every row is encoded); strings of special tokens are ordinary text; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

CHUNK = 32_768  # code points that a chunk owns
OVERLAP = 1_024  # code points that it shares with the next one
PIECES = 64  # chunks of one text in a batch
COPIES = 4_096  # equal rows that are written from one list
REACH = 3  # longest literal alternative of the pre-tokeniser's pattern ('ll, 're, 've)

_codecs: dict[str, Codec] = {}


class Codec:
    """Ranks, pattern, and what is built from them once per Python worker."""

    def __init__(self, ranks_file: bytes, pattern: str):
        import regex
        import tiktoken
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}

    def starts(self, text: str, offset: int = 0, more: bool = False, begin: int = 0, end: int | None = None) -> list[int]:
        """Starts of the pre-tokens of text[begin:end]. ``more``: text follows, so a pre-token whose
        match could have looked past the end is the last one whose start is sure."""
        end = len(text) if end is None else end
        found = []
        for m in self.pattern.finditer(text, begin, end):
            found.append(m.start() + offset)
            if more and max(m.end() + 1, m.start() + REACH) > end:
                break
        return found

    def encode(self, segment: str) -> list[int]:
        return self.encoding.encode_ordinary(segment)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Vocabulary:
    """The rank file's bytes and the pattern; goes to the tasks as it is (about a megabyte)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.data = f.read()
        self.pattern = pattern
        self.key = hashlib.sha256(self.data + pattern.encode()).hexdigest()

    def codec(self) -> Codec:
        if self.key not in _codecs:
            _codecs[self.key] = Codec(self.data, self.pattern)
        return _codecs[self.key]


def small(batches, most_bytes: int = 1 << 20):
    """The batches' rows in slices of about a megabyte: ids and starts as Python lists take many
    times the text's memory."""
    for batch in batches:
        step = max(1, batch.num_rows * most_bytes // max(1, batch.nbytes))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def stitch(codec: Codec, text: str, chunk_starts: list[list[int]], chunk: int = CHUNK,
           overlap: int = OVERLAP) -> list[int]:
    """Sure pre-token starts, one or more per chunk border, that cut the text into segments.

    ``chunk_starts[k]``: starts that chunk k found (positions in the whole text), of which only
    those from its stitch on are sure.
    """
    cuts = [0]
    sure = chunk_starts[0]
    for k in range(1, len(chunk_starts)):
        border, theirs = k * chunk, chunk_starts[k]
        # a segment must not end in white space: how its last run splits depends on what follows
        fits = [p for p in theirs if not text[p - 1].isspace()]
        known = set(fits)
        at = next((p for p in sure if p >= border and p in known), None)
        if at is None:
            # no common start in the overlap: go on from the last sure start through chunk k
            end = min(len(text), (k + 1) * chunk + overlap)
            begin = sure[-1]
            further = codec.starts(text, 0, end < len(text), begin, end)
            at = next((p for p in further if p > begin and p >= border and p in known), None)
            if at is None:
                sure = further
                continue
        cuts.append(at)
        sure = [p for p in theirs if p >= at]
    return cuts


def _segments(codec: Codec, text: str, cuts: list[int]) -> list[int]:
    ids: list[int] = []
    for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True):
        ids += codec.encode(text[a:b])
    return ids


def encode(df: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text",
           chunk: int = CHUNK, overlap: int = OVERLAP, finish=None, finished: str = "ids array<int>") -> DataFrame:
    """doc_id and ``ids`` of every row. ``finish(codec, ids) -> tuple`` (with the DDL of its columns
    in ``finished``) derives other columns from the ids inside the same task."""
    spark: SparkSession = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    docs = df.select(F.col(doc_id), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    id_type = dict(docs.dtypes)[doc_id]
    names = [c.split()[0] for c in finished.split(", ")]
    finish = finish or (lambda codec, ids: (np.array(ids, np.int32),))

    def rows(ids_column, results, schema):
        return pa.RecordBatch.from_arrays(
            [ids_column, *[pa.array(list(v), schema.field(i + 1).type)
                           for i, v in enumerate(zip(*results, strict=True))]], schema=schema)

    def whole(batches):
        codec = shared.value.codec()
        for batch in small(batches):
            out = [finish(codec, codec.encode(t)) for t in batch.column(1).to_pylist()]
            yield rows(batch.column(0), out, pa.schema([pa.field(doc_id, batch.schema.field(0).type), *types]))

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    types = list(to_arrow_schema(StructType.fromDDL(finished)))
    schema = f"`{doc_id}` {id_type}, {finished}"
    short = docs.where(F.length("_text") <= chunk).mapInArrow(whole, schema)

    long = docs.where(F.length("_text") > chunk).withColumn("_key", F.xxhash64(F.col(doc_id), F.col("_text")))
    piece_schema = f"`{doc_id}` {id_type}, _key bigint, _n int, _k int, _piece string"

    def cut(batches):
        """A row per chunk with its overlap; every text is walked through once."""
        for batch in small(batches):
            ids, keys = batch.column(0), batch.column(2).to_pylist()
            for i, body in enumerate(batch.column(1).to_pylist()):
                for first in range(0, len(body), PIECES * chunk):
                    at = range(first, min(len(body), first + PIECES * chunk), chunk)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([i] * len(at))), pa.array([keys[i]] * len(at)), pa.array([len(body)] * len(at), pa.int32()),
                         pa.array([a // chunk for a in at], pa.int32()), pa.array([body[a:a + chunk + overlap] for a in at])],
                        names=[doc_id, "_key", "_n", "_k", "_piece"])

    # equal rows become one, with their number, before anything is shuffled
    pieces = (long.select(doc_id, "_text", "_key").mapInArrow(cut, piece_schema)
              .groupBy(doc_id, "_key", "_n", "_k").agg(F.first("_piece").alias("_piece"), F.count(F.lit(1)).alias("_times")))

    def pre_tokenise(batches):
        codec = shared.value.codec()
        for batch in small(batches):
            n, k, piece = (batch.column(i).to_pylist() for i in (2, 3, 4))
            starts = [np.array(codec.starts(t, i * chunk, i * chunk + len(t) < size), np.int32)
                      for size, i, t in zip(n, k, piece, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.list_(pa.int32()))],
                                             names=[*batch.schema.names, "_starts"])

    marked = pieces.mapInArrow(pre_tokenise, f"{piece_schema}, _times bigint, _starts array<int>")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        codec = shared.value.codec()
        pdf = pdf.sort_values("_k")
        body = "".join(p[:chunk] for p in pdf["_piece"])
        cuts = stitch(codec, body, [list(s) for s in pdf["_starts"]], chunk, overlap)
        result = finish(codec, _segments(codec, body, cuts))
        return pd.DataFrame([(pdf[doc_id].iloc[0], *result, pdf["_times"].iloc[0])], columns=[doc_id, *names, "_times"])

    # every equal row again, a few thousand at a time
    joined = marked.groupBy(doc_id, "_key", "_n").applyInPandas(join, f"{schema}, _times bigint")
    joined = joined.withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"), F.lit(COPIES).cast("long"))))
    joined = joined.withColumn("_copy", F.explode(F.sequence("_from", F.least("_times", F.col("_from") + COPIES - 1))))
    return short.unionByName(joined.select(doc_id, *names))


def decode(df: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and ``data``: the raw bytes of every row's ids (null ids: no bytes)."""
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches):
        codec = shared.value.codec()
        for batch in small(batches):
            data = [codec.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=[doc_id, "data"])

    rows = df.select(F.col(doc_id), F.col(ids))
    return rows.mapInArrow(run, f"`{doc_id}` {dict(rows.dtypes)[doc_id]}, data binary")


def digest_of(codec: Codec, ids: list[int]) -> tuple[int, str, str]:
    printed = ",".join(map(str, ids)).encode()
    return len(ids), hashlib.sha256(printed).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()


def digest(df: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """n_tokens, and digests of the ids and of the decoded bytes, of every row."""
    return encode(df, vocabulary, doc_id, text, finish=digest_of,
                  finished="n_tokens bigint, ids_sha256 string, decoded_sha256 string")
