"""LM scoring: marginal likelihood of texts over all segmentations into subword pieces.

The vocabulary (pieces and their scores) exists; a word's lattice has an arc for every piece that
matches, with a word mark before the first byte and single bytes as a fall-back. Its marginal
probability is the sum over all segmentations, by a forward recursion in log space, and a text's
is the product over its words and one end.

1. One pass over the training texts weighs all segmentations of every word with the vocabulary's
   scores (forward and backward) and adds up expected counts of pieces. They come to the driver as
   one number per piece and become the model's probabilities.
2. One pass over all texts scores them (the model is broadcast: its size is the vocabulary's), and
   writes, per block of texts, the block's distinct words with their training counts, and its
   postings (text and times per word). That table is staged, and its row numbers are what the next
   steps join on.
3. The training counts are summed by word, one row per block and word, and looked up for every
   block's words. A word that is in every text is one row per block in both steps.
4. Every block meets its words' counts, which give its texts' base scores. A task holds one block,
   whatever the table's size.

Defined results: null text is the empty text (one end token); ids may be null (learned from as the
empty text is by its crc32) or repeated; an empty table gives no rows; without training texts the
vocabulary's own scores are the model; other columns are ignored.
"""

from __future__ import annotations

import copy
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from ..session import ship_package
from .common import crc_of_id, staged
from .textnp import U, Words, batches, mix, powers

MARK = "▁"  # the vocabulary's word mark
PRIOR = 1_000.0  # pseudo-counts of the vocabulary's own weights
TEXT_BYTES = 1 << 20  # texts handled together
TYPES = 400_000  # distinct words that a task keeps before it starts afresh
POSTINGS = 1_500_000  # tokens of a block
COUNT_BYTES = 16 << 20  # of a table of word counts that is broadcast
END = mix(np.array([0xE0D], U))[0]  # hash of the end token


class Vocabulary:
    """Piece hashes (word-initial ones apart) and log weights, from a SentencePiece model file.

    ``scores="rank"``: the scores order the pieces (BPE models); a piece's weight is one over its
    place. ``scores="log"``: they are log probabilities (unigram models)."""

    def __init__(self, path: str, scores: str = "rank"):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        weights: dict[tuple[int, bytes], float] = {(0, bytes([b])): 0.0 for b in range(256)}
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            piece, score = model.id_to_piece(i), model.get_score(i)
            weight = 1.0 / (10.0 - min(score, 0.0)) if scores == "rank" else float(np.exp(score))
            if model.is_byte(i):
                key = (0, bytes([int(piece[3:5], 16)]))
                weight = max(weight, 1e-9) if scores == "log" else 1.0 / (10.0 + model.get_piece_size())
            else:
                first = piece.startswith(MARK)
                key = (int(first), piece[first:].replace(MARK, " ").encode())
            weights[key] = weights.get(key, 0.0) + weight
        floor = min(w for w in weights.values() if w > 0)
        keys = sorted(weights)
        self._set([max(weights[k], floor) for k in keys], keys)

    def _set(self, weights, keys):
        self.longest = max(len(b) for _, b in keys)
        hashes = np.array([piece_hash(b, kind) for kind, b in keys], U)
        order = np.argsort(hashes)
        self.keys = hashes[order]
        w = np.array(weights)[order]
        self.mark = int(np.searchsorted(self.keys, piece_hash(b"", 1)))
        if self.mark == len(w) or self.keys[self.mark] != piece_hash(b"", 1):
            raise ValueError("the vocabulary has no piece for the word mark")
        end = 1e-3
        self.log = np.log(w / w.sum() * (1 - end))
        self.end = float(np.log(end))

    def learned(self, expected: np.ndarray, ends: float) -> None:
        """Probabilities from expected counts of pieces and ends, with the own weights as prior."""
        counts = expected + PRIOR * np.exp(self.log)
        last = ends + PRIOR * np.exp(self.end)
        self.log = np.log(counts / (counts.sum() + last))
        self.end = float(np.log(last / (counts.sum() + last)))

    def table(self) -> np.ndarray:
        """Which leading hash bits occur: a first, cheap look-up."""
        seen = np.zeros(1 << 20, bool)
        seen[self.keys >> U(44)] = True
        return seen


FIRST = mix(np.array([0xF1857], U))[0]  # added to the hash of a word-initial piece


def piece_hash(data: bytes, kind: int) -> np.uint64:
    """The polynomial of the bytes (no mark, if word-initial)."""
    if not data:
        return FIRST
    w = Words.__new__(Words)
    w.low, w._sums = np.frombuffer(data, np.uint8), None
    return (w.sums()[len(data):] + (FIRST if kind else U(0)))[0]


class Lattice:
    """Forward (and backward) sums of many words of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.seen = vocabulary.table()

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, pieces) of those hashes that are pieces."""
        maybe = np.flatnonzero(self.seen[hashes >> U(44)])
        at = np.searchsorted(self.v.keys, hashes[maybe])
        at = np.minimum(at, len(self.v.keys) - 1)
        ok = self.v.keys[at] == hashes[maybe]
        return maybe[ok], at[ok]

    def run(self, words: Words, counts: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """Log probability of every word; with ``counts``, also adds to ``expected``."""
        size = words.end - words.start
        out = np.empty(len(size))
        for n in np.unique(size).tolist():
            mine = np.flatnonzero(size == n)
            for a in range(0, len(mine), 20_000):
                part = mine[a:a + 20_000]
                out[part] = self._same_length(words, words.start[part], n, None if counts is None else counts[part], expected)
        return out

    def _same_length(self, words, start, n, counts, expected):
        log = self.v.log
        at = start + np.arange(n + 1)[:, None]
        sums, down = words.sums()[at], powers(len(words.low))[1][at[:-1]]
        forward = np.full((n + 1, len(start)), -np.inf)
        forward[0] = log[self.v.mark]
        arcs = []
        for i in range(1, n + 1):
            here = forward[i]
            for j in range(max(0, i - self.v.longest), i):
                span = (sums[i] - sums[j]) * down[j]
                for first in ((0, 1) if j == 0 else (0,)):
                    rows, piece = self._find(span + FIRST if first else span)
                    if len(rows):
                        add = log[piece] if first else forward[j, rows] + log[piece]
                        here[rows] = np.logaddexp(here[rows], add)
                        if counts is not None:
                            arcs.append((i, j, first, rows, piece))
        if counts is not None:
            backward = np.full((n + 1, len(start)), -np.inf)
            backward[n] = 0.0
            total = forward[n]
            for i, j, first, rows, piece in reversed(arcs):
                tail = backward[i, rows] + log[piece]
                before = 0.0 if first else forward[j, rows]
                share = np.exp(before + tail - total[rows]) * counts[rows]
                expected += np.bincount(piece, weights=share, minlength=len(expected))
                if not first:
                    backward[j, rows] = np.logaddexp(backward[j, rows], tail)
            # texts that begin with the bare mark
            expected[self.v.mark] += float((np.exp(forward[0] + backward[0] - total) * counts).sum())
        return forward[n]


class Types:
    """Distinct words seen so far: hash to number, and their bytes."""

    def __init__(self):
        self.keys = np.zeros(0, U)
        self.ids = np.zeros(0, np.int64)
        self.size = 0

    def add(self, words: Words) -> tuple[np.ndarray, Words | None]:
        """Number of every word, and the new distinct words (in the order of their numbers)."""
        h = words.hashes()
        unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == unique[inside]
        number = np.empty(len(unique), np.int64)
        number[known] = self.ids[at[known]]
        new = ~known
        number[new] = self.size + np.arange(int(new.sum()))
        self.keys = np.insert(self.keys, at[new], unique[new])
        self.ids = np.insert(self.ids, at[new], number[new])
        self.size += int(new.sum())
        return number[inverse], (gathered(words, first[new]) if new.any() else None)


def gathered(words: Words, which: np.ndarray) -> Words:
    """A Words object of some of the words."""
    start, size = words.start[which], words.end[which] - words.start[which]
    begin = np.concatenate(([0], np.cumsum(size + 1)))
    buffer = np.full(int(begin[-1]), 32, np.uint8)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    buffer[inside + np.repeat(begin[:-1], size)] = words.low[inside + np.repeat(start, size)]
    w = Words.__new__(Words)
    w.low, w.start, w.end, w._sums = buffer, begin[:-1], begin[1:] - 1, None
    return w


def expected_counts(docs: DataFrame, text: str, vocabulary: Vocabulary) -> tuple[np.ndarray, float]:
    """Expected pieces and number of texts, over all rows of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(parts):
        v = shared.value
        lattice = Lattice(v)
        expected = np.zeros(len(v.keys))
        types, fresh, counts, n = Types(), [], np.zeros(0), 0

        def settle():
            at = 0
            for part in fresh:
                lattice.run(part, counts[at:at + len(part.start)], expected)
                at += len(part.start)

        for batch in parts:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            n += len(texts)
            for i, j in batches(texts, TEXT_BYTES):
                number, new = types.add(Words(texts[i:j]))
                if new is not None:
                    fresh.append(new)
                grown = np.bincount(number, minlength=types.size).astype(float)
                grown[:len(counts)] += counts
                counts = grown
                if types.size > TYPES:
                    settle()
                    types, fresh, counts = Types(), [], np.zeros(0)
        settle()
        piece = np.flatnonzero(expected)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(piece, -1), pa.int32()), pa.array(np.append(expected[piece], float(n)))],
                                         names=["piece", "n"])

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, "piece int, n double")
    sums = rows.groupBy("piece").agg(F.sum("n").alias("n")).collect()  # one row per piece
    out, ends = np.zeros(len(vocabulary.keys)), 0.0
    for piece, n in sums:
        if piece < 0:
            ends = n
        else:
            out[piece] = n
    return out, ends


class Block:
    """Tokens of consecutive rows, to be written as postings."""

    def __init__(self, first: int):
        self.first, self.docs, self.tokens = first, 0, 0
        self.hash, self.doc, self.train = [], [], []

    def add(self, hashes, doc, train):
        self.hash.append(hashes)
        self.doc.append(doc + self.docs)
        self.train.append(train)
        self.docs += len(train)
        self.tokens += len(hashes)

    def packed(self):
        """The block's distinct words, how often each occurs in its training texts, and its postings."""
        h, doc, train = np.concatenate(self.hash), np.concatenate(self.doc), np.concatenate(self.train)
        word, place = np.unique(h, return_inverse=True)
        pair, times = np.unique(place * np.int64(self.docs) + doc, return_counts=True)
        owner, doc = pair // self.docs, pair % self.docs
        learned = np.bincount(owner, weights=times * train[doc], minlength=len(word)).astype(np.int64)
        return word.view(np.int64), learned, pack(np.bincount(owner, minlength=len(word)), doc, times)


def pack(spread, doc, times) -> bytes:
    """Texts per word, then the texts and the word's times in each, word by word."""
    rest = zlib.compress(b"".join(x.astype("<u4").tobytes() for x in (spread, doc, times)), 1)
    return len(spread).to_bytes(4, "little") + len(doc).to_bytes(4, "little") + rest


def unpack(data: bytes):
    n, m = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
    rest = np.frombuffer(zlib.decompress(data[8:]), "<u4").astype(np.int64)
    return rest[:n], rest[n:n + m], rest[n + m:]


def score(df: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text", held_out=None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = df.sparkSession
    ship_package(spark)
    held_out = F.lit(False) if held_out is None else held_out
    docs = df.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = expected_counts(docs.where(~F.col("held_out")), "text", vocabulary)
    vocabulary = copy.copy(vocabulary)  # the caller's stays as it is
    vocabulary.learned(*counts)
    shared = spark.sparkContext.broadcast(vocabulary)
    id_type = dict(docs.dtypes)["doc_id"]
    numbered = docs.select("doc_id", "held_out", "text", F.monotonically_increasing_id().alias("row"))

    def run(parts):
        lattice, types, logs, block = Lattice(shared.value), Types(), np.zeros(0), None

        def table(schema, **columns):
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type)
                                               for f in schema], schema=schema)

        def closed(schema, block):
            words, learned, data = block.packed()
            return table(schema, row=[block.first], docs=[block.docs], words=[words], learned=[learned], data=[data])

        for batch in parts:
            schema = pa.schema([pa.field("doc_id", batch.schema.field(0).type), ("held_out", pa.bool_()), ("row", pa.int64()),
                                ("n_tokens", pa.int64()), ("score", pa.float64()), ("docs", pa.int32()),
                                ("words", pa.list_(pa.int64())), ("learned", pa.list_(pa.int64())), ("data", pa.binary())])
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            held = np.array(batch.column(1).to_pylist(), bool)
            row = batch.column(3).to_numpy(zero_copy_only=False)
            total, n_tokens = np.empty(len(texts)), np.empty(len(texts), np.int64)
            for i, j in batches(texts, TEXT_BYTES):
                if types.size > TYPES:
                    types, logs = Types(), np.zeros(0)
                words = Words(texts[i:j])
                number, new = types.add(words)
                if new is not None:
                    logs = np.concatenate([logs, lattice.run(new)])
                total[i:j] = np.bincount(words.doc, weights=logs[number], minlength=j - i) + shared.value.end
                n_tokens[i:j] = np.diff(words.first) + 1
                if block is None:
                    block = Block(int(row[i]))
                one = np.arange(j - i)
                block.add(np.concatenate([words.hashes(), np.full(j - i, END)]), np.concatenate([words.doc, one]), (~held[i:j]).astype(float))
                if block.tokens > POSTINGS:
                    yield closed(schema, block)
                    block = None
            yield table(schema, doc_id=batch.column(0), held_out=held, row=row, n_tokens=n_tokens, score=total / np.log(10))
        if block is not None:
            yield closed(schema, block)

    out = staged(numbered.mapInArrow(run, f"doc_id {id_type}, held_out boolean, row bigint, n_tokens bigint, score double, "
                                          "docs int, words array<bigint>, learned array<bigint>, data binary"), "lm-postings")
    blocks = out.where(F.col("data").isNotNull())
    each = blocks.select("row", F.posexplode(F.arrays_zip("words", "learned")).alias("place", "w")).select(
        "row", "place", F.col("w.words").alias("word"), F.col("w.learned").alias("learned"))
    count = staged(each.groupBy("word").agg(F.sum("learned").alias("count")), "lm-counts")
    whole = count.agg(F.sum("count").alias("n"), F.sum((F.col("count") > 0).cast("bigint")).alias("v")).first()
    n, v = whole["n"] or 0, whole["v"] or 0
    back = lookup_join(each.select("row", "place", "word"), count.where("count > 0"), "word", "word", "inner",
                       max_broadcast_bytes=COUNT_BYTES).select(F.col("row").alias("block"), "place", "count")

    def known(block, counts):
        """One block of texts: what its words add to every text."""
        if not block.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "logs": pa.array([], pa.float64()), "n_known": pa.array([], pa.int64())})
        docs = block.column("docs")[0].as_py()
        spread, doc, times = unpack(block.column("data")[0].as_py())
        of = np.zeros(len(spread), np.int64)
        of[counts.column("place").to_numpy()] = counts.column("count").to_numpy()
        of = np.repeat(of, spread)
        order = np.argsort(doc, kind="stable")  # every text has a word or its end
        first = np.searchsorted(doc[order], np.arange(docs))
        logs = times.astype(np.longdouble) * np.log10(of + 1.0)
        sums = np.add.reduceat(logs[order], first).astype(np.float64)
        seen = np.bincount(doc, weights=times * (of > 0), minlength=docs).astype(np.int64)
        return pa.table({"row": pa.array(block.column("row")[0].as_py() + np.arange(docs), pa.int64()),
                         "logs": pa.array(sums), "n_known": pa.array(seen)})

    per_row = (blocks.select("row", "docs", "data").groupBy("row").cogroup(back.groupBy("block"))
               .applyInArrow(known, "row bigint, logs double, n_known bigint"))
    rows = out.where(F.col("data").isNull()).join(per_row, "row")
    return rows.select(F.col("doc_id").alias(doc_id), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
                       (F.col("logs") - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"), "score")


def digest(df: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of every row, learned from rows whose crc32(id as text) mod 7 is not 2."""
    return score(df, vocabulary, doc_id, text, F.pmod(crc_of_id(doc_id), F.lit(7)) == 2)
