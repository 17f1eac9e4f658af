import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from helpers import ROWS, empty, frame

from riskloom.llm import bpe


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def plain():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def by_id(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize(("chunk", "overlap"), [(bpe.CHUNK, bpe.OVERLAP), (1000, 50), (37, 4)])
def test_same_ids_as_the_library(spark, vocabulary, plain, chunk, overlap):
    # smaller chunks: without the very long texts, whose one pre-token spans thousands of chunks
    rows = ROWS if chunk > 500 else [r for r in ROWS if len(r[1] or "") < 10_000]
    got = bpe.encode(frame(spark, rows), vocabulary, chunk=chunk, overlap=overlap).collect()
    assert by_id((r["doc_id"], list(r["ids"])) for r in got) == by_id((i, plain.encode_ordinary(t or "")) for i, t, _, _ in rows)


def test_round_trip_and_digests(spark, vocabulary, plain):
    ids = bpe.encode(frame(spark), vocabulary)
    data = bpe.decode(ids, vocabulary).collect()
    assert by_id((r["doc_id"], bytes(r["data"])) for r in data) == by_id((i, (t or "").encode()) for i, t, _, _ in ROWS)

    def digest(t):
        ids = plain.encode_ordinary(t)
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()
    got = bpe.digest(frame(spark), vocabulary).collect()
    assert by_id(tuple(r) for r in got) == by_id((i, *digest(t or "")) for i, t, _, _ in ROWS)
    assert bpe.digest(empty(spark), vocabulary).collect() == []


def test_stitching_random_texts(vocabulary, plain):
    codec, rng = vocabulary.codec(), random.Random(1)
    parts = [" ", "  ", "a", "b'", "s", "1", "\n", "   \n", "é", "漢", "!!", "'ll", "\x1c", "x" * 30, "'re", " "]
    for _ in range(1500):
        s = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 120)))
        chunk, overlap = rng.choice([5, 17, 40]), rng.choice([1, 4, 11])
        n = -(-len(s) // chunk)
        starts = [codec.starts(s[k * chunk:(k + 1) * chunk + overlap], k * chunk, (k + 1) * chunk + overlap < len(s)) for k in range(n)]
        cuts = bpe.stitch(codec, s, starts, chunk, overlap)
        assert bpe._segments(codec, s, cuts) == plain.encode_ordinary(s)


def test_a_long_text_repeated_many_times(spark, vocabulary, plain, monkeypatch):
    """Equal rows meet as one row and come back as many; another id, and another text, stay apart."""
    monkeypatch.setattr(bpe, "COPIES", 7)
    body = "ab 😀 c漢 " * 400
    rows = [(1, body, "en", "a")] * 30 + [(2, body, "en", "a"), (1, body + "x", "en", "a"), (None, body, None, None), (None, body, None, None)]
    got = bpe.encode(frame(spark, rows), vocabulary, chunk=100, overlap=10)
    assert by_id((r["doc_id"], list(r["ids"])) for r in got.collect()) == by_id((i, plain.encode_ordinary(t)) for i, t, _, _ in rows)
