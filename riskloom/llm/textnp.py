"""Words of many texts at once, as numpy arrays: positions, owners and 64-bit hashes."""

from __future__ import annotations

import numpy as np

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (public domain): spreads every input bit over the output."""
    x = x.astype(U, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U(shift)
        x *= U(factor)
    x ^= x >> U(31)
    return x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
OTHER = np.ones(256, bool)  # all but ASCII letters and digits and the bytes of other characters
OTHER[48:58] = OTHER[65:91] = OTHER[97:123] = OTHER[128:] = False
LETTER = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))  # a random number per byte value
BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n (or more)."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        if size > 1 << 22:
            _powers.clear()
        pair = []
        for b in (BASE, BASE_INVERSE):
            p = np.full(size, b, U)
            p[0] = 1
            pair.append(np.cumprod(p, dtype=U))
        _powers[size] = (pair[0], pair[1])
    return _powers[size]


def batches(texts: list[bytes], max_bytes: int = 1 << 20):
    """(first, last) index ranges of texts that hold about ``max_bytes`` together; a longer text
    is a range of its own."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > max_bytes:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


class Words:
    """The words of a list of texts. ``start``, ``end``: byte positions in ``raw``; ``doc``: index
    of the text; ``first[d] : first[d + 1]`` are the words of text d."""

    def __init__(self, texts: list[bytes], separators: np.ndarray = SPACE):
        joined = b" ".join(texts) + b" "
        self.raw = np.frombuffer(joined, np.uint8)
        self.low = LOWER[self.raw]
        blank = separators[self.raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.concatenate(([0], np.cumsum(sizes + 1)))
        self.first = np.searchsorted(self.start, self.begin)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

        self._sums = None

    def sums(self) -> np.ndarray:
        """Running sums of the bytes' random numbers times powers: a span's difference, brought
        back by the power of its start, is a polynomial in its bytes wherever it stands."""
        if self._sums is None:
            up, _ = powers(len(self.low))
            self._sums = np.zeros(len(self.low) + 1, U)
            np.cumsum(LETTER[self.low] * up[: len(self.low)], out=self._sums[1:])
        return self._sums

    def span_hashes(self, start: np.ndarray, end: np.ndarray, kind: int = 0) -> np.ndarray:
        """64-bit hash of lower-cased byte spans."""
        sums, (_, down) = self.sums(), powers(len(self.low))
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) + U(kind << 32))

    def hashes(self) -> np.ndarray:
        """Hash of every lower-cased word."""
        return self.span_hashes(self.start, self.end)

    def text(self, i: int) -> bytes:
        return self.low[self.start[i]:self.end[i]].tobytes()
