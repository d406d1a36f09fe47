"""Words and shingles of many texts at once, as 64-bit hashes in numpy arrays.

Texts are UTF-8 joined by line ends into one buffer.  Every byte stands for a
random 64-bit value; a word's hash is its polynomial in the prefix sums of the
buffer, finished by a bit mixer, so no loop runs over words or bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20  # bytes of text handled at once, one longer text excepted
_U = np.uint64
FACTOR = 0xD6E8FEB86659FD93
VALUES = np.random.Generator(np.random.PCG64(20_011)).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))  # A-Z only


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer over 64-bit hashes (one-to-one)."""
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


class Powers:
    """Powers of the factor and of its inverse, as many as asked for so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            self.up = np.multiply.accumulate(np.r_[_U(1), np.full(size - 1, FACTOR, np.uint64)])
            inverse = pow(FACTOR, -1, 1 << 64)
            self.down = np.multiply.accumulate(np.r_[_U(1), np.full(size - 1, inverse, np.uint64)])
        return self.up, self.down


POWERS = Powers()


def each(texts) -> Iterator[str | None]:
    """Values of a list or an Arrow array, of which a few at a time become Python objects."""
    if isinstance(texts, list):
        yield from texts
    else:
        for a in range(0, len(texts), 256):
            yield from texts.slice(a, 256).to_pylist()


def blocks(texts, limit: int = BLOCK) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs of texts (a list or an Arrow array) in UTF-8 of about ``limit`` bytes: ``(from, to, texts)``."""
    held: list[bytes] = []
    at = size = 0
    for i, t in enumerate(each(texts)):
        b = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(b) > limit:
            yield at, i, held
            held, at, size = [], i, 0
        held.append(b)
        size += len(b) + 1
    if held:
        yield at, len(texts), held


class Words:
    """Words of a block: ``hash``, ``start``, ``end`` (in ``buf``) and ``doc`` per word."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        data = b"\n".join(texts) + b"\n"
        self.n = len(texts)
        self.buf = np.frombuffer(data.translate(LOWER) if lower else data, np.uint8)
        self.bounds = np.cumsum([0, *[len(t) + 1 for t in texts]])
        space = IS_SPACE[self.buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.r_[0, edge]
        self.start, self.end = edge[0::2], edge[1::2]  # the buffer ends with white space
        self.doc = np.searchsorted(self.bounds, self.start, side="right") - 1
        up, down = POWERS.upto(len(self.buf) + 1)
        sums = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(VALUES[self.buf] * up[: len(self.buf)], out=sums[1:])
        raw = (sums[self.end] - sums[self.start]) * down[self.start]
        self.hash = mix(raw + (self.end - self.start).astype(np.uint64) * _U(0x9FB21C651E98DF25))
        self.count = np.bincount(self.doc, minlength=self.n) if len(self.doc) else np.zeros(self.n, np.int64)


def ngram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words, across documents too."""
    k, out = _U(0x9E3779B97F4A7C15), np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j in range(n):
        out = out * k + words[j : j + len(out)]
    return mix(out + _U(n))


def shingles(w: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``(doc, hash)`` of all n-word shingles in text order; shorter texts are one shingle, empty ones none."""
    full = ngram_hash(w.hash, n)
    same = np.flatnonzero(w.doc[: len(full)] == w.doc[n - 1 :]) if len(full) else np.zeros(0, np.int64)
    docs, hashes = [w.doc[same]], [full[same]]
    firsts = np.cumsum(w.count) - w.count
    for k in range(1, n):
        few = np.flatnonzero(w.count == k)
        if len(few):
            docs.append(few)
            hashes.append(ngram_hash(w.hash, k)[firsts[few]])
    doc, value = np.concatenate(docs), np.concatenate(hashes)
    order = np.argsort(doc, kind="stable")
    return doc[order], value[order]


def shingle_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased."""
    doc, value = shingles(Words(texts, lower=True), n)
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [np.unique(value[a:b]) for a, b in zip(at, at[1:])]
