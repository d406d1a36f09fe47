"""Benchmark decontamination by CGK embedding and bit sampling.

A text is searched for windows as long as a benchmark item and within a small
edit distance of it, in words.  A CGK random walk (each symbol's random bit
says whether the reader moves on) turns edit distance into Hamming distance;
bit-sampling keys of several walks collide for near windows with a chosen
probability; each collision is verified by exact edit distance.  Positions are
drawn from the steps that nearly every walk over ``m`` words takes before its
end, since behind it all windows look alike; an item's key of which all
positions lie behind its own end is left out.

Two lossless bounds limit the windows that are embedded.  Within ``k`` edits
an item keeps one of ``k + 1`` equal pieces whole, so a window must hold an
n-gram of an item; and each edit breaks two word pairs at most, so it must
hold ``m - 1 - 2k`` word pairs of items.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .tokens import Words, blocks, mix, ngram_hash

_U = np.uint64
# A-Z to a-z, ASCII punctuation to space: marks around words don't count as edits.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if 33 <= b < 127 and not chr(b).isalnum() else b for b in range(256))
CELLS = 2 << 20  # words of windows embedded at once
END = _U(0xE0F)  # stands behind the end of a window
DDL = "item_id bigint, start bigint, distance int, item_words int"


@dataclass
class Sampler:
    """Walks and sampled positions, drawn from a seed."""

    walks: int
    positions: np.ndarray  # (walks, keys, bits), as shares of the steps inside the text

    @staticmethod
    def reaching(recall: float, similarity: float, bits: int, walks: int, seed: int = 7) -> Sampler:
        """As many keys as find a window whose walks agree in ``similarity`` of their steps with probability ``recall``."""
        keys = math.ceil(math.log(1 - recall) / math.log(1 - similarity**bits) / walks)
        return Sampler(walks, np.random.default_rng(seed).random((walks, keys, bits)))

    @staticmethod
    def inside(m: int) -> int:
        """Steps that a walk over ``m`` words takes before its end: two a word, less twice their spread."""
        return max(2, int(2 * m - 2 * math.sqrt(2 * m)))

    def keys(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of word rows of one item length, and whether a key saw any word (not just the end)."""
        n, width = symbols.shape
        steps = self.inside(width)
        padded = np.concatenate([symbols, np.full((n, 1), END)], axis=1)
        out, some, rows = [], [], np.arange(n)
        for walk in range(self.walks):
            at = np.zeros(n, np.int64)
            seen = np.empty((steps, n), np.uint64)
            for j in range(steps):
                s = padded[rows, at]
                seen[j] = s
                salt = _U((walk * steps + j + 1) * 0xA24BAED4963EE407 & (2**64 - 1))
                bit = ((s ^ salt) * _U(0x9FB21C651E98DF25)) >> _U(63)
                at = np.minimum(at + bit.astype(np.int64), width)
            for k in range(self.positions.shape[1]):
                key = np.full(n, (walk * 1000 + k + 1) + width * 0x100000, np.uint64)
                word = np.zeros(n, bool)
                # positions of a key lie apart, or they would read one word twice
                apart = steps / (2 * self.positions.shape[2])
                for b, p in enumerate(self.positions[walk, k]):
                    first = p * steps if b == 0 else first + apart + p * apart * 2
                    at_step = seen[int(first) % steps]
                    key = mix(key * _U(0x9E3779B97F4A7C15) + at_step)
                    word |= at_step != END
                out.append(key)
                some.append(word)
        return np.stack(out, axis=1), np.stack(some, axis=1)


def edit_distance(a: np.ndarray, b: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """Exact edit distance of rows: ``a`` of full width against the first ``b_len`` of ``b``."""
    n, m = a.shape
    j = np.arange(b.shape[1] + 1)
    row = np.broadcast_to(j, (n, len(j))).copy()
    for i in range(m):
        step = np.empty_like(row)
        step[:, 0] = i + 1
        step[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (a[:, i : i + 1] != b))
        row = np.minimum.accumulate(step - j, axis=1) + j
    return row[np.arange(n), b_len]


class Items:
    """Benchmark items of one block, with their seeds, pairs and keys."""

    def __init__(self, ids: list[int | None], texts: list[str], share: float, min_words: int, sampler: Sampler):
        w = Words([t.encode("utf-8", "surrogatepass").translate(PLAIN) for t in texts])
        first = np.cumsum(w.count) - w.count
        keep = np.flatnonzero(w.count >= min_words)
        self.ids = [ids[i] for i in keep]
        self.words = [w.hash[first[i] : first[i] + w.count[i]] for i in keep]
        self.lens = w.count[keep].astype(np.int64)
        self.edits = (self.lens * share).astype(np.int64)
        self.sampler = sampler
        if not len(self.ids):
            return
        self.seed_n = int(max(1, (self.lens // (self.edits + 1)).min()))
        self.pairs = np.unique(np.concatenate([ngram_hash(x, 2) for x in self.words]))
        seeds = [ngram_hash(x, self.seed_n) for x in self.words]
        owner = np.repeat(self.lens, [len(s) for s in seeds])
        table = np.unique(np.stack([np.concatenate(seeds), owner.astype(np.uint64)], axis=1), axis=0)
        self.seeds, self.seed_len = table[:, 0], table[:, 1].astype(np.int64)  # one row per seed and item length
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.seeds & _U((1 << 22) - 1)).astype(np.int64)] = True
        self.budget = {int(m): int(m * share) for m in np.unique(self.lens)}
        width = int(self.lens.max())
        rows = np.full((len(self.ids), width), END)
        for i, x in enumerate(self.words):
            rows[i, : len(x)] = x
        self.rows = rows
        keys, usable = self.keys(rows, self.lens)
        flat, owner = keys[usable], np.nonzero(usable)[0]
        order = np.argsort(flat, kind="stable")
        self.key, self.key_item = flat[order], owner[order]

    def keys(self, rows: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of padded rows, each walked at its own length, and which of them saw a word."""
        per = self.sampler.walks * self.sampler.positions.shape[1]
        out, some = np.zeros((len(rows), per), np.uint64), np.zeros((len(rows), per), bool)
        for m in np.unique(lens).tolist():
            of = np.flatnonzero(lens == m)
            out[of], some[of] = self.sampler.keys(rows[of, :m])
        return out, some

    def windows(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """``(start word, item length)`` of all windows that pass the two bounds."""
        grams = ngram_hash(w.hash, self.seed_n)
        hit = np.flatnonzero(self.filter[(grams & _U((1 << 22) - 1)).astype(np.int64)])
        lo = np.searchsorted(self.seeds, grams[hit], side="left")
        hi = np.searchsorted(self.seeds, grams[hit], side="right")
        hit, lo, hi = hit[hi > lo], lo[hi > lo], hi[hi > lo]
        # one row per hit and item length, then one per start
        at = np.repeat(hit, hi - lo)
        ends = np.cumsum(hi - lo)
        m = self.seed_len[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
        pair = ngram_hash(w.hash, 2)
        inside = np.zeros(len(w.hash) + 1, np.int64)
        if len(pair):
            place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            known = (self.pairs[place] == pair) & (w.doc[:-1] == w.doc[1:])
            inside[1 : len(pair) + 1] = np.cumsum(known)
            inside[len(pair) + 1 :] = inside[len(pair)]
        first = np.cumsum(w.count) - w.count
        last = first + w.count
        starts, sizes = [], []
        for a in range(0, len(at), 20_000):
            p, k = at[a : a + 20_000], m[a : a + 20_000]
            doc = w.doc[p]
            low = np.maximum(p - k + self.seed_n, first[doc])
            count = p - low + 1
            s = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            k, end = np.repeat(k, count), np.repeat(last[doc], count)
            edits = np.array([self.budget[x] for x in np.unique(k).tolist()])[np.searchsorted(np.unique(k), k)] if len(k) else k
            stop = np.minimum(s + k, end)
            ok = (stop - s >= k - edits) & (inside[stop - 1] - inside[s] >= k - 1 - 2 * edits)
            both = np.unique(np.stack([s[ok], k[ok]], axis=1), axis=0)
            starts.append(both[:, 0])
            sizes.append(both[:, 1])
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.stack([np.concatenate(starts), np.concatenate(sizes)], axis=1), axis=0)
        return both[:, 0], both[:, 1]

    def matches(self, w: Words) -> list[tuple[int, int, int, int]]:
        """``(document, item, start word, distance)`` of every verified window."""
        if not len(self.ids) or not len(w.hash):
            return []
        start, m = self.windows(w)
        last = (np.cumsum(w.count))[w.doc[start]] if len(start) else start
        found = []
        order = np.argsort(m, kind="stable")
        start, m, last = start[order], m[order], last[order]
        cut = 0
        while cut < len(start):
            step = max(1, CELLS // (4 * int(m[min(len(m) - 1, cut + 1024)])))
            s, k, e = (x[cut : cut + step] for x in (start, m, last))
            width = int(k.max())
            at = s[:, None] + np.arange(width)
            size = np.minimum(s + k, e) - s
            rows = np.where(np.arange(width) < size[:, None], w.hash[np.minimum(at, len(w.hash) - 1)], END)
            keys, _ = self.keys(rows, k)
            lo, hi = np.searchsorted(self.key, keys, side="left"), np.searchsorted(self.key, keys, side="right")
            row, col = np.nonzero(hi > lo)
            n = (hi - lo)[row, col]
            item = self.key_item[np.repeat(lo[row, col], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            row = np.repeat(row, n)
            pair = np.unique(np.stack([row, item], axis=1), axis=0) if len(row) else np.zeros((0, 2), np.int64)
            pair = pair[self.lens[pair[:, 1]] == k[pair[:, 0]]]
            for a in range(0, len(pair), 2048):
                some = pair[a : a + 2048]
                for size_m in np.unique(self.lens[some[:, 1]]).tolist():
                    p = some[self.lens[some[:, 1]] == size_m]
                    d = edit_distance(self.rows[p[:, 1], :size_m], rows[p[:, 0], :size_m], size[p[:, 0]])
                    near = d <= self.budget[size_m]
                    for (r, i), x in zip(p[near].tolist(), d[near].tolist()):
                        found.append((int(w.doc[s[r]]), i, int(s[r]), x))
            cut += step
        return found


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    max_edit_share: float = 0.2,
    min_item_words: int = 8,
    recall: float = 0.999,
    similarity: float = 0.35,
    bits: int = 2,
    walks: int = 12,
    items_per_pass: int = 5000,
) -> DataFrame:
    """Documents that hold a benchmark item: ``doc_id, item_id, start, distance, item_words``.

    A match is a window of as many words as the item (fewer at the end of a
    text) within ``max_edit_share`` edits per word, words without case and
    ASCII punctuation.  One row per document and item: the window with the
    smallest distance, then the first.  Keys are drawn so that a window whose
    walks agree in ``similarity`` of the steps is found with probability
    ``recall``; copies are always found.

    The benchmark is a query set: ``items_per_pass`` items at a time meet all
    documents, so memory is bounded however many there are.  Items of fewer
    than ``min_item_words`` words match nothing, like null texts.  Repeated
    rows give repeated results; null ids of documents and items are kept.  Very
    long texts are searched whole, each as a block of its own.  Other columns
    are ignored.  No rows: no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    items = benchmark.select(F.col(item_col).cast("bigint").alias("i"), F.col(item_text_col).alias("t")).where("t IS NOT NULL")
    passes = max(1, -(-items.count() // items_per_pass))
    sampler = Sampler.reaching(recall, similarity, bits, walks)
    out = None
    for k in range(passes):
        block = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k).collect()
        held = Items([r.i for r in block], [r.t for r in block], max_edit_share, min_item_words, sampler)

        def run(batches: Iterator[pa.RecordBatch], held: Items = held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, texts in blocks(batch.column(1)):
                    w = Words([t.translate(PLAIN) for t in texts])
                    first = np.cumsum(w.count) - w.count
                    best: dict[tuple[int, int], tuple[int, int]] = {}
                    for d, i, s, x in held.matches(w):
                        now = (x, s - int(first[d]))
                        if (d, i) not in best or now < best[d, i]:
                            best[d, i] = now
                    if best:
                        at = [d for d, _ in best]
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column(0).slice(a, b - a).take(pa.array(at)),
                                pa.array([held.ids[i] for _, i in best], pa.int64()),
                                pa.array([s for _, s in best.values()], pa.int64()),
                                pa.array([x for x, _ in best.values()], pa.int32()),
                                pa.array([int(held.lens[i]) for _, i in best], pa.int32()),
                            ],
                            names=["_id", "item_id", "start", "distance", "item_words"],
                        )

        found = rows.mapInArrow(run, f"_id {id_type}, {DDL}")
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("_id", id_col)


def brute_force(docs: list[tuple], items: list[tuple], share: float = 0.2, min_words: int = 8) -> set[tuple]:
    """All ``(document, item)`` matches by trying every window; for tests."""
    found = set()
    held = [(i, Words([t.encode().translate(PLAIN)]).hash) for i, t in items if t]
    for d, text in docs:
        w = Words([(text or "").encode().translate(PLAIN)]).hash
        for i, x in held:
            m, k = len(x), int(len(x) * share)
            if m < min_words:
                continue
            for s in range(0, max(0, len(w) - (m - k)) + 1):
                part = w[s : s + m]
                if len(part) >= m - k and edit_distance(x[None], np.r_[part, np.full(m - len(part), END)][None], np.array([len(part)]))[0] <= k:
                    found.add((d, i))
                    break
    return found
