"""Removal of byte strings that stand in an earlier document, by a hash-compared suffix sort.

Suffixes are sorted by mergesort.  Two suffixes are compared by their longest
common extension, found by binary search over prefix polynomial hashes, and
the byte behind it; runs that compare equal are verified byte by byte.  All
merges of all groups advance together in numpy.

To sort only suffixes that can match, every window of ``span`` bytes is keyed
by its anchor, the k-gram of lowest hash inside (equal windows have equal
anchors).  Anchors are dealt out by hash range; those of one document only
drop out.  For the rest, windows with a common anchor occurrence travel as one
stretch of text.  Equal stretches settle all their windows in one comparison;
only stretches that differ under one anchor are sorted window by window, and
of both only those whose hash another document holds too: under a frequent
anchor most differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from .ngram_join import fetch, without
from .tokens import POWERS, VALUES, each, mix

_U = np.uint64
GRAM = 20  # bytes of an anchor
BLOCK = 1 << 17  # bytes keyed at once, few enough for a core's cache
CODES_BYTES = 24 << 20  # text bytes per range of anchors while only their hashes travel
RANGE_BYTES = 5 << 20  # the same for stretches
HELD = 1 << 19  # anchors a task gathers before it deals them out
HELD_BYTES = 8 << 20  # stretches the same, in bytes
WINDOWS = 1 << 18  # windows hashed at once, more only of one distance to a single anchor


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums, one longer than the buffer."""
    up, _ = POWERS.upto(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(VALUES[buf] * up[: len(buf)], out=sums[1:])
    return sums


class Suffixes:
    """Suffixes ``buf[pos : pos + size]`` under hash comparison."""

    def __init__(self, buf: np.ndarray, pos: np.ndarray, size: np.ndarray, sums: np.ndarray | None = None):
        self.buf, self.pos, self.size = buf, pos, size
        self.sums = prefix_hash(buf) if sums is None else sums
        self.down = POWERS.upto(len(buf) + 1)[1]
        # the first eight bytes settle many comparisons
        self.word = np.zeros(len(pos), np.uint64)
        self.ahead = 8 if len(size) and size.min() >= 8 else 0
        for k in range(self.ahead):
            self.word = (self.word << _U(8)) | buf[pos + k]
        self.whole = (self.sums[pos + size] - self.sums[pos]) * self.down[pos]

    def agree(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the first ``n`` bytes at positions ``a`` and ``b`` have one hash."""
        return (self.sums[a + n] - self.sums[a]) * self.down[a] == (self.sums[b + n] - self.sums[b]) * self.down[b]

    def less(self, x: np.ndarray, y: np.ndarray, ties: bool) -> np.ndarray:
        """Whether suffixes ``x`` sort before ``y``; ``ties`` is the answer for equal ones."""
        size_x, size_y = self.size[x], self.size[y]
        out = np.where(size_x == size_y, ties, size_x < size_y)
        odd = np.flatnonzero((size_x != size_y) | (self.whole[x] != self.whole[y]))
        word_x, word_y = self.word[x[odd]], self.word[y[odd]]
        differ = word_x != word_y
        out[odd[differ]] = word_x[differ] < word_y[differ]
        odd = odd[~differ]
        a, b, n = self.pos[x[odd]], self.pos[y[odd]], np.minimum(size_x[odd], size_y[odd])
        same = size_x[odd] != size_y[odd]
        same[same] = self.agree(a[same], b[same], n[same])  # one is a prefix of the other
        odd, a, b, n = odd[~same], a[~same], b[~same], n[~same]
        if len(odd):
            lo, hi = np.full(len(odd), self.ahead), n
            while True:  # the common extension is at least lo and below hi
                wide = hi - lo > 1
                if not wide.any():
                    break
                mid = (lo + hi) // 2
                same = self.agree(a, b, mid)
                lo, hi = np.where(same, mid, lo), np.where(same, hi, mid)
            out[odd] = self.buf[a + lo] < self.buf[b + lo]
        return out

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes inside their groups; ``group`` is sorted.

        Suffixes of one hash go through the merges as one, and groups are
        parted by their first bytes before.
        """
        n = len(group)
        if not n:
            return np.arange(0)
        alike = np.lexsort((self.whole, self.size, self.word, group))
        part = starts(group[alike], self.word[alike])
        first = np.flatnonzero(part | starts(self.size[alike], self.whole[alike]))
        order = self.merge(alike[first], np.cumsum(part)[first])
        count = np.diff(np.r_[first, n])[order]
        return alike[np.arange(n) + np.repeat(first[order] - np.cumsum(count) + count, count)]

    def merge(self, item: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes ``item`` inside their groups, by mergesort."""
        n = len(group)
        order = np.arange(n)
        first = np.flatnonzero(starts(group))
        count = np.diff(np.r_[first, n])
        base, length = np.repeat(first, count), np.repeat(count, count)
        width = 1
        while width < count.max():
            at = np.flatnonzero(length > width)  # places in groups that are still several runs
            local = at - base[at]
            start = local // (2 * width) * (2 * width)
            left = local - start < width
            lo = base[at] + np.where(left, np.minimum(start + width, length[at]), start)  # the other run
            end = base[at] + np.minimum(np.where(left, start + 2 * width, start + width), length[at])
            origin, hi = lo.copy(), end.copy()
            open_ = np.flatnonzero(lo < hi)
            while len(open_):
                mid = (lo[open_] + hi[open_]) // 2
                other, own = item[order[mid]], item[order[at[open_]]]
                # elements of the right run go behind equal ones of the left
                before = np.where(left[open_], self.less(other, own, False), False)
                right = np.flatnonzero(~left[open_])
                before[right] = ~self.less(own[right], other[right], False)
                lo[open_] = np.where(before, mid + 1, lo[open_])
                hi[open_] = np.where(before, hi[open_], mid)
                open_ = open_[lo[open_] < hi[open_]]
            rank = (lo - origin) + (local - start - np.where(left, 0, width))
            new = order.copy()
            new[base[at] + start + rank] = order[at]
            order = new
            width *= 2
        return order

    def equal_runs(self, order: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Number of the run of equal suffixes for each place of ``order``.

        Neighbours with one hash are compared byte by byte; a group with a
        collision is put in order by its bytes.
        """
        n = len(order)
        x, y = order[:-1], order[1:]
        same = (group[1:] == group[:-1]) & (self.size[x] == self.size[y])
        maybe = np.flatnonzero(same & (self.whole[x] == self.whole[y]))
        equal = np.zeros(max(0, n - 1), bool)
        equal[maybe] = True
        wrong = []
        for a in range(0, len(maybe), 1 << 15):
            some = maybe[a : a + (1 << 15)]
            size = self.size[x[some]]
            step = np.arange(int(size.max()))
            inside = step < size[:, None]
            left = self.buf[np.where(inside, self.pos[x[some]][:, None] + step, 0)]
            right = self.buf[np.where(inside, self.pos[y[some]][:, None] + step, 0)]
            wrong.append(some[((left != right) & inside).any(axis=1)])
        bad = np.concatenate(wrong) if wrong else np.zeros(0, np.int64)
        for g in np.unique(group[bad]).tolist():
            a, b = np.searchsorted(group, [g, g + 1])
            text = [self.buf[self.pos[i] : self.pos[i] + self.size[i]].tobytes() for i in order[a:b]]
            place = sorted(range(b - a), key=text.__getitem__)
            order[a:b] = order[a:b][place]
            equal[a : b - 1] = [text[i] == text[j] for i, j in zip(place, place[1:])]
        return np.cumsum(np.r_[False, ~equal]) if n else np.zeros(0, np.int64)


def starts(*cols: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before in any column."""
    out = np.ones(len(cols[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return out


def recurring(group: np.ndarray, whole: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of the suffixes whose hash (or one that meets it) several documents hold in the group."""
    key = mix(whole + mix(group.astype(np.uint64)))
    order = np.argsort(key)
    key, doc = key[order], doc[order]
    same, other = key[1:] == key[:-1], doc[1:] != doc[:-1]
    run = np.cumsum(np.r_[False, ~same]) if len(key) else key.astype(np.int64)
    several = np.zeros(len(key), bool)
    several[run[1:][same & other]] = True
    return np.sort(order[several[run]])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours."""
    n = len(x)
    if n < w:
        return x[:0]
    padded = np.r_[x, np.full(-n % w, np.iinfo(x.dtype).max, x.dtype)].reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


class Stretches:
    """Runs of windows with a common anchor occurrence, for the texts of a block.

    ``doc`` (number in the block), ``start`` and ``last`` (first and last window
    start, in the document), ``lead`` (from the first window to the anchor),
    ``code`` (range of anchors << 32 | 32 bits of the anchor's hash).
    """

    def __init__(self, texts: list[bytes], span: int, ranges: int):
        parts, owner, offset = [], [], []
        for d, t in enumerate(texts):
            for a in range(0, max(0, len(t) - span + 1), BLOCK):
                parts.append(t[a : a + BLOCK + span - 1])
                owner.append(d)
                offset.append(a)
        cols = []
        place = 0
        while place < len(parts):
            end, size = place, 0
            while end < len(parts) and (end == place or size < BLOCK):
                size += len(parts[end])
                end += 1
            cols.append(self._runs(parts[place:end], span))
            seg = cols[-1][0] + place
            own, off = np.array(owner), np.array(offset)
            cols[-1] = (own[seg], cols[-1][1] + off[seg], cols[-1][2] + off[seg], *cols[-1][3:])
            place = end
        self.doc, self.start, self.last, self.lead, anchor = (np.concatenate(x) for x in zip(*cols)) if cols else (np.zeros(0, np.int64),) * 5
        code = mix(anchor.astype(np.uint64) ^ _U(0x5BF0A8B145769231))
        self.range = ((code >> _U(32)) % _U(ranges)).astype(np.int64)
        self.code = (self.range << 32) | (code & _U(0xFFFFFFFF)).astype(np.int64)

    @staticmethod
    def _runs(parts: list[bytes], span: int) -> tuple[np.ndarray, ...]:
        buf = np.frombuffer(b"".join(parts), np.uint8)
        bounds = np.cumsum([0, *map(len, parts)])
        sums = prefix_hash(buf)
        down = POWERS.upto(len(buf) + 1)[1]
        h = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(buf) - GRAM + 1])
        key = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        p = (sliding_min(key, span - GRAM + 1) & _U(0xFFFFFFFF)).astype(np.int64)
        seg = np.repeat(np.arange(len(parts)), np.diff(bounds))[: len(p)]
        s = np.flatnonzero(np.arange(len(p)) + span <= bounds[seg + 1])
        p, seg = p[s], seg[s]
        first = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (seg[1:] != seg[:-1])]) if len(s) else np.zeros(0, np.int64)
        end = np.r_[first[1:], len(s)] - 1
        base = bounds[seg[first]]
        return seg[first], s[first] - base, s[end] - base, p[first] - s[first], h[p[first]]


def _blocks(texts) -> Iterator[tuple[int, int, list[bytes]]]:
    held: list[bytes] = []
    at = size = 0
    for i, t in enumerate(each(texts)):
        b = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(b) > BLOCK:
            yield at, i, held
            held, at, size = [], i, 0
        held.append(b)
        size += len(b)
    if held:
        yield at, len(texts), held


def _pack(*cols: np.ndarray) -> bytes:
    return b"".join([np.array([len(cols[0])], "<i8").tobytes(), *[c.tobytes() for c in cols]])


def _unpack(part: bytes, types: str) -> tuple[list[np.ndarray], int]:
    n = int(np.frombuffer(part, "<i8", 1)[0])
    at, out = 8, []
    for t in types.split():
        out.append(np.frombuffer(part, t, n, at))
        at += n * np.dtype(t).itemsize
    return out, at


def _split(keys: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return list(zip(cut.tolist(), np.r_[cut[1:], len(keys)].tolist()))


def shared_anchors(rows: DataFrame, span: int, ranges: int) -> DataFrame:
    """``(id, codes)``: for each document (several rows each) its anchors that stand in another document too.

    An anchor that several texts gathered by a task hold is settled for them on
    the spot, and sent once.  A range gets a row for each ``HELD`` anchors
    gathered, so rows grow with the input although ranges do too.
    """

    def deal(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        code, doc = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((doc, code))
        code, doc = code[order], doc[order]
        once = np.flatnonzero(starts(code, doc))
        code, doc = code[once], doc[once]
        lead = starts(code)
        many = ~lead | np.r_[~lead[1:], False] if len(code) else lead
        r, kind, parts = [], [], []
        own = np.argsort(doc[many], kind="stable")
        c, d = code[many][own], doc[many][own]
        for i, j in _split(d):
            r.append(int(abs(d[i]) % ranges))
            kind.append(1)
            parts.append(_pack(d[i:j].astype("<i8"), c[i:j].astype("<i8")))
        code, doc = code[lead], doc[lead]
        order = np.lexsort((doc, code >> 32))
        code, doc = code[order], doc[order]
        for i, j in _split(code >> 32):
            r.append(int(code[i] >> 32))
            kind.append(0)
            cut = np.flatnonzero(starts(doc[i:j]))
            count = np.diff(np.r_[cut, j - i])
            parts.append(_pack(doc[i:j][cut].astype("<i8"), count.astype("<u4")) + (code[i:j] & 0xFFFFFFFF).astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(kind, pa.int8()), pa.array(parts, pa.binary())], names=["r", "kind", "part"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for a, b, texts in _blocks(batch.column(1)):
                ids = np.asarray(batch.column(0).slice(a, b - a))
                w = Stretches(texts, span, ranges)
                held.append((w.code, ids[w.doc]))
                n += len(w.code)
                if n >= HELD:
                    yield deal(held)
                    held, n = [], 0
        if held:
            yield deal(held)

    def meet(table: pa.Table) -> pa.Table:
        r = table.column("r")[0].as_py()
        ids, out, code, doc = [], [], [], []
        for kind, part in zip(table.column("kind").to_pylist(), table.column("part").to_pylist()):
            if kind:
                (d, c), _ = _unpack(part, "<i8 <i8")
                ids.append(int(d[0]))
                out.append(c.tobytes())
            else:
                (d, n), at = _unpack(part, "<i8 <u4")
                doc.append(np.repeat(d, n))
                code.append(np.frombuffer(part, "<u4", offset=at))
        if code:
            code, doc = np.concatenate(code), np.concatenate(doc)
            order = np.argsort(code, kind="stable")
            code, doc = code[order], doc[order]
            same = code[1:] == code[:-1]
            many = np.r_[same, False] | np.r_[False, same]
            code, doc = code[many], doc[many]
            order = np.argsort(doc, kind="stable")
            code, doc = code[order], doc[order]
            for i, j in _split(doc):
                ids.append(int(doc[i]))
                out.append((code[i:j].astype("<i8") | (r << 32)).tobytes())
        return pa.table([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "codes"])

    sent = rows.mapInArrow(send, "r int, kind byte, part binary")
    return sent.groupBy("r").applyInArrow(meet, "id bigint, codes binary")


def repeated(rows: DataFrame, span: int, known_in: int, ranges: int) -> DataFrame:
    """``(id, tag, spans)``: stretches of windows that stand in a smaller document, packed, several rows each.

    The codes of ``rows`` are of ``known_in`` ranges; stretches are dealt to ``ranges``.
    """

    def deal(held: list[tuple]) -> pa.RecordBatch:
        cut = [text for part in held for text in part[0]]
        ids, tags, start, last, lead, code = (np.concatenate(x) for x in list(zip(*held))[1:])
        # equal stretches gathered together: only those of the smallest document travel
        own = ids.tolist()
        low: dict[bytes, int] = {}
        for text, d in zip(cut, own):
            if low.setdefault(text, d) > d:
                low[text] = d
        later = np.array([d > low[text] for text, d in zip(cut, own)], bool)
        r, kind, parts = [], [], []
        done = np.flatnonzero(later)
        done = done[np.lexsort((tags[done], ids[done]))]
        edge = np.r_[np.flatnonzero(starts(ids[done], tags[done])), len(done)].tolist()
        for i, j in zip(edge, edge[1:]):
            d, of = done[i], done[i:j]
            r.append(int(abs(ids[d]) % ranges))
            kind.append(1)
            parts.append(np.array([ids[d], tags[d]], "<i8").tobytes() + np.stack([start[of], last[of] + span], axis=1).astype("<i8").tobytes())
        sent = np.flatnonzero(~later)
        to = (mix(code[sent].astype(np.uint64)) % _U(ranges)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        sent, to = sent[order], to[order]
        for i, j in _split(to):
            of = sent[i:j]
            r.append(int(to[i]))
            kind.append(0)
            spans = b"".join([cut[x] for x in of.tolist()])
            parts.append(
                _pack(ids[of].astype("<i8"), tags[of].astype("<i8"), start[of].astype("<i8"), (last[of] - start[of]).astype("<u1"), lead[of].astype("<u1"), (code[of] & 0xFFFFFFFF).astype("<u4")) + spans
            )
        return pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(kind, pa.int8()), pa.array(parts, pa.binary())], names=["r", "kind", "part"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for a, b, texts in _blocks(batch.column(3)):
                ids, tags = np.asarray(batch.column(0).slice(a, b - a)), np.asarray(batch.column(1).slice(a, b - a))
                known = [np.frombuffer(b"".join(x), "<i8") for x in batch.column(2).slice(a, b - a).to_pylist()]
                w = Stretches(texts, span, known_in)
                of = np.repeat(np.arange(len(known)), [len(x) for x in known])
                # hashes of code and document that meet let a stretch through for nothing
                keep = np.isin(mix(w.code.astype(np.uint64) + mix(w.doc.astype(np.uint64))), mix(np.concatenate(known).astype(np.uint64) + mix(of.astype(np.uint64))))
                doc, start, last = w.doc[keep], w.start[keep], w.last[keep]
                cut = [texts[d][x : y + span] for d, x, y in zip(doc.tolist(), start.tolist(), last.tolist())]
                held.append((cut, ids[doc], tags[doc], start, last, w.lead[keep], w.code[keep]))
                size += int((last - start).sum()) + span * len(doc)
                if size >= HELD_BYTES:
                    yield deal(held)
                    held, size = [], 0
        if held:
            yield deal(held)

    def meet(table: pa.Table) -> pa.Table:
        ids, tags, out, cols, texts = [], [], [], [], []
        for kind, part in zip(table.column("kind").to_pylist(), table.column("part").to_pylist()):
            if kind:
                d, t = np.frombuffer(part, "<i8", 2).tolist()
                ids.append(d)
                tags.append(t)
                out.append(part[16:])
            else:
                c, at = _unpack(part, "<i8 <i8 <i8 <u1 <u1 <u4")
                cols.append(c)
                texts.append(part[at:])
        if cols:
            doc, tag, start, more, lead, code = (np.concatenate(x) for x in zip(*cols))
            found = dup_windows(doc, np.frombuffer(b"".join(texts), np.uint8), more.astype(np.int64), lead.astype(np.int64), code.astype(np.int64), span)
            i, lo, hi = found
            order = np.lexsort((start[i] + lo, tag[i], doc[i]))
            i, lo, hi = i[order], lo[order], hi[order]
            key = np.cumsum(np.r_[False, (doc[i][1:] != doc[i][:-1]) | (tag[i][1:] != tag[i][:-1])]) if len(i) else i
            for a, b in _split(key):
                ids.append(int(doc[i[a]]))
                tags.append(int(tag[i[a]]))
                out.append(np.stack([start[i[a:b]] + lo[a:b], start[i[a:b]] + hi[a:b]], axis=1).astype("<i8").tobytes())
        return pa.table([pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(out, pa.binary())], names=["id", "tag", "spans"])

    sent = rows.mapInArrow(send, "r int, kind byte, part binary")
    return sent.groupBy("r").applyInArrow(meet, "id bigint, tag bigint, spans binary")


def dup_windows(
    doc: np.ndarray, buf: np.ndarray, more: np.ndarray, lead: np.ndarray, code: np.ndarray, span: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(stretch, from, to)``: bytes of stretches covered by windows of a smaller document.

    ``more`` windows follow the first in each stretch, its anchor is ``lead``
    bytes in; stretches stand back to back in ``buf``.  Equal windows have
    their anchors in one place, so only stretches of one ``code``, and in them
    windows of one distance to the anchor, are sorted together.
    """
    size = more + span
    pos = np.cumsum(size) - size
    sums, down = prefix_hash(buf), POWERS.upto(len(buf) + 1)[1]
    kind = (code << 16) | (lead << 8) | more
    # a stretch that no other document may hold needs no place among the others
    some = recurring(kind, (sums[pos + size] - sums[pos]) * down[pos], doc)
    some = some[np.argsort(kind[some], kind="stable")]
    s = Suffixes(buf, pos[some], size[some], sums)
    group = np.cumsum(starts(kind[some]))
    place = s.sort(group)
    run = s.equal_runs(place, group)
    item = some[place]  # stretches in sorted order
    heads = np.flatnonzero(starts(run))
    later = doc[item] > np.minimum.reduceat(doc[item], heads)[run] if len(item) else np.zeros(0, bool)
    whole = item[later]
    # what is left of each run goes on window by window, where its code has several runs
    alone = np.ones(len(doc), bool)
    alone[some] = False
    order = np.argsort(code, kind="stable")
    number = np.empty(len(code), np.int64)
    number[order] = np.cumsum(starts(code[order])) - 1
    variants = np.bincount(np.r_[number[item[heads]], number[alone]], minlength=len(code))
    open_ = variants[number] > 1
    open_[whole] = False
    rest = order[open_[order]]
    many = np.cumsum(more[rest] + 1)
    found = [(whole, np.zeros(len(whole), np.int64), size[whole])]
    cut = 0
    while cut < len(rest):
        end = int(np.searchsorted(many, (many[cut - 1] if cut else 0) + WINDOWS, side="right"))
        over = code[rest[cut]] == code[rest[min(end, len(rest) - 1)]] and end < len(rest)
        if over:  # one code alone goes on by distance to the anchor
            end = cut + int(np.searchsorted(code[rest[cut:]], code[rest[cut]], side="right"))
        else:  # whole codes
            end = end if end == len(rest) else cut + int(np.searchsorted(code[rest[cut:end]], code[rest[end]]))
        found.append(_windows(rest[cut:end], doc, buf, pos, more, lead, code, span, sums, over))
        cut = end
    return tuple(np.concatenate(x) for x in zip(*found))


def _windows(rest, doc, buf, pos, more, lead, code, span: int, sums: np.ndarray, by_distance: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for the windows of stretches ``rest``, whole codes at a time."""
    which, step = [], []
    if by_distance:
        for distance in range(int((lead[rest] - more[rest]).min()), int(lead[rest].max()) + 1):
            own = np.flatnonzero((lead[rest] >= distance) & (lead[rest] - more[rest] <= distance))
            some = _later(rest, own, lead[rest[own]] - distance, doc, buf, pos, lead, code, span, sums)
            which.append(some[0])
            step.append(some[1])
    else:
        n = more[rest] + 1
        own = np.repeat(np.arange(len(rest)), n)
        some = _later(rest, own, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), doc, buf, pos, lead, code, span, sums)
        which.append(some[0])
        step.append(some[1])
    w, x = np.concatenate(which), np.concatenate(step)
    order = np.lexsort((x, w))
    w, x = w[order], x[order]
    # windows next to each other are one stretch of bytes
    first = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (x[1:] != x[:-1] + 1)]) if len(w) else w
    end = np.r_[first[1:], len(w)] - 1 if len(w) else w
    return rest[w[first]], x[first], x[end] + span


def _later(rest, which, step, doc, buf, pos, lead, code, span: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows ``step`` of the stretches ``rest[which]`` those that a smaller document holds at the same distance to the anchor."""
    at = pos[rest[which]] + step
    kind = (code[rest[which]] << 8) | (lead[rest[which]] - step)
    some = recurring(kind, (sums[at + span] - sums[at]) * POWERS.upto(len(buf) + 1)[1][at], doc[rest[which]])
    some = some[np.argsort(kind[some], kind="stable")]
    if not len(some):
        return which[some], step[some]
    win = Suffixes(buf, at[some], np.full(len(some), span, np.int64), sums)
    group = np.cumsum(starts(kind[some]))
    place = win.sort(group)
    run = win.equal_runs(place, group)
    d = doc[rest[which[some]]][place]
    low = np.minimum.reduceat(d, np.flatnonzero(starts(run)))
    hit = some[place[d > low[run]]]
    return which[hit], step[hit]


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = 50) -> DataFrame:
    """Bytes of each text that stand, ``span`` at a time, in a document of smaller id are removed.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256`` per row
    (``kept`` is binary).  Texts are whole UTF-8 byte strings; strings are
    judged on the input; matches never cross documents.

    Null and empty texts: nothing to remove.  Null ids: nothing is removed
    from them or because of them.  Rows that repeat an id don't remove each
    other's bytes.  Ids are integers; other columns are ignored.  No rows: no
    rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    facts = cut_lineage(
        rows.select("id", F.octet_length("text").cast("bigint").alias("bytes"), F.sha2("text", 256).alias("digest"), F.xxhash64("text").alias("tag"))
    )
    # later copies of a whole text go as a whole, and needn't be sources
    first = facts.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("m")).where("m > 1")
    copies = cut_lineage(facts.join(first, "digest").where("id > first").select("id", "digest", "bytes"))
    named = rows.where("id IS NOT NULL")
    own = named.withColumn("digest", F.sha2("text", 256))
    own = without(own, copies.select(F.struct("id", "digest").alias("gone")), F.struct("id", "digest")).select("id", "text")
    bytes_ = facts.agg(F.sum("bytes")).first()[0] or 0
    few = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    known_in, ranges = max(few, -(-bytes_ // CODES_BYTES)), max(few, -(-bytes_ // RANGE_BYTES))
    codes = cut_lineage(shared_anchors(own, span, known_in))
    listed = codes.groupBy("id").agg(F.collect_list("codes").alias("codes"))
    ids = cut_lineage(codes.select("id").distinct())
    texts = fetch(own, ids).withColumn("tag", F.xxhash64("text"))
    asked = texts.join(listed, "id").select("id", "tag", "codes", "text")
    found = cut_lineage(repeated(asked, span, known_in, ranges))
    spans = found.groupBy("id", "tag").agg(F.collect_list("spans").alias("spans"))
    hit = cut_lineage(found.select("id").distinct())
    texts = fetch(own, hit).withColumn("tag", F.xxhash64("text")).join(spans, ["id", "tag"]).select("id", "tag", "spans", "text")
    cleaned = texts.dropDuplicates(["id", "tag"]).mapInArrow(cut_out, "c_id bigint, c_tag bigint, removed bigint, runs bigint, c_kept binary, c_digest string")
    gone = copies.where(F.col("bytes") >= span).select(F.col("id").alias("g_id"), F.col("digest").alias("g_digest"), F.lit(True).alias("copy")).distinct()
    # digests and sizes are made before the joins: a reader that leaves out "kept" moves no texts
    all_ = rows.withColumns({"digest": F.sha2("text", 256), "tag": F.xxhash64("text"), "bytes": F.octet_length("text").cast("bigint")})
    out = all_.join(cleaned, (F.col("id") == F.col("c_id")) & (F.col("tag") == F.col("c_tag")), "left")
    out = out.join(gone, (F.col("id") == F.col("g_id")) & (F.col("digest") == F.col("g_digest")), "left")
    nothing, zero = F.lit("").cast("binary"), F.lit(0).cast("bigint")
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("bytes").alias("n_bytes"),
        F.when(F.col("copy"), F.col("bytes")).otherwise(F.coalesce("removed", zero)).alias("n_removed"),
        F.when(F.col("copy"), F.lit(1).cast("bigint")).otherwise(F.coalesce("runs", zero)).alias("n_spans"),
        F.when(F.col("copy"), nothing).otherwise(F.coalesce("c_kept", F.col("text").cast("binary"))).alias("kept"),
        F.when(F.col("copy"), F.sha2(nothing, 256)).otherwise(F.coalesce("c_digest", "digest")).alias("kept_sha256"),
    )


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the spans of each text and cut them out."""
    for batch in batches:
        removed, runs, kept = [], [], []
        for spans, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            raw = text.encode("utf-8", "surrogatepass")
            pairs = np.frombuffer(b"".join(spans), "<i8").reshape(-1, 2)
            change = np.zeros(len(raw) + 1, np.int32)
            np.add.at(change, pairs[:, 0], 1)
            np.add.at(change, pairs[:, 1], -1)
            gone = np.cumsum(change[:-1]) > 0
            removed.append(int(gone.sum()))
            runs.append(int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]])))
            kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])],
            names=["c_id", "c_tag", "removed", "runs", "c_kept", "c_digest"],
        )
