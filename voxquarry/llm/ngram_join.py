"""N-gram Jaccard join over a token-group matrix.

Documents are sets of word shingles.  Similar documents are partitioned into
groups (exact copies first, then whatever is verified as linked), the matrix
holds for each token the groups whose token union contains it, and a query
document opens a group only if enough of its tokens lie in the group's union.
Opened groups are verified exactly on whole texts.

The matrix is dealt out by token range as arrays, so a range fits in a task
whatever the corpus, and only the lowest ``share`` of each document's hashed
tokens enters.  Tokens of more than ``hot_groups`` groups open nothing; they
are counted per document instead, and every document for which they could
hide a link goes to the second round.

There all documents that are alike, linked or not, form groups: slices of a
class, or of the documents with the same lowest tokens.  The bound is used
top down.  The unions of all other classes, by size of their documents, come
first: who doesn't share enough with one of them has no link, which ends the
search for texts that are almost alike.  Then each group's union, from the smaller class to the larger; only
documents of groups that are opened meet, in one block, and one link to a
class is enough.  Groups grow with the square root of the documents left, so
a frequent token meets groups, not documents.

Why no link is lost: of two sets with Jaccard ``j`` or more, each misses at
most ``1 - j`` of its tokens in the other, so the one whose lowest tokens end
first shares at least ``share - (1 - j)`` of its size with the other's lowest
tokens.  Either enough of those are not hot, or both documents are in the
second round, which has no hot tokens: each shares ``j`` of its size with the
other, so with the unions that hold the other, too.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from .graph import components
from .tokens import blocks, mix, shingle_sets

BROADCAST_BYTES = 16 << 20  # lists of ids up to this size are broadcast, larger ones are joined by shuffle
RANGE_BYTES = 12 << 20  # text bytes per token range in the first round
WIDTH = 1.05  # ratio of sizes in a size class
LATER_BYTES = 4 << 20  # text bytes per token range in the second round, where documents stand in every range they have tokens in
GROUP_BYTES = 4 << 20  # text of a group in the second round, one longer text excepted
BLOCK = 1024  # queries that meet a group at once
STARS = 4  # min-hash keys that propose near copies early
SLACK = 0.99  # ranges compare 32 bits, so two tokens of one text may fall together
EXACT = 50  # up to so many tokens that hardly happens, and the bound is the least whole number


def fetch(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs(id, text)`` whose id is in the stored table ``ids(id, ...)``, with its columns."""
    return docs.join(light(ids), "id")


def light(ids: DataFrame) -> DataFrame:
    """A stored list of ids, to be broadcast if its rows, written out, are small; else the join shuffles."""
    held = ids.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 64)).first()[0] or 0
    return F.broadcast(ids) if held <= BROADCAST_BYTES else ids


def without(docs: DataFrame, ids: DataFrame, id_col: str | Column = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id (or key) isn't in ``ids(gone)``; null ids stay."""
    gone = cut_lineage(ids.distinct())
    key = docs[id_col] if isinstance(id_col, str) else id_col
    return docs.join(light(gone), key == gone["gone"], "left_anti")


def least(tokens: Column) -> Column:
    """Whole number of tokens that a count must reach if ``tokens`` are needed."""
    return F.when(tokens < EXACT, F.ceil(tokens - 1e-6)).otherwise(F.floor(SLACK * tokens))


def set_table(docs: DataFrame, n: int) -> DataFrame:
    """``(id, n, d1, d2, stars)``: set size, 128-bit digest of the set, and min-hash keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = [np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1)) for k in range(2 * STARS)]
        for batch in batches:
            for a, b, texts in blocks(batch.column(1)):
                size, digest, stars = [], [], []
                for s in shingle_sets(texts, n):
                    size.append(len(s))
                    digest.append(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8"))
                    low = np.array([mix(s ^ x).min() for x in salts] if len(s) else [], np.uint64)
                    stars.append(mix(low[::2] * np.uint64(31) + low[1::2]).view(np.int64))
                d = np.array(digest)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(size, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(stars, pa.list_(pa.int64()))],
                    names=["id", "n", "d1", "d2", "stars"],
                )

    return docs.mapInArrow(run, "id bigint, n bigint, d1 bigint, d2 bigint, stars array<bigint>")


def verify(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` whose texts reach the similarity, by exact intersection and union of their sets."""
    pairs = cut_lineage(pairs.distinct())
    ids = cut_lineage(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    texts = cut_lineage(fetch(docs, ids))
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = both.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            keep = []
            at = 0
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            while at < len(left):
                end, size = at, 0
                while end < len(left) and (end == at or size < 1 << 20):
                    size += len(left[end]) + len(right[end])
                    end += 1
                # neighbours often share a side: each distinct text is shingled once
                index = {t: i for i, t in enumerate(dict.fromkeys(left[at:end] + right[at:end]))}
                sets = []
                for _, _, texts_ in blocks(list(index)):
                    sets += shingle_sets(texts_, n)
                for i in range(at, end):
                    x, y = sets[index[left[i]]], sets[index[right[i]]]
                    # numbers of distinct tokens: the union merges two sorted sets
                    if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                        union = len(np.union1d(x, y))
                        if 100 * (len(x) + len(y) - union) >= percent * union and len(x):
                            keep.append(i)
                at = end
            yield batch.take(pa.array(keep, pa.int64())).select(["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def matrix(rows: DataFrame, ranges: int, share: float, n: int, keys: int) -> DataFrame:
    """``(r, part)``: the lowest tokens of the documents by token range, as arrays.

    ``rows`` are ``keys`` whole numbers that go with the document, and its text; without
    such keys, ``(id, text)``, a document goes by the digest of its set, so that copies are one group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in blocks(batch.column(batch.num_columns - 1)):
                sets = shingle_sets(texts, n)
                if keys:
                    own = [np.asarray(batch.column(i).slice(a, b - a)) for i in range(keys)]
                else:
                    own = [np.array([np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), "<i8")[0] for x in sets])]
                lens = np.array([int(np.ceil(share * len(x))) for x in sets])
                if not lens.sum():
                    continue
                tok = np.concatenate([x[:k] for x, k in zip(sets, lens)])
                doc = np.repeat(np.arange(len(sets)), lens)
                place = mix(tok)  # the lowest tokens have low hashes; ranges go by another hash
                r = ((place >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)
                order = np.argsort(r, kind="stable")
                tok32, doc, r = place.astype(np.uint32)[order], doc[order], r[order]
                cuts = np.searchsorted(r, np.arange(ranges + 1))
                ks, parts = [], []
                for k in range(ranges):
                    i, j = cuts[k], cuts[k + 1]
                    if i == j:
                        continue
                    d = doc[i:j]
                    new = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                    of = d[new]
                    count = np.diff(np.r_[new, j - i]).astype("<u4")
                    cols = [np.array([len(of), j - i], "<i8"), *[x[of].astype("<i8") for x in own]]
                    ks.append(k)
                    parts.append(b"".join(x.tobytes() for x in [*cols, count, tok32[i:j].astype("<u4")]))
                yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(parts, pa.binary())], names=["r", "part"])

    return rows.mapInArrow(run, "r int, part binary")


def _unpack(parts: list[bytes], keys: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Tokens of a range, and for each the keys of its document."""
    tok: list[np.ndarray] = []
    own: list[list[np.ndarray]] = [[] for _ in range(keys)]
    for p in parts:
        docs, n = np.frombuffer(p, "<i8", 2).tolist()
        at = 16 + 8 * docs * keys
        count = np.frombuffer(p, "<u4", docs, at)
        tok.append(np.frombuffer(p, "<u4", n, at + 4 * docs))
        for k in range(keys):
            own[k].append(np.repeat(np.frombuffer(p, "<i8", docs, 16 + 8 * docs * k), count))
    return np.concatenate(tok), [np.concatenate(x) for x in own]


def _count(q: np.ndarray, g: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((g, q))
    q, g, c = q[order], g[order], c[order]
    new = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (g[1:] != g[:-1])]) if len(q) else np.zeros(0, np.int64)
    return q[new], g[new], np.add.reduceat(c, new) if len(new) else c


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Places where sorted rows change in any of the columns."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])


def _distinct(tok: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Distinct rows sorted by token, then by the columns in order."""
    order = np.lexsort((*reversed(columns), tok))
    rows = [c[order] for c in (tok, *columns)]
    at = _starts(*rows)
    return [c[at] for c in rows]


def overlaps(tok: np.ndarray, q: np.ndarray, hot_groups: int) -> tuple[tuple, tuple]:
    """Within one token range, of groups of copies: ``(a, b, shared tokens)``, and ``(group, hot tokens)``."""
    tok, q = _distinct(tok, q)
    first = _starts(tok)
    groups = np.repeat(np.diff(np.r_[first, len(tok)]), np.diff(np.r_[first, len(tok)]))
    hq, hc = np.unique(q[groups > hot_groups], return_counts=True)
    cold = (groups > 1) & (groups <= hot_groups)
    tok, q = tok[cold], q[cold]
    found = [(np.zeros(0, np.int64),) * 3]
    for k in range(1, hot_groups):
        same = np.flatnonzero(tok[:-k] == tok[k:])
        found.append((q[same], q[same + k], np.ones(len(same), np.int64)))
    return _count(*[np.concatenate(x) for x in zip(*found)]), (hq, hc)


def size_class(n: Column) -> Column:
    """Sizes that differ by less than a twentieth, numbered."""
    return F.floor(F.log(n) / math.log(WIDTH) + 1e-9).cast("bigint")


def shared_elsewhere(tok: np.ndarray, q: np.ndarray, label: np.ndarray, size: np.ndarray, reach: int) -> tuple:
    """Within one token range: ``(document, size class, shared)`` tokens that other classes hold in documents of a size class.

    Size classes up to ``reach`` away from the document's own can hold a link.
    """
    order = np.lexsort((label, size, tok))
    t, s, x = tok[order], size[order], label[order]
    first = _starts(t, s)
    low, high = x[first], x[np.r_[first[1:], len(t)] - 1] if len(first) else x[first]
    tokens = t[_starts(t)]
    wide = int(size.max(initial=0)) + 2 * reach + 2
    held = np.searchsorted(tokens, t[first]) * wide + s[first] + reach
    tok, q, label, size = _distinct(tok, q, label, size)
    found = [(np.zeros(0, np.int64),) * 3]
    for d in range(-reach, reach + 1):
        want = np.searchsorted(tokens, tok) * wide + size + d + reach
        at = np.minimum(np.searchsorted(held, want), max(len(held) - 1, 0))
        hit = np.flatnonzero((held[at] == want) & ((low[at] != label) | (high[at] != label))) if len(held) else np.zeros(0, np.int64)
        found.append(_count(q[hit], size[hit] + d, np.ones(len(hit), np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found))


def group_overlaps(tok: np.ndarray, q: np.ndarray, g: np.ndarray, kq: np.ndarray, kg: np.ndarray) -> tuple:
    """Within one token range: ``(query, group, shared tokens)`` for groups that rank as high as the query or higher."""
    ask_tok, ask, ask_key = _distinct(tok, q, kq)
    tok, key, g = _distinct(tok, kg, g)
    first = _starts(tok)
    # groups of a token are sorted by rank, so those a query asks are the last ones
    code = np.searchsorted(tok[first], ask_tok)
    end = np.r_[first[1:], len(tok)][code] if len(first) else code
    ranks, place = np.unique(np.r_[key, ask_key], return_inverse=True)
    wide = len(ranks) + 1
    own = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(tok)])) * wide + place[: len(key)]
    start = np.searchsorted(own, code * wide + place[len(key) :])
    held = (np.zeros(0, np.int64),) * 3
    n = end - start
    total, cut = np.r_[0, np.cumsum(n)], 0
    while cut < len(n):
        to = max(cut + 1, int(np.searchsorted(total, total[cut] + (1 << 21), side="right")) - 1)
        m = n[cut:to]
        at = np.repeat(start[cut:to] - np.cumsum(m) + m, m) + np.arange(m.sum())
        held = _count(*[np.concatenate(x) for x in zip(held, (np.repeat(ask[cut:to], m), g[at], np.ones(len(at), np.int64)))])
        cut = to
    return held


def matching(parts: DataFrame, hot_groups: int, keys: int) -> tuple[DataFrame, DataFrame]:
    """Stored ``(q, g, c)`` shared tokens of groups of copies, and ``(q, hot)``, summed over ranges.

    ``parts`` come from ``matrix`` with as many ``keys``; groups go by the first, or by the digest.
    """

    def run(table: pa.Table) -> pa.Table:
        tok, (q, *_) = _unpack(table.column("part").to_pylist(), max(keys, 1))
        (q, g, c), (hq, hc) = overlaps(tok, q, hot_groups)
        kind = pa.array(np.r_[np.zeros(len(q), bool), np.ones(len(hq), bool)])
        return pa.table([kind, pa.array(np.r_[q, hq]), pa.array(np.r_[g, np.zeros(len(hq), np.int64)]), pa.array(np.r_[c, hc])], names=["hot", "q", "g", "c"])

    found = parts.groupBy("r").applyInArrow(run, "hot boolean, q bigint, g bigint, c bigint")
    found = cut_lineage(found.groupBy("hot", "q", "g").agg(F.sum("c").alias("c")))
    return found.where("not hot").drop("hot"), found.where("hot").select("q", F.col("c").alias("hot"))


def survivors(member: DataFrame, rows: DataFrame, ranges: int, n: int, j: float) -> DataFrame:
    """Those of ``member(id, n, label, ...)`` that share enough tokens with other classes to have a link to one."""
    reach = math.ceil(math.log(1 / j) / math.log(WIDTH))

    def run(table: pa.Table) -> pa.Table:
        tok, own = _unpack(table.column("part").to_pylist(), 3)
        return pa.table([pa.array(x, pa.int64()) for x in shared_elsewhere(tok, *own, reach)], names=["id", "size", "c"])

    keyed = cut_lineage(member.select("id", "label", size_class(F.col("n")).alias("size")).distinct())
    texts = fetch(rows, keyed).select("id", "label", "size", "text")
    shared = matrix(texts, ranges, 1.0, n, 3).groupBy("r").applyInArrow(run, "id bigint, size bigint, c bigint")
    shared = shared.groupBy("id", "size").agg(F.sum("c").alias("c"))
    # the smallest size of the class bounds what a link must share
    sizes = member.groupBy(size_class(F.col("n")).alias("size")).agg(F.min("n").alias("smallest"))
    enough = (F.col("c") >= least(j * F.col("n"))) & ((1 + j) * F.col("c") >= SLACK * j * (F.col("n") + F.col("smallest")))
    kept = member.join(shared.join(sizes, "size"), "id").where(enough).select("id").distinct()
    return member.join(kept, "id", "left_semi")


def grouped(member: DataFrame, least_size: int) -> DataFrame:
    """``member(id, n, label, low, bytes)`` with ``grp`` and ``rank``; groups hold about the square root of all.

    Documents of a class of that size are sliced among themselves, all others
    with those of the same lowest tokens ``low``; sizes in a group are close.  ``rank`` orders classes by
    size; where two rank the same, each asks the other.
    """
    size = max(least_size, math.isqrt(member.count()))
    classes = member.groupBy("label").agg(F.count("*").alias("of_label"))
    member = member.join(classes, "label")
    own = F.when(F.col("of_label") >= size, F.xxhash64(F.lit(0), "label")).otherwise(F.xxhash64(F.lit(1), "low"))
    own = F.xxhash64(own, size_class(F.col("n")))
    member = cut_lineage(member.withColumn("kin", own))
    slices = F.greatest(F.ceil(F.count("*") / size), F.ceil(F.sum("bytes") / GROUP_BYTES)).alias("slices")
    member = member.join(member.groupBy("kin").agg(slices), "kin")
    rank = F.least("of_label", F.lit(1 << 20)) * (1 << 42) + F.xxhash64("label").bitwiseAND(F.lit((1 << 42) - 1))
    return member.select(
        "id", "n", "label", "bytes", F.xxhash64("kin", F.pmod(F.xxhash64(F.lit(2), "id"), F.col("slices"))).alias("grp"), rank.alias("rank")
    )


def block_links(queries: pa.Table, members: pa.Table, n: int, percent: int) -> pa.Table:
    """Links ``(a, b)`` of queries to members of a group, one for each class that a query reaches."""
    out: list[tuple[int, int]] = []
    ids, labels = (np.asarray(members.column(c)) for c in ("id", "label"))
    sets = [s for _, _, texts in blocks(members.column("text").combine_chunks()) for s in shingle_sets(texts, n)]
    size = np.array([len(s) for s in sets], np.int64)
    tok = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(tok, kind="stable")
    tok, owner = tok[order], np.repeat(np.arange(len(sets)), size)[order]
    q_ids, q_labels = (queries.column(c).to_pylist() for c in ("id", "label"))
    for a, _, texts in blocks(queries.column("asked").combine_chunks()):
        for k, s in enumerate(shingle_sets(texts, n), a):
            lo, hi = np.searchsorted(tok, s), np.searchsorted(tok, s, side="right")
            m = hi - lo
            shared = np.bincount(owner[np.repeat(lo - np.cumsum(m) + m, m) + np.arange(m.sum())], minlength=len(sets))
            fits = (100 * shared >= percent * (len(s) + size - shared)) & (labels != q_labels[k])
            at = np.flatnonzero(fits)
            for i in at[np.unique(labels[at], return_index=True)[1]].tolist():
                out.append((q_ids[k], int(ids[i])))
    a, b = zip(*out) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def hidden_links(member: DataFrame, rows: DataFrame, n: int, percent: int, least_size: int) -> DataFrame:
    """Links ``(a, b)`` between classes of ``member(id, n, label, low, bytes)``, whatever tokens are frequent."""
    j = percent / 100

    def ranges() -> int:
        return max(2, -(-(member.agg(F.sum("bytes")).first()[0] or 0) // LATER_BYTES))

    for _ in range(2):  # what one document gives up, another may have needed
        member = cut_lineage(survivors(member, rows, ranges(), n, j))
    member = cut_lineage(grouped(member, least_size))
    groups = cut_lineage(member.groupBy("grp").agg(
        F.max("rank").alias("top"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("label").alias("l0"), F.max("label").alias("l1")
    ))
    keyed = member.join(groups.select("grp", "top"), "grp").select("id", "grp", "rank", "top")
    texts = fetch(rows, cut_lineage(keyed)).select("id", "grp", "rank", "top", "text")

    def run(table: pa.Table) -> pa.Table:
        tok, own = _unpack(table.column("part").to_pylist(), 4)
        return pa.table([pa.array(x, pa.int64()) for x in group_overlaps(tok, *own)], names=["id", "grp", "c"])

    found = matrix(texts, ranges(), 1.0, n, 4).groupBy("r").applyInArrow(run, "id bigint, grp bigint, c bigint")
    found = found.groupBy("id", "grp").agg(F.sum("c").alias("c")).join(member.select("id", "n", "label", "bytes"), "id").join(groups, "grp")
    inside = (F.col("most") >= j * F.col("n") * SLACK) & (F.col("least") * j * SLACK <= F.col("n"))
    # no member shares more with the query than the group's union does, which bounds the member's size
    fits = (1 + j) * F.col("c") >= SLACK * j * (F.col("n") + F.col("least"))
    other = (F.col("l0") != F.col("l1")) | (F.col("l0") != F.col("label"))
    opened = found.where((F.col("c") >= least(j * F.col("n"))) & inside & fits & other).select("id", "label", "grp", "bytes")
    opened = cut_lineage(opened)
    # a group that many queries open is met in several blocks of queries
    load = opened.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / GROUP_BYTES)).cast("int").alias("k"))
    load = cut_lineage(load)
    asks = opened.join(load, "grp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    asks = asks.join(rows.select(F.col("id"), "text").join(light(cut_lineage(opened.select("id").distinct())), "id", "left_semi"), "id")
    held = fetch(rows, cut_lineage(member.join(load, "grp").select("id", "label", "grp", "k")))
    held = held.select("id", "label", "grp", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("block"), "text")
    return asks.select("id", "label", "grp", "block", F.col("text").alias("asked")).groupBy("grp", "block").cogroup(held.groupBy("grp", "block")).applyInArrow(
        lambda q, m: block_links(q, m, n, percent), "a bigint, b bigint"
    )


def similar_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    share: float = 0.3,
    hot_groups: int = 8,
    hot_groups_later: int = 32,
) -> DataFrame:
    """Classes of documents linked by Jaccard similarity: ``doc_id, n_shingles, component_id``.

    Two documents link if ``100 * |A & B| >= percent * |A | B|`` for their sets
    of distinct shingles (``shingle`` words; a shorter text is one shingle).
    ``component_id`` is the smallest id that links reach.  Every link between
    different sets counts, however large its group; only links inside a class
    that is already connected aren't spelled out.  Groups of the second round
    hold the square root of its documents, ``hot_groups_later`` at least.

    Null and blank texts: no shingles, linked with nothing.  Null ids: never
    linked, null component.  Rows that repeat an id are one document: the links
    of all its texts are its links, and all its rows get one component.  Very
    long texts are taken whole: one may be a block, a group or a token range's
    share of its own.  Ids are integers; other columns are ignored.  No rows:
    no rows.  Tokens are 64-bit hashes of words.
    """
    spark = docs.sparkSession
    ship_package(spark)
    j = percent / 100
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sets = cut_lineage(set_table(rows, shingle))
    named = sets.where("n > 0 AND id IS NOT NULL")
    classes = cut_lineage(
        named.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("stars").alias("stars"))
    )
    close = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")

    def ordered(df: DataFrame) -> DataFrame:
        return df.where(close & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    # near copies proposed by min-hash keys, each against the first of its key
    keys = classes.select("rep", "n", F.posexplode("stars").alias("k", "key"))
    leader = keys.groupBy("k", "key").agg(F.min(F.struct("rep", "n")).alias("lead"), F.count("*").alias("m")).where("m > 1")
    stars = keys.join(leader, ["k", "key"]).select(
        F.col("rep").alias("a"), F.col("n").alias("na"), F.col("lead.rep").alias("b"), F.col("lead.n").alias("nb")
    )

    bytes_ = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bytes_ // RANGE_BYTES))
    found, hot = matching(matrix(rows.where("id IS NOT NULL"), ranges, share, shingle, 0), hot_groups, 0)
    by_digest = classes.select("d1", "rep", "n")

    def side(name: str, key: str) -> DataFrame:
        return by_digest.select(F.col("d1").alias(key), F.col("rep").alias(name), F.col("n").alias("n" + name))

    least_shared = (share - (1 - j)) * F.least("na", "nb") - F.coalesce("hot", F.lit(0))
    first = found.join(side("a", "q"), "q").join(side("b", "g"), "g").join(hot, "q", "left")
    first = first.where(F.col("c") >= F.floor(SLACK * least_shared))
    links = cut_lineage(verify(rows, ordered(stars).union(ordered(first)), shingle, percent))
    # the texts of one id belong together
    known = sets.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("d1", "d2")).alias("low"), F.max(F.struct("d1", "d2")).alias("high"))
    several = cut_lineage(known.where("low <> high").select("id"))
    if not several.isEmpty():
        held = fetch(named, several).join(classes.select("d1", "d2", "rep"), ["d1", "d2"])
        links = cut_lineage(links.union(held.select(F.col("rep").alias("a"), F.col("id").alias("b"))).distinct())
    labels = cut_lineage(components(links))

    # documents whose links hot tokens could hide
    rest = cut_lineage(
        hot.join(by_digest, hot["q"] == by_digest["d1"])
        .where(F.col("hot") >= least((share - (1 - j)) * j * F.col("n")))
        .select(F.col("rep").alias("id"), "n")
        .distinct()
    )
    if not rest.isEmpty():
        lows = classes.select(F.col("rep").alias("id"), F.col("stars")[0].alias("low"))
        member = rest.join(labels, rest["id"] == labels["node"], "left").select("id", "n", F.coalesce("label", "id").alias("label"))
        size = fetch(rows, rest.select("id")).groupBy("id").agg(F.max(F.octet_length("text")).cast("bigint").alias("bytes"))
        member = cut_lineage(member.join(lows.groupBy("id").agg(F.min("low").alias("low")), "id").join(size, "id"))
        near = hidden_links(member, rows, shingle, percent, hot_groups_later)
        stems = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
        labels = cut_lineage(components(stems.union(near)))
    named = sets.join(classes.select("d1", "d2", "rep"), ["d1", "d2"], "left").withColumn("rep", F.coalesce("rep", "id"))
    named = named.join(labels, F.col("rep") == F.col("node"), "left")
    own = F.coalesce("label", "rep")
    return named.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), own).alias("component_id")
    )
