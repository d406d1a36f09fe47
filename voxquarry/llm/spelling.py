"""Spelling variants: words one edit apart, found with bit-sliced position indexes.

For a block of words the index holds, for each position and letter, the set
of words with that letter there, as bits.  A query word is read letter by
letter; word-parallel recurrences carry the set of words without an error so
far and the sets with one error (a replaced, a missing or an additional
letter, the latter two with the positions shifted by one), so 64 words are
compared by one instruction.

Blocks come from a shuffle: two words one edit apart, the shorter of ``m``
letters, share their first or their last ``m // 2`` letters.  Words meet under
both keys; a pair with equal first letters counts there, any other under the
last letters.  Large groups are split into slices that meet pair by pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_stage, ship_package

CELL = 2048  # words of a block
LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, id_col: str, text_col: str, min_length: int, min_count: int, drop_every: int | None) -> DataFrame:
    """``word, n``: lower-cased runs of letters and how often they occur."""
    text = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), UPPER, LOWER)
    # shorter runs can't become words
    runs = F.regexp_extract_all(text, F.lit("(" + LETTERS + "{%d,})" % min_length), 1)
    df = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("word"))
    if drop_every:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = F.pmod(F.col("h"), F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        df = df.withColumn("h", h).select(F.when(F.col("h") % drop_every == 0, cut).otherwise(F.col("word")).alias("word"))
        df = df.where(F.length("word") >= min_length)
    return df.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


class Index:
    """Bit-sliced positions of a block of words."""

    def __init__(self, words: list[str]):
        self.n = len(words)
        self.lens = np.array([len(w) for w in words], np.int64)
        self.slots = -(-self.n // 64)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.letters, codes = np.unique(flat, return_inverse=True)
        self.width = int(self.lens.max(initial=0))
        self.codes = np.full((self.n, self.width), -1, np.int32)
        self.codes[np.arange(self.width) < self.lens[:, None]] = codes

    def pack(self, bits: np.ndarray) -> np.ndarray:
        """Rows of ``n`` booleans as rows of 64-bit words."""
        out = np.zeros((len(bits), self.slots * 8), np.uint8)
        packed = np.packbits(bits, axis=1, bitorder="little")
        out[:, : packed.shape[1]] = packed
        return out.view(np.uint64)

    def unpack(self, sets: np.ndarray) -> np.ndarray:
        return np.unpackbits(sets.view(np.uint8), axis=1, count=self.n, bitorder="little").astype(bool)

    def of_length(self, n: int) -> np.ndarray:
        return self.pack((self.lens == n)[None])[0]

    def at(self, position: int) -> np.ndarray:
        """Sets of words by letter at a position; the last row, of letters that the index lacks, is empty."""
        rows = np.zeros((len(self.letters) + 1, self.slots), np.uint64)
        if 0 <= position < self.width:
            rows[:-1] = self.pack(self.codes[:, position] == np.arange(len(self.letters))[:, None])
        return rows

    def one_edit(self, words: list[str], head: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """For queries of one length: sets of words by kind of edit, and those that share the first ``head`` letters.

        Kinds: ``replaced``, ``shorter`` (the word lacks one letter of the
        query) and ``longer`` (it has one more).
        """
        size, q = len(words[0]), len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(q, size)
        place = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        place = np.where(self.letters[place] == codes, place, len(self.letters))
        none = np.zeros((q, self.slots), np.uint64)
        clean = np.repeat(self.pack(np.ones((1, self.n), bool)), q, axis=0)
        replaced, shorter, longer, same_head = none, none, none, clean
        before, here, after = self.at(-1), self.at(0), self.at(1)
        for i in range(size):
            c = place[:, i]
            hit, ahead = here[c], after[c]
            replaced = (replaced & hit) | (clean & ~hit)
            shorter = (shorter & before[c]) | clean
            longer = (longer | clean) & ahead
            clean = clean & hit
            if i + 1 == head:
                same_head = clean
            before, here, after = here, after, self.at(i + 2)
        kinds = {
            "replaced": replaced & self.of_length(size),
            "shorter": shorter & self.of_length(size - 1),
            "longer": (longer | clean) & self.of_length(size + 1),
        }
        return kinds, same_head


NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def near_in_cell(cell: pa.Table) -> pa.Table:
    """Near words of the queries of a block: how many, and the most frequent one."""
    m, tail = cell.column("m")[0].as_py(), cell.column("tail")[0].as_py()
    words, counts = cell.column("word").to_pylist(), cell.column("n").to_pylist()
    asks, held = cell.column("asks").to_pylist(), cell.column("held").to_pylist()
    stock = sorted((-n, w) for w, n, h in zip(words, counts, held) if h)  # the most frequent first, ties by code points
    out: list[tuple] = []
    if stock:
        index = Index([w for _, w in stock])
        for size, wanted in ((m, ("replaced", "longer")), (m + 1, ("shorter",))):
            queries = [w for w, a in zip(words, asks) if a and len(w) == size]
            for k in range(0, len(queries), CELL):
                some = queries[k : k + CELL]
                kinds, same_head = index.one_edit(some, m // 2)
                near = kinds[wanted[0]] | kinds[wanted[-1]]
                near = near & ~same_head if tail else near & same_head
                hits = np.flatnonzero(near.any(axis=1))
                bits = index.unpack(near[hits])
                for q, total, best in zip(hits.tolist(), bits.sum(axis=1).tolist(), bits.argmax(axis=1).tolist()):
                    out.append((some[q], total, -stock[best][0], stock[best][1]))
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out), NEAR)] if out else [pa.array([], f.type) for f in NEAR], schema=NEAR)


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best`` of the stored ``words(word, n)`` that have near words."""
    size = F.length("word")
    roles = F.explode(F.array(size, size - 1)).alias("m")
    half = F.floor(F.col("m") / 2).cast("int")
    both = F.explode(F.array(F.lit(False), F.lit(True))).alias("tail")
    keyed = words.select("word", "n", roles).where("m > 1").select("*", both)
    key = F.when(F.col("tail"), F.expr("right(word, int(m / 2))")).otherwise(F.substring("word", F.lit(1), half))
    # long keys travel as 128-bit digests
    keyed = cut_lineage(keyed.withColumn("key", F.md5(key.cast("binary"))))
    groups = keyed.groupBy("m", "tail", "key").agg(F.count("*").alias("size")).where("size > 1")
    totals = groups.groupBy("m", "tail").agg(F.sum(F.when(F.col("size") <= CELL, F.col("size"))).alias("total"))
    groups = groups.join(totals, ["m", "tail"])
    blocks = F.greatest(F.lit(1), F.ceil(F.coalesce("total", F.lit(0)) / CELL))
    groups = cut_lineage(groups.select(
        "m", "tail", "key", F.ceil(F.col("size") / CELL).cast("int").alias("slices"),
        F.when(F.col("size") <= CELL, F.pmod(F.xxhash64("key"), blocks).cast("string")).otherwise(F.col("key")).alias("block"),
    ))
    member = keyed.join(groups, ["m", "tail", "key"])
    own = F.pmod(F.xxhash64("word"), F.col("slices")).cast("int")
    others = F.sequence(F.lit(0), F.col("slices") - 1)
    whole = member.where("slices = 1").select(
        "m", "tail", "block", F.lit(0).alias("i"), F.lit(0).alias("j"), "word", "n", F.lit(True).alias("asks"), F.lit(True).alias("held")
    )
    split = member.where("slices > 1").withColumn("own", own)
    index = split.select("m", "tail", "block", F.col("own").alias("i"), F.explode(others).alias("j"), "word", "n", F.lit(False).alias("asks"), F.lit(True).alias("held"))
    asked = split.select("m", "tail", "block", F.explode(others).alias("i"), F.col("own").alias("j"), "word", "n", F.lit(True).alias("asks"), F.lit(False).alias("held"))
    cells = whole.union(index).union(asked).groupBy("m", "tail", "block", "i", "j")
    found = cells.applyInArrow(near_in_cell, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("low"), "best"))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return found.select("word", "n_near", (-F.col("b.low")).alias("best_n"), "b.best")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for the stored ``forms(word, form)``, by doubling the steps taken in each round.

    Forms are several times as frequent as their words, so paths are short and end.
    """
    now = forms.select("word", F.col("form").alias("root"))
    stored = None
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = cut_lineage(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if stored is not None:
            drop_stage(stored)
        now = stored = step
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        now = step.select("word", "root")


def spelling_variants(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = 6,
    min_count: int = 5,
    ratio: int = 5,
    drop_every: int | None = None,
) -> DataFrame:
    """Words with the frequent word they are likely a variant of: ``word, form, root, n, n_near, form_n``.

    Words are maximal runs of Latin letters with A-Z lower-cased, of
    ``min_length`` letters and ``min_count`` occurrences or more.  Words are
    near if one letter is inserted, deleted or replaced.  ``form`` is the near
    word of largest ``n`` (ties: smallest code points) if it occurs at least
    ``ratio`` times as often, ``root`` the end of the path of forms (the word
    itself without one).  With ``drop_every``, of an occurrence whose crc32 of
    ``<id>:<run>`` it divides, letter ``crc % length`` is left out.

    Null and blank texts have no words, a null id reads as an empty one.
    Repeated rows count each time.  Words may be as long as their texts.
    Other columns are ignored.  No rows or no words: no rows.
    """
    if min_length < 2 or ratio < 2:
        raise ValueError("words of at least two letters and a ratio of at least two")
    ship_package(docs.sparkSession)
    words = cut_lineage(vocabulary(docs, id_col, text_col, min_length, min_count, drop_every))
    near = words.join(near_words(words), "word", "left")
    clear = F.col("best_n") >= ratio * F.col("n")
    near = cut_lineage(near.select(
        "word", F.when(clear, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(clear, F.col("best_n")).alias("form_n"),
    ))
    ends = roots(near.where("form IS NOT NULL").select("word", "form"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
