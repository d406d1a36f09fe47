"""Language labels for spans of mixed text, and one language per document.

Words are runs of letters.  The script of a word narrows its candidate
languages, letter trigrams score the word under each candidate, and a Viterbi
pass over the words of a text, with a penalty for each switch, labels spans.
All words of a batch are scored at once, and texts advance through Viterbi in
lockstep.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .quality_classifier import held_out

# First code point of script ranges, as in the Unicode charts; other letters are "other".
SCRIPTS = [
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"),
    (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"),
    (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"),
]
NAMES = sorted({n for _, n in SCRIPTS})
BUCKETS = 1 << 16
BLOCK = 1 << 20  # characters scored at once


class Letters:
    """Per code point: letter or mark, lower case, script number."""

    def __init__(self):
        size = 0x110000
        self.script = np.full(size, NAMES.index("other"), np.int16)
        for (a, name), b in zip(SCRIPTS, [a for a, _ in SCRIPTS[1:]] + [size]):
            self.script[a:b] = NAMES.index(name)
        self.letter = np.fromiter((chr(i).isalpha() for i in range(size)), bool, size)
        # marks continue a word but don't start one
        self.mark = np.zeros(size, bool)
        for i in range(0x300, 0x20000):
            if unicodedata.category(chr(i))[0] == "M":
                self.mark[i] = True
        self.lower = np.arange(size, dtype=np.uint32)
        for i in range(0x20000):
            low = chr(i).lower()
            if len(low) == 1:
                self.lower[i] = ord(low)


_LETTERS: list[Letters] = []


def letters() -> Letters:
    if not _LETTERS:
        _LETTERS.append(Letters())
    return _LETTERS[0]


class Block:
    """Words of several texts: trigram bucket per letter, owner, place and script per word."""

    def __init__(self, texts: list[str]):
        t = letters()
        data = "\n".join(texts) + "\n"
        code = np.frombuffer(data.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.bounds = np.cumsum([0, *[len(x) + 1 for x in texts]])
        letter = t.letter[code]
        inside = letter | t.mark[code]
        edge = np.flatnonzero(np.r_[inside[:1], inside[1:] != inside[:-1]])
        self.start, self.end = edge[0::2], edge[1::2]
        held = np.cumsum(np.r_[0, letter])
        real = held[self.end] > held[self.start]
        self.start, self.end = self.start[real], self.end[real]
        self.doc = np.searchsorted(self.bounds, self.start, side="right") - 1
        self.letters = held[self.end] - held[self.start]
        self.script = t.script[code[self.start]]
        low = t.lower[code].astype(np.int64)
        low[~inside] = 0
        before, after = np.r_[0, low[:-1]], np.r_[low[1:], 0]
        tri = (low * 0x9E3779B1 + before * 0x85EBCA77 + after * 0xC2B2AE3D) & 0xFFFFFFFFFFFF
        self.bucket = (((tri ^ (tri >> 17)) * 0x2545F491) >> 13) % BUCKETS
        self.inside = inside


def text_blocks(texts: list[str | None]) -> Iterator[tuple[int, int, list[str]]]:
    held: list[str] = []
    at = size = 0
    for i, t in enumerate(texts):
        if held and size + len(t or "") > BLOCK:
            yield at, i, held
            held, at, size = [], i, 0
        held.append(t or "")
        size += len(t or "") + 1
    if held:
        yield at, len(texts), held


class Model:
    """Languages, trigram log probabilities (bucket x language), and scripts each language is written in."""

    def __init__(self, counts: dict[tuple[str, int], int], min_script_share: float):
        self.langs = sorted({lang for lang, _ in counts})
        n = len(self.langs)
        place = {lang: i for i, lang in enumerate(self.langs)}
        table, scripts = np.zeros((BUCKETS, n)), np.zeros((len(NAMES), n))
        for (lang, k), v in counts.items():
            (table if k >= 0 else scripts)[k if k >= 0 else -1 - k, place[lang]] = v
        self.table = np.log((table + 0.02) / (table.sum(axis=0) + 0.02 * BUCKETS)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=0), 1)
        able = share >= min_script_share
        able[~able.any(axis=1)] = True  # a script nobody was seen in rules nobody out
        self.bar = np.where(able, 0.0, -1e4).astype(np.float32)

    def label(self, b: Block, penalty: float) -> np.ndarray:
        """Language of every word of the block."""
        n = len(self.langs)
        scores = np.zeros((len(b.start), n), np.float32)
        for i in range(n):
            sums = np.r_[0.0, np.cumsum(np.where(b.inside, self.table[b.bucket, i], 0.0))]
            scores[:, i] = sums[b.end] - sums[b.start]
        scores += self.bar[b.script]
        return viterbi(scores, b.doc, len(b.bounds) - 1, penalty)


def viterbi(scores: np.ndarray, doc: np.ndarray, docs: int, penalty: float) -> np.ndarray:
    """Best label per word; ``doc`` is sorted.  Ties keep the label, then prefer the first."""
    words, n = scores.shape
    out = np.zeros(words, np.int16)
    if not words:
        return out
    count = np.bincount(doc, minlength=docs)
    first = np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")
    order = order[count[order] > 0]
    left, start = count[order], first[order]
    active = np.searchsorted(-left, -np.arange(1, left[0] + 1), side="right")  # texts with more than t words
    back = np.zeros((words, n), np.int16)
    own = np.arange(n, dtype=np.int16)
    v = scores[start].astype(np.float64)
    for t in range(1, int(left[0])):
        k = active[t]
        v = v[:k] if len(v) != k else v
        best = v.argmax(axis=1)
        jump = v[np.arange(k), best] - penalty
        stay = v >= jump[:, None]
        at = start[:k] + t
        back[at] = np.where(stay, own, best[:, None])
        nxt = np.where(stay, v, jump[:, None]) + scores[at]
        if t + 1 < left[0] and active[t + 1] < k:
            ended = slice(active[t + 1], k)
            out[start[ended] + t] = nxt[ended].argmax(axis=1)
        elif t + 1 == left[0]:
            out[at] = nxt.argmax(axis=1)
        v = nxt
    one = np.flatnonzero(left == 1)
    out[start[one]] = scores[start[one]].argmax(axis=1)
    for t in range(int(left[0]) - 1, 0, -1):
        at = start[: active[t]] + t
        out[at - 1] = back[at, out[at]]
    return out


def per_language(counts: dict[str, int], max_docs: int) -> float:
    """The number of texts that each language may give so that all give ``max_docs``; rarer languages give all theirs."""
    left, sizes = float(max_docs), sorted(counts.values())
    for k, n in enumerate(sizes):
        if n * (len(sizes) - k) > left:
            return left / (len(sizes) - k)
        left -= n
    return float(max(sizes, default=0))


def train(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    lang_col: str = "lang",
    text_col: str = "text",
    max_docs: int = 20_000,
    min_script_share: float = 0.01,
) -> Model:
    """Trigram and script counts of labelled texts; ``max_docs`` bounds the (hash-drawn) sample in expectation.

    Each language gives the same number of texts, or all if it has fewer.  Rows
    are drawn by id and text, so copies of a text come one by one.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where(
        "lang IS NOT NULL AND text IS NOT NULL"
    )
    # one row per language: bounded by the model's size
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    most = per_language(sizes, max_docs)
    cuts = [(lang, int((1 << 20) * most / n)) for lang, n in sizes.items() if n > most]
    if cuts:
        share = F.create_map(*[F.lit(x) for pair in cuts for x in pair])
        drawn = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(1 << 20))
        rows = rows.where(drawn)
    rows = rows.select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist()), batch.column(1).to_pylist()
            for lang in np.unique(langs):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                sums = total.setdefault(str(lang), np.zeros(BUCKETS + len(NAMES), np.int64))
                for _, _, some in text_blocks(own):
                    b = Block(some)
                    sums[:BUCKETS] += np.bincount(b.bucket[b.inside], minlength=BUCKETS)
                    sums[BUCKETS:] += np.bincount(b.script, b.letters, len(NAMES)).astype(np.int64)
        for lang, sums in total.items():
            k = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(k), pa.string()), pa.array(np.where(k < BUCKETS, k, BUCKETS - 1 - k)), pa.array(sums[k])],
                names=["lang", "k", "n"],
            )

    counts = rows.mapInArrow(run, "lang string, k bigint, n bigint").groupBy("lang", "k").agg(F.sum("n").alias("n"))
    # one row per language and bucket: bounded by the model's size
    got = counts.toArrow()
    keys = zip(got.column("lang").to_pylist(), got.column("k").to_pylist())
    return Model(dict(zip(keys, got.column("n").to_pylist())), min_script_share)


OUT = pa.schema(
    [
        ("lang_pred", pa.string()), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))),
    ]
)


def _spans(b: Block, words: slice, label: np.ndarray, langs: list[str], base: int) -> list[dict]:
    own = label[words]
    cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    last = np.r_[cut[1:], len(own)] - 1
    start, end = b.start[words][cut] - base, b.end[words][last] - base
    return [{"start": s, "end": e, "lang": langs[i]} for s, e, i in zip(start.tolist(), end.tolist(), own[cut].tolist())]


def identify(
    docs: DataFrame,
    model: Model,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    penalty: float = 12.0,
    with_spans: bool = True,
) -> DataFrame:
    """``doc_id, lang_pred, score`` and ``spans`` (``start, end, lang`` in characters) of every whole text.

    ``lang_pred`` is the language of most letters, ``score`` its share of them;
    ties go to the language first by name.  Null texts and texts without a
    letter, and all texts under a model that learned nothing, are ``und`` with
    score 0 and no spans.  Null ids and repeated rows: one result per row.
    Other columns are ignored.  No rows: no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(model)  # buckets x languages, independent of the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        n = len(m.langs)
        for batch in batches:
            for i, j, texts in text_blocks(batch.column(1).to_pylist()):
                b = Block(texts)
                pred, score, spans = ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
                if n and len(b.start):
                    label = m.label(b, penalty)
                    share = np.bincount(b.doc * n + label, b.letters, len(texts) * n).reshape(-1, n)
                    total = share.sum(axis=1)
                    top = share.argmax(axis=1)
                    for d in np.flatnonzero(total).tolist():
                        pred[d] = m.langs[top[d]]
                    score = np.where(total > 0, share.max(axis=1) / np.maximum(total, 1), 0.0)
                    if with_spans:
                        at = np.searchsorted(b.doc, np.arange(len(texts) + 1)).tolist()
                        for d in range(len(texts)):
                            if at[d] < at[d + 1]:
                                spans[d] = _spans(b, slice(at[d], at[d + 1]), label, m.langs, int(b.bounds[d]))
                cols = [batch.column(0).slice(i, j - i), pa.array(pred, pa.string()), pa.array(score)]
                if with_spans:
                    cols.append(pa.array(spans, OUT.field("spans").type))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_pred", "score", "spans"][: len(cols)])

    ddl = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double"
    return rows.mapInArrow(run, ddl + (", spans array<struct<start:int,end:int,lang:string>>" if with_spans else ""))


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows that a model may learn from."""
    return docs.where(~held_out(id_col))
