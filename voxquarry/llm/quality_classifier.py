"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a short vector of transformed counts; class means and
covariances come from one aggregate over all labelled rows, covariances are
shrunk towards their common diagonal, and a score is the logistic function of
the difference of Gaussian log densities, from cached Cholesky factors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from .tokens import Words, blocks, shingles

# Byte classes counted in a text.
CLASSES = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": b"0123456789",
    "stop": b".,;:",
    "shout": b"!?",
    "bar": b"|<>[]{}\\",
    "symbol": b"#*$%&@~^=+_/",
    "line": b"\n",
    "space": b" \t\x0b\x0c\r\n",
    "wide": bytes(range(128, 256)),
}
FEATURES = [
    "words", "word_bytes", "upper", "digit", "stop", "shout", "bar", "symbol", "wide",
    "distinct", "repeats", "shingles", "lines", "dup_lines", "wide_upper",
]


def features(texts: list[bytes]) -> np.ndarray:
    """One row per text: log ratios of counts, half a count added so that zero is defined."""
    w = Words(texts)
    cuts = w.bounds[:-1]
    n = {}
    for name, members in CLASSES.items():
        table = np.zeros(256, np.int64)
        table[list(members)] = 1
        n[name] = np.add.reduceat(table[w.buf], cuts)
    # upper-case accented Latin letters: C3 80 - C3 9E
    pair = np.zeros(len(w.buf), np.int64)
    pair[1:] = (w.buf[:-1] == 0xC3) & (w.buf[1:] < 0x9F) & (w.buf[1:] >= 0x80)
    wide_upper = np.add.reduceat(pair, cuts)
    words = w.count.astype(float)
    size = np.diff(w.bounds) - n["space"].astype(float)
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, bool)
    distinct = np.bincount(d[new], minlength=w.n).astype(float)
    again = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    repeats = np.bincount(w.doc[1:][again], minlength=w.n).astype(float)
    sd, sh = shingles(w, 3)
    order = np.lexsort((sh, sd))
    sh, sd = sh[order], sd[order]
    new = np.r_[True, (sh[1:] != sh[:-1]) | (sd[1:] != sd[:-1])] if len(sh) else np.zeros(0, bool)
    grams = np.bincount(sd, minlength=w.n).astype(float)
    own = np.bincount(sd[new], minlength=w.n).astype(float)
    dup_lines = np.zeros(w.n)
    for i, t in enumerate(texts):
        if t.count(b"\n"):
            lines = [x for x in t.split(b"\n") if x]
            dup_lines[i] = len(lines) - len(set(lines))

    def share(a, b):
        return np.log((a + 0.5) / (b + 1.0))

    letters = n["upper"] + n["lower"] + n["wide"]
    cols = [
        np.log1p(words), share(size, words), share(n["upper"], letters), share(n["digit"], size), share(n["stop"], words),
        share(n["shout"], words), share(n["bar"], words), share(n["symbol"], words), share(n["wide"], size),
        share(distinct, words), share(repeats, words), share(grams - own, grams), share(n["line"], words),
        share(dup_lines, n["line"]), share(wide_upper, n["wide"]),
    ]
    return np.stack(cols, axis=1)


@dataclass
class Model:
    """Means, lower Cholesky factors, their log determinants and the log prior odds."""

    mean: np.ndarray  # (2, d)
    factor: np.ndarray  # (2, d, d)
    logdet: np.ndarray  # (2,)
    log_odds: float
    temper: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: logistic of the difference of log densities."""
        dens = []
        for c in (0, 1):
            z = np.linalg.solve(self.factor[c], (x - self.mean[c]).T)
            dens.append(-0.5 * (z * z).sum(axis=0) - 0.5 * self.logdet[c])
        gap = np.clip(self.temper * (dens[1] - dens[0]) + self.log_odds, -60, 60)
        return 1.0 / (1.0 + np.exp(-gap))


def document_features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(_id, _x)``: features of every whole text; null and empty texts are all-zero counts."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in blocks(batch.column(1)):
                x = features(texts)
                values = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), values], names=["_id", "_x"])

    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, _x array<double>")


def fit(labelled: DataFrame, *, shrinkage: float = 0.05, temper: float = 1.0) -> Model:
    """Fit on ``(_x array<double>, label 0/1)``; sums of all rows are gathered, not rows.

    ``shrinkage`` is the weight of the pooled diagonal in each class
    covariance.  A class without rows takes the pooled statistics, no rows at
    all give a standard normal for both, so that every score is one half.
    """
    d = len(FEATURES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten()).reshape(-1, d)
            y = np.asarray(batch.column(1))
            for c in (0, 1):
                z = x[y == c]
                n[c] += len(z)
                s[c] += z.sum(axis=0)
                q[c] += z.T @ z
        flat = np.concatenate([n, s.ravel(), q.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "v"])

    parts = labelled.select("_x", F.col("label").cast("int").alias("label")).mapInArrow(sums, "i bigint, v double")
    # rounding makes the sum independent of the order in which tasks end
    got = {r.i: r.v for r in parts.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,9)")).cast("double").alias("v")).collect()}
    flat = np.array([got.get(i, 0.0) for i in range(2 + 2 * d + 2 * d * d)])
    n, s, q = flat[:2], flat[2 : 2 + 2 * d].reshape(2, d), flat[2 + 2 * d :].reshape(2, d, d)
    total = n.sum()
    if total < 1:
        return Model(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), 0.0)
    pooled_mean = s.sum(axis=0) / total
    mean = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], pooled_mean)
    within = sum(q[c] - n[c] * np.outer(mean[c], mean[c]) for c in (0, 1)) / total
    diagonal = np.diag(np.maximum(np.diag(within), 1e-3))
    factor = np.zeros((2, d, d))
    for c in (0, 1):
        cov = (q[c] - n[c] * np.outer(mean[c], mean[c])) / n[c] if n[c] > 1 else within
        factor[c] = np.linalg.cholesky((1 - shrinkage) * cov + shrinkage * diagonal + 1e-6 * np.eye(d))
    logdet = 2 * np.log(np.stack([np.diag(f) for f in factor])).sum(axis=1)
    return Model(mean, factor, logdet, float(np.log((n[1] + 1) / (n[0] + 1))), temper)


def held_out(id_col: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    shrinkage: float = 0.05,
    temper: float = 0.25,
) -> tuple[DataFrame, Model]:
    """Stored features of all documents, and a model fitted on labelled ones that aren't held out."""
    found = cut_lineage(document_features(docs, id_col, text_col))
    known = labels.select(F.col(id_col).alias("_lid"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & ~held_out("_lid"))
    return found, fit(found.join(known, F.col("_id") == F.col("_lid")), shrinkage=shrinkage, temper=temper)


def accepted(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Rows of ``docs`` with a score of ``threshold`` or more, all columns as they are; nothing is shuffled."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for a, b, texts in blocks(batch.column(at)):
                yield batch.slice(a, b - a).filter(pa.array(model.score(features(texts)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.7,
    shrinkage: float = 0.05,
    temper: float = 0.25,
) -> DataFrame:
    """Score every whole text: ``doc_id, held_out, score, predicted``.

    Learns from labelled rows that aren't held out (see ``held_out``); labels
    other than 0 and 1, null ids and labels without a document are ignored.
    Null and empty texts are scored like a text without words.  Null ids and
    repeated rows: one result per row; a document counts once per label row.
    Other columns are ignored.  No rows: no rows; no labels: all scores 0.5.
    ``temper`` scales the density gap: statistics of one text are not
    independent, and a full gap would be over-sure.
    """
    found, model = train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, shrinkage=shrinkage, temper=temper)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    scored = found.mapInArrow(run, f"doc_id {found.schema['_id'].dataType.simpleString()}, score double")
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
