"""Quality scores against plain features and a plain density formula with explicit inverses."""

import math
import random
import re

import numpy as np

from voxquarry.llm import quality_classifier as qc


def plain_features(text):
    b = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", b) if w]
    count = lambda members: sum(c in members for c in b)
    upper, lower, digit = count(range(65, 91)), count(range(97, 123)), count(b"0123456789")
    wide = count(range(128, 256))
    size = sum(map(len, words))
    grams = [tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    lines = b.count(b"\n") + 1  # the end of the text ends a line
    filled = [x for x in b.split(b"\n") if x]
    dup = len(filled) - len(set(filled)) if b"\n" in b else 0
    accents = len(re.findall(rb"\xc3[\x80-\x9e]", b))
    again = sum(x == y for x, y in zip(words, words[1:]))
    share = lambda a, n: math.log((a + 0.5) / (n + 1))
    n = len(words)
    return [
        math.log1p(n), share(size, n), share(upper, upper + lower + wide), share(digit, size), share(count(b".,;:"), n),
        share(count(b"!?"), n), share(count(b"|<>[]{}\\"), n), share(count(b"#*$%&@~^=+_/"), n), share(wide, size),
        share(len(set(words)), n), share(again, n), share(len(grams) - len(set(grams)), len(grams)), share(lines, n),
        share(dup, lines), share(accents, wide),
    ]


def texts(n=200):
    rng = random.Random(12)
    stock = ["the", "Of", "ÉTÉ", "naïve", "a1b2", "!!", "x|y", "#tag", "word,", "end.", "日本", "{}", "same", "same"]
    out = [None, "", " \t ", "\n\n", "one", "a\na\na", "Ünï " * 400, "x" * 3000]
    while len(out) < n:
        seps = rng.choice([" ", "\n", "  ", " \r\n"])
        out.append(seps.join(rng.choices(stock[: rng.randint(2, len(stock))], k=rng.randint(1, 60))))
    return out


def test_features():
    some = texts()
    got = qc.features([(t or "").encode() for t in some])
    want = np.array([plain_features(t) for t in some])
    assert np.abs(got - want).max() < 1e-12


def test_scores(spark):
    """The whole fit and score, with explicit inverses and determinants."""
    some = texts()
    rng = random.Random(2)
    quality = {i: int(rng.random() < (0.8 if t and "the" in t else 0.3)) for i, t in enumerate(some) if rng.random() < 0.8}
    docs = spark.createDataFrame([(i, t, "c", 9) for i, t in enumerate(some)], "doc_id bigint, text string, label string, score int").repartition(4)
    labels = spark.createDataFrame([*quality.items(), (None, 1), (3, None), (5, 7), (9999, 1)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in qc.classify(docs, labels).collect()}
    x = np.array([plain_features(t) for t in some])
    learnt = {c: x[[i for i, q in quality.items() if q == c and not got[i].held_out]] for c in (0, 1)}
    n = {c: len(v) for c, v in learnt.items()}
    cov = {c: np.cov(v.T, bias=True) for c, v in learnt.items()}
    pooled = np.diag(np.maximum(np.diag(sum(n[c] * cov[c] for c in (0, 1)) / sum(n.values())), 1e-3))
    dens = {}
    for c in (0, 1):
        s = 0.95 * cov[c] + 0.05 * pooled + 1e-6 * np.eye(15)
        d = x - learnt[c].mean(axis=0)
        dens[c] = -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * math.log(np.linalg.det(s))
    gap = np.clip(0.25 * (dens[1] - dens[0]) + math.log((n[1] + 1) / (n[0] + 1)), -60, 60)
    want = 1 / (1 + np.exp(-gap))
    assert max(abs(got[i].score - want[i]) for i in range(len(some))) < 1e-6
    assert all(r.predicted == int(r.score >= 0.7) for r in got.values())
