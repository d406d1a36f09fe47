"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from voxquarry.llm import spelling

SCHEMA = "doc_id bigint, text string, word string, n bigint, form string, m int, key string"


def edits_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def brute(rows, drop=None, least=6, often=5, ratio=5):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop and h % drop == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= least:
                count[run] += 1
    words = {w: n for w, n in count.items() if n >= often}
    form, near = {}, {}
    for w, n in words.items():
        close = [x for x in words if edits_one(w, x)]
        near[w] = len(close)
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, near[w], words.get(form[w])))
    return sorted(out)


def grouped(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "c", 1, "c", 2, "c") for i, t in rows], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in spelling.spelling_variants(df, **more).collect())


def misspelt(rng, word):
    k, kind = rng.randrange(len(word)), rng.randrange(3)
    letter = rng.choice("abcdeéßø÷")
    return word[:k] + ("", letter, letter + word[k])[kind] + word[k + 1 :]


def corpus(rng, n_words, n_docs, syllables):
    stock = ["".join(rng.choices(syllables, k=rng.randint(2, 5))) for _ in range(n_words)]
    weights = [1 / (1 + k) for k in range(n_words)]
    rows = []
    for i in range(n_docs):
        words = rng.choices(stock, weights, k=120)
        words = [misspelt(rng, w) if rng.random() < 0.15 else w for w in words]
        words = [w.capitalize() if rng.random() < 0.1 else w for w in words]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("cell", [2048, 16])
def test_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(spelling, "CELL", cell)
    rows = corpus(random.Random(8), 120, 60, ["the", "on", "er", "ing", "ha", "é", "st", "ü"])
    # a path of two steps
    rows += [(1000 + k, "mountains " * 80 + "mountans " * 15 + "mountas " * 2) for k in range(4)]
    got = grouped(spark, rows, drop_every=19)
    assert got == brute(rows, 19)
    assert sum(r[1] is not None for r in got) > 20 and any(r[1] and r[1] != r[2] for r in got)


def test_one_hot_beginning(spark, monkeypatch):
    """A third and more of the words begin alike; slices of that group meet pair by pair."""
    monkeypatch.setattr(spelling, "CELL", 8)
    rng = random.Random(2)
    words = ["prefix" + "".join(rng.choices("ab", k=rng.randint(0, 5))) for _ in range(120)]
    rows = [(k, " ".join(words)) for k in range(5)]
    assert grouped(spark, rows) == brute(rows)


def test_odd_texts(spark):
    long = "abcdefghij" * 3000
    rows = [(None, None), (1, ""), (2, " \n 12 "), (None, "repeated " * 6), (None, "repeated " * 6), (3, "repeatd " * 7), (4, f"{long} {long}x " * 5)]
    rows += [(5, "ÀÉÎabc àéîabc " * 5), (6, "a×b÷cd axb÷cd " * 5), (7, "日本語word wordsé " * 9), (8, "aaaaaa aaaaaaa " * 30)]
    assert grouped(spark, rows) == brute(rows) and grouped(spark, rows, drop_every=2) == brute(rows, 2)
    assert grouped(spark, []) == [] and grouped(spark, [(1, None)]) == []


def test_recurrences():
    """Every kind of edit in one index, over more than one 64-bit word."""
    rng = random.Random(1)
    stock = sorted({"".join(rng.choices("abc", k=rng.randint(2, 6))) for _ in range(400)})
    index = spelling.Index(stock)
    for size in range(2, 7):
        some = [w for w in stock if len(w) == size]
        kinds, head = index.one_edit(some, size // 2)
        for q, sets in zip(some, zip(*[index.unpack(x) for x in (*kinds.values(), head)])):
            got = {k: {w for w, b in zip(stock, s) if b} for k, s in zip((*kinds, "head"), sets)}
            assert got["replaced"] == {w for w in stock if len(w) == size and edits_one(q, w)}
            assert got["shorter"] == {w for w in stock if len(w) == size - 1 and edits_one(q, w)}
            assert got["longer"] == {w for w in stock if len(w) == size + 1 and edits_one(q, w)}
            assert got["head"] == {w for w in stock if w.startswith(q[: size // 2])}
