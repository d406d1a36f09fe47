"""Operators on groups of documents against brute force, and the pipeline against plain stages."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from voxquarry.llm import graph, ngram_join, suffix_dedup, tokens

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, label string, rep string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "c", "c", "c") for i, t in rows], SCHEMA).repartition(4)


def grams(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def naive_classes(rows):
    sets = {i: grams(t) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = root(x), root(y)
                label[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(rng, base, n, changes):
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, changes)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
        yield " ".join(words)


def family_rows(seed):
    rng = random.Random(seed)
    vocab = [f"v{k}" for k in range(3000)]
    texts = []
    passage = rng.choices(vocab, k=40)
    base = rng.choices(vocab, k=120)
    texts += near_copies(rng, base, 60, 5)  # one large family, borderline links too
    texts += near_copies(rng, rng.choices(vocab, k=20), 20, 2)
    for n in (10, 30, 60):  # one passage in many texts, some of it mostly passage
        texts += [" ".join([*passage, *rng.choices(vocab, k=rng.randint(0, n))]) for _ in range(30)]
    texts += [" ".join(rng.choices(vocab, k=rng.randint(1, 80))) for _ in range(60)]
    texts += ["one two", "ONE two", "one  two three", "", "   ", texts[0], texts[0].upper(), "one two three"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("share,hot,later", [(0.3, 8, 32), (0.3, 2, 3), (1.0, 3, 5)])
def test_ngram_join(spark, share, hot, later):
    rows = family_rows(hot)
    got = ngram_join.similar_documents(docs(spark, rows), share=share, hot_groups=hot, hot_groups_later=later).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == naive_classes(rows)


def almost_alike(n, shared=80, size=92):
    """Texts that share their first words: Jaccard 76 / 100 for 80 of 92, so none are linked."""
    base = [f"w{k}" for k in range(shared)]
    return [(i, " ".join(base + [f"u{i}x{k}" for k in range(size - shared)])) for i in range(n)]


def test_almost_alike(spark):
    """No links, a class of copies among them, and links that only the frequent tokens show."""
    rows = almost_alike(250)
    rows += [(1000 + k, rows[3][1] + " more") for k in range(3)]
    rng = random.Random(4)
    base = rows[0][1].split()[:80]
    rows += [(2000 + k, " ".join(base[: 80 - rng.randint(0, 9)] + [f"y{k}z{m}" for m in range(rng.randint(0, 9))])) for k in range(150)]
    for hot, later in ((8, 32), (2, 3)):
        got = ngram_join.similar_documents(docs(spark, rows), hot_groups=hot, hot_groups_later=later).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == naive_classes(rows)


@pytest.mark.parametrize("n", [250, 500, 1000])
def test_work_on_almost_alike(n):
    """Rows grow in proportion: none are left by the first bound; of those that it can't tell apart, groups are asked, not documents."""
    for shared, kind in ((80, "apart"), (82, "near")):
        sets = tokens.shingle_sets([t.encode() for _, t in almost_alike(n, shared)])
        tok = tokens.mix(np.concatenate(sets)).astype(np.uint32)
        q = np.repeat(np.arange(n), [len(s) for s in sets])
        ids, _, c = ngram_join.shared_elsewhere(tok, q, q, np.full(len(q), 91), 5)
        assert len(ids) == n and (c == shared - 4).all()
        left = (1.8 * c >= 0.99 * 0.8 * (88 + 88)).sum()
        assert left == (0 if kind == "apart" else n)
        size = int(n**0.5)
        found = ngram_join.group_overlaps(tok, q, q // size, np.full(len(q), 1), np.full(len(q), 1))
        assert len(found[0]) <= n * (n // size + 1)
        own = (found[1] == found[0] // size)
        assert (found[2][~own] == shared - 4).all()


def test_ngram_join_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(5, text), (5, text), (3, text), (None, text), (8, None), (9, None), (4, "unlike"), (4, text + " end")]
    got = ngram_join.similar_documents(docs(spark, rows)).collect()
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)
    want = [(3, 26, 3), (4, 1, 3), (4, 27, 3), (5, 26, 3), (5, 26, 3), (8, 0, 8), (9, 0, 9), (None, 26, None)]
    assert [x for x in found if x[:2] != (4, 1)] == [x for x in want if x[:2] != (4, 1)] and len(found) == len(want)
    assert ngram_join.similar_documents(docs(spark, [])).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 200)] + [(300, k) for k in range(301, 330)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 103)}, **{i: 300 for i in range(300, 330)}}


def naive_removal(rows, span):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - span + 1):
            w = b[s : s + span]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - span + 1):
            if first[b[s : s + span]] < i:
                gone[s : s + span] = [True] * span
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeat_rows(seed):
    rng = random.Random(seed)
    words = [f"{''.join(rng.choices('abcé', k=rng.randint(1, 6)))}" for _ in range(50)]

    def text(n):
        return " ".join(rng.choices(words, k=n))

    shared = [text(20) for _ in range(4)]
    rows = []
    for i in range(80):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(shared)
            a = rng.randint(0, 20)
            parts += [p[a : a + rng.randint(30, 120)], text(rng.randint(0, 10))]
        rows.append((i * 7 % 80, "".join(parts)))
    rows += [(90, "ab" * 200), (91, "x" + "ab" * 60), (92, "a" * 300), (93, "a" * 70), (94, "q"), (95, ""), (96, rows[3][1]), (97, "short copy"), (98, "short copy"), (99, "a" * 50)]
    return rows


def test_suffix_dedup(spark):
    rows = repeat_rows(2)
    got = suffix_dedup.remove_repeats(docs(spark, rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == naive_removal(rows, 50)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_suffix_dedup_odd_rows(spark):
    a, b = "first long text " * 6, "another long text " * 6
    rows = [(1, a), (2, a + b), (2, b), (2, b), (None, a), (None, b), (3, None), (4, b + "tail")]
    got = suffix_dedup.remove_repeats(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r.n_removed == 0 for r in got if r.doc_id in (None, 1, 3))
    both = sorted((r.n_bytes, r.n_removed) for r in got if r.doc_id == 2)
    assert both[:2] == [(len(b), 0)] * 2 and both[2][1] >= len(a)
    assert [r.n_removed for r in got if r.doc_id == 4][0] >= len(b)
    assert suffix_dedup.remove_repeats(docs(spark, [])).collect() == []


def test_suffix_sort():
    rng = np.random.default_rng(5)
    for letters in (2, 3, 40):
        buf = rng.integers(0, letters, 3000).astype(np.uint8)
        pos = rng.integers(0, 2900, 700)
        size = rng.integers(1, 90, 700)
        group = np.sort(rng.integers(0, 12, 700))
        s = suffix_dedup.Suffixes(buf, pos, size)
        order = s.sort(group)
        text = [buf[p : p + n].tobytes() for p, n in zip(pos, size)]
        for g in range(12):
            a, b = np.searchsorted(group, [g, g + 1])
            assert [text[i] for i in order[a:b]] == sorted(text[a:b])
        run = s.equal_runs(order, group)
        for k in range(1, 700):
            same = group[k] == group[k - 1] and text[order[k]] == text[order[k - 1]]
            assert (run[k] == run[k - 1]) == same


def test_collisions_are_found(monkeypatch):
    """With a hash that calls everything equal the bytes still decide."""
    buf = np.frombuffer(b"abcabdabc", np.uint8)
    s = suffix_dedup.Suffixes(buf, np.array([0, 3, 6]), np.array([3, 3, 3]))
    monkeypatch.setattr(s, "agree", lambda a, b, n: np.ones(len(a), bool))
    group = np.zeros(3, np.int64)
    order = s.sort(group)
    run = s.equal_runs(order, group)
    assert [bytes(buf[s.pos[i] : s.pos[i] + 3]) for i in order] == [b"abc", b"abc", b"abd"] and run.tolist() == [0, 0, 1]


def around(anchor, n, seed):
    """Stretches of one anchor with other bytes on both sides, the last one equal to the first."""
    rng = np.random.default_rng(seed)
    text = rng.integers(97, 123, (n, 80)).astype(np.uint8)
    text[:, 30:50] = np.frombuffer(anchor, np.uint8)
    text[-1] = text[0]
    text[-2, 25:75] = text[1, 25:75]  # one window
    text[-3, 29:80] = text[2, 29:80]  # two windows
    return np.arange(n) + 5, text.ravel(), np.full(n, 30), np.full(n, 30), np.full(n, 77)


@pytest.mark.parametrize("windows", [1 << 18, 1000])
def test_only_recurring_windows_are_sorted(monkeypatch, windows):
    """Under a frequent anchor (F1) the sort gets what several documents hold, not every window."""
    n, seen, real = 500, [], suffix_dedup.Suffixes.sort
    monkeypatch.setattr(suffix_dedup, "WINDOWS", windows)
    monkeypatch.setattr(suffix_dedup.Suffixes, "sort", lambda self, group: seen.append(len(group)) or real(self, group))
    found = suffix_dedup.dup_windows(*around(b"a passage of twenty.", n, 3), 50)
    got = sorted(zip(*[x.tolist() for x in found]))
    assert got == [(n - 3, 29, 80), (n - 2, 25, 75), (n - 1, 0, 80)]
    assert sum(seen) <= 8


def test_rows_dealt_do_not_follow_blocks(spark, monkeypatch):
    """A task deals a range one row for what it gathered, not one for each block of text (F1)."""
    rng, sent = np.random.default_rng(4), []
    rows = [(i, rng.integers(97, 123, 300_000).astype(np.uint8).tobytes().decode()) for i in range(10)]
    df = spark.createDataFrame(rows, "id bigint, text string").coalesce(1)
    real = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **k: sent.append(real(self, *a, **k)) or sent[-1])
    suffix_dedup.shared_anchors(df, 50, 8)
    count = sent[0].where("kind = 0").groupBy("r").count().collect()
    assert len(count) == 8 and all(r["count"] == 1 for r in count)


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    vocab = ["the", "ation", "thing", "ered", "onand", "inthe", "was", "of", "and", "ander", "resting", "ofthe", "tiona"]
    vocab += ["".join(rng.choices("aeiounrstl", k=rng.randint(3, 9))) for _ in range(300)]

    def prose(n):
        words = rng.choices(vocab, k=n)
        return " ".join(words[:n // 2]) + ". " + " ".join(words[n // 2 :]) + "."

    item = " ".join(rng.choices(vocab, k=20))
    good = [prose(rng.randint(40, 90)) for _ in range(60)]
    rows = list(enumerate(good))
    rows += [(100, good[0]), (101, good[1].replace("the", "a", 1)), (102, prose(30) + " " + item + " " + prose(20))]
    lines = [prose(12) for _ in range(6)]
    rows += [(103, "\n".join(lines)), (104, "\n".join(lines)), (105, prose(60) + "\n" + "\n".join(lines[:3]) + "\n" + prose(50))]
    junk = [" ".join(w.upper() + "###" for w in rng.choices(vocab, k=40)) for _ in range(40)]
    rows += [(200 + k, t) for k, t in enumerate(junk)]
    rows += [(300, "Ab ünï the")]
    df = docs(spark, rows)
    df.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 200), 0) for i, _ in rows if i < 60 or 200 <= i < 300]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == now.columns
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '')}")
        now = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '')}")
        seen.append({r.doc_id: r for r in now.collect()})
    first, second, third, fourth, last = seen
    assert not any(200 <= i < 300 for i in first) and set(range(60)) <= set(first) and {100, 101, 103, 104} <= set(first)
    assert 104 not in second and 103 in second and second[105].text.count("\n") == 1 and second[105].n_chars == len(second[105].text)
    assert 100 not in third and 101 not in third and {0, 1, 102} <= set(third)
    assert set(third) - set(fourth) == {102} and set(last) == set(fourth)
    assert all(len(r.ids) == r.n_tokens > 0 for r in last.values())
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(last)


def test_line_stage_keeps_own_text(spark):
    """A refrain or a mostly copied page loses the covered lines, not its own text."""
    verse = ["first line of it", "second line of it", "third line of it"]
    page = [f"line {k} of a page that is copied" for k in range(9)]
    rows = [(1, "\n".join(verse * 4)), (2, "\n".join(page)), (3, "\n".join([*page, "words of its own"])), (4, "\n".join(page)), (5, None), (6, "")]
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.own_lines(spark, docs(spark, rows), "").collect()}
    want = {1: "\n".join(verse), 2: "\n".join(page), 3: "words of its own", 5: None, 6: ""}
    assert got == {i: (t, len(t or "")) for i, t in want.items()}


def repeated_ids():
    one, two, three = (" ".join(f"{c}{k}" for k in range(30)) for c in "abc")
    return [(3, one), (5, one), (5, two), (5, None), (9, two), (9, two), (7, three), (7, three), (None, three), (None, three)]


def test_texts_of_one_id(spark):
    got = ngram_join.similar_documents(docs(spark, repeated_ids())).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(
        [(3, 3), (5, 3), (5, 3), (5, 3), (9, 3), (9, 3), (7, 7), (7, 7), (None, None), (None, None)], key=str
    )


def test_pipeline_texts_of_one_id(spark):
    (_, one), _, (_, two), *_, (_, three) = rows = repeated_ids()
    got = corpus_pipeline.one_of_each(spark, docs(spark, rows), "")
    assert got.columns == SCHEMA.replace(",", "").split()[::2]
    want = [(3, one), (5, None), (5, two), (7, three), (None, three), (None, three)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_short_texts_with_one_hot_shingle(spark, monkeypatch):
    """One of two shingles in common makes no link, so the round without hot tokens isn't needed."""
    limits, matching = [], ngram_join.matching
    monkeypatch.setattr(ngram_join, "matching", lambda parts, limit, labelled: limits.append(limit) or matching(parts, limit, labelled))
    rows = [(k, f"posted by the same user x{k}") for k in range(100)] + [(100, "posted by the same user x7")]
    got = ngram_join.similar_documents(docs(spark, rows), share=1.0).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: 7 if k == 100 else k for k in range(101)}
    assert limits and None not in limits


def test_pipeline_rows_and_columns(spark, tmp_path):
    """A null or shared id doesn't hide or spread a leak; a user's columns come through every stage."""
    item = " ".join(f"item{k}" for k in range(20))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean, leak = " ".join(f"own{k}" for k in range(40)), "before " + item + " after"
    rows = [(None, leak), (None, clean), (7, leak), (7, clean), (8, clean + " more"), (9, None)]
    cols = ["n_words", "n_lines", "n_removed", "n_spans", "n_left", "clean_text", "_key", "user", "gone", "key"]
    df = spark.createDataFrame([(i, t, len(t or ""), *[f"{c} {k}" for c in cols]) for k, (i, t) in enumerate(rows)],
                               "doc_id bigint, text string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in cols))
    mine = {(r.doc_id, r.text): [r[c] for c in cols] for r in df.collect()}
    for stage in (corpus_pipeline.no_benchmark, corpus_pipeline.own_lines, corpus_pipeline.one_of_each):
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns
        got = {(r.doc_id, r.text): [r[c] for c in cols] for r in out.collect()}
        assert all(mine[k] == v for k, v in got.items())
        if stage is corpus_pipeline.no_benchmark:
            assert set(got) == {(None, clean), (7, clean), (8, clean + " more"), (9, None)}
        if stage is corpus_pipeline.own_lines:
            assert set(got) == set(mine)
