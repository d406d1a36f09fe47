"""Operators on documents: hand cases, odd rows, brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from voxquarry.llm import decontaminate, language_id, line_dedup, quality_classifier, quality_rules, warc

SCHEMA = "doc_id bigint, text string, source string, lang string, _text string, body string, words int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, lang, "x", "y", 1) for i, t, s, lang in rows], SCHEMA).repartition(3)


def test_quality_rules(spark):
    shared = "Terms of use 2024 apply here"
    rows = [(i, f"{shared}\n" + " ".join(f"w{i}x{k}" for k in range(12)), "a", None) for i in range(20)]
    rows += [(100, shared + "\nmore own", "a", None), (101, shared.upper().replace("2024", "1999") + "\n" + " ".join("abcdefgh"), "a", None)]
    rows += [(102, shared + "\n" + " ".join("abcdefgh"), "b", None), (103, shared + "\n" + " ".join("abcdefgh"), None, None)]
    rows += [(104, None, "a", None), (105, "", None, None), (106, "a b c d e x a b c d e", "b", None), (107, "l # one\nl # one\n\n l # one", "b", None)]
    rows += [(None, "no id " * 10, "b", None), (5, rows[5][1], "a", None), (108, "z y x w v " * 3, "b", None)]
    got = {}
    for r in quality_rules.apply_rules(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows) and len(got[5]) == 2 and len(set(got[5])) == 1
    for i in range(20):
        assert got[i][0].kept and got[i][0].removed_words == 6, got[i]
    assert not got[100][0].kept and got[100][0].base_failed  # 8 words
    assert got[101][0].removed_words == 6 and got[101][0].kept
    assert got[102][0].removed_words == got[103][0].removed_words == 0
    assert got[104][0].n_words == got[105][0].n_words == 0 and got[104][0].base_failed
    assert got[106][0].n_repeat_words == 10 and got[106][0].base_failed
    assert (got[107][0].n_dup_lines, got[107][0].n_symbols) == (1, 3)
    assert got[108][0].n_repeat_words == 15 and got[108][0].word_chars == 15
    assert got[None][0].n_words == 20


def test_line_limits(spark):
    """Copies are documents of their own, and the limit of a large host is the absolute one."""
    page = "a line of the page\n" + " ".join(f"own{k}" for k in range(12))
    own = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(1000)]  # digits are all alike in lines
    rows = [(i, page, "h", None) for i in range(15)] + [(100 + i, " ".join(f"{x}{chr(97 + k)}" for k in range(12)), "h", None) for i, x in enumerate(own)]
    for limit, hot in ((10, True), (1000, False)):
        got = {r.doc_id: r for r in quality_rules.apply_rules(docs(spark, rows), max_docs=limit).collect()}
        assert all((got[i].removed_lines, got[i].removed_words, got[i].kept) == ((2, 17, False) if hot else (0, 0, True)) for i in range(15))
        assert all(got[100 + i].kept and got[100 + i].removed_lines == 0 for i in range(1000))


def naive_rules(text):
    words = (text or "").split()
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = {g for g in grams if grams.count(g) > 1}
    return len({i + k for i, g in enumerate(grams) if g in many for k in range(5)})


def test_repeat_words(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices("abc", k=rng.randint(0, 60))), "s", None) for i in range(60)]
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.apply_rules(docs(spark, rows)).collect()}
    assert got == {i: naive_rules(t) for i, t, *_ in rows}


def naive_lines(rows):
    """Later windows of three solid lines, and the text left."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines = text.split("\n")
        solid = [(k, x.strip()) for k, x in enumerate(lines) if x.strip()]
        gone = set()
        for p in range(len(solid) - 2):
            key = tuple(x for _, x in solid[p : p + 3])
            if key in seen:
                gone |= {solid[p + k][0] for k in range(3)}
            seen.add(key)
        out[i] = (len(solid), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_line_dedup(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choices(["a", "b", " a ", "", "c"], k=rng.randint(0, 14)))) for i in range(40)]
    got = line_dedup.dedup_lines(docs(spark, [(i, t, "s", None) for i, t in rows])).collect()
    want = naive_lines(rows)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.clean_text) for r in got} == want
    assert set(got[0].asDict()) > {"source", "lang", "_text", "n_spans"}


def test_line_dedup_odd_rows(spark):
    same = "1\n2\n3\n4"
    rows = [(None, same, "s", None), (1, same, "s", None), (1, same, "s", None), (2, None, "s", None), (3, "", "s", None), (4, "x\n" + same, "s", None)]
    got = sorted(line_dedup.dedup_lines(docs(spark, rows)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.clean_text for r in got] == [same, "", "", None, "", "x"]
    assert [r.n_spans for r in got] == [0, 1, 1, 0, 0, 1] and [r.n_words for r in got] == [4, 4, 4, 0, 0, 5]
    assert [r.n_left for r in got] == [4, 0, 0, 0, 0, 1]
    assert line_dedup.dedup_lines(docs(spark, [])).collect() == []
    assert quality_rules.apply_rules(docs(spark, [])).collect() == []


def test_language(spark):
    rng = random.Random(2)
    parts = {"en": ["the", "thing", "ation", "was"], "de": ["der", "schön", "ung", "zwei"], "ru": ["это", "жизнь", "что"]}
    rows = [(i, " ".join(rng.choices(parts[k], k=30)), "s", k) for i, k in enumerate(list(parts) * 40)]
    train = docs(spark, [*rows, (900, None, "s", "en"), (901, "nolang", "s", None)])
    model = language_id.train(language_id.learnable(train))
    assert model.langs == ["de", "en", "ru"]
    mixed = " ".join(rng.choices(parts["en"], k=20)) + ". " + " ".join(rng.choices(parts["de"], k=40))
    ask = [(1, mixed, "s", None), (2, None, "s", "en"), (3, "12 !? 3", "s", "de"), (None, "жизнь", "s", None), (5, "", "s", None), (5, "", "s", None)]
    got = language_id.identify(docs(spark, ask + [(6, "der schön ung " * 9000, "s", None)]), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7
    assert [(s.lang, mixed[s.start : s.end].split()[0] in parts[s.lang]) for s in by[1].spans] == [("en", True), ("de", True)]
    assert by[1].lang_pred == "de" and 0.5 < by[1].score < 1
    assert all((by[i].lang_pred, by[i].score, by[i].spans) == ("und", 0.0, []) for i in (2, 3, 5))
    assert by[None].lang_pred == "ru" and by[6].lang_pred == "de"
    empty = language_id.train(docs(spark, []))
    assert {r.lang_pred for r in language_id.identify(docs(spark, ask), empty).collect()} == {"und"}
    assert language_id.identify(docs(spark, []), model).collect() == []


def test_rare_language_and_copies_in_the_sample(spark):
    rows = [(i, "the same thing was copied", "s", "en") for i in range(600)] + [(600 + i, "das schöne ding", "s", "de") for i in range(2)]
    model = language_id.train(docs(spark, rows), max_docs=100)
    assert model.langs == ["de", "en"]
    got = language_id.identify(docs(spark, [(1, "schöne ding", "s", None)]), model).collect()
    assert got[0].lang_pred == "de"
    assert language_id.per_language({"a": 1000, "b": 3, "c": 500}, 103) == 50
    assert language_id.per_language({"a": 10, "b": 3}, 100) == 10 and language_id.per_language({}, 5) == 0


def test_viterbi_is_best():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n, k = int(rng.integers(1, 7)), int(rng.integers(1, 4))
        scores = rng.normal(size=(n, k)).astype(np.float32)
        got = language_id.viterbi(np.concatenate([scores, scores]), np.repeat([0, 2], n), 3, 0.7)

        def value(path):
            return sum(scores[i, p] for i, p in enumerate(path)) - 0.7 * sum(a != b for a, b in zip(path, path[1:]))

        best = max(value(p) for p in np.ndindex(*[k] * n))
        assert abs(value(got[:n]) - best) < 1e-5 and abs(value(got[n:]) - best) < 1e-5


def test_held_out_accuracy(spark):
    tables = "/root/testdata/sf0.01"
    try:
        d, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    except Exception:
        pytest.skip("supplied tables are not here")
    scored = quality_classifier.classify(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in scored) > 0.97 * len(scored)
    model = language_id.train(language_id.learnable(d))
    named = language_id.identify(d, model, with_spans=False).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in named if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang == r.lang_pred for r in held) > 0.99 * len(held)


def test_classifier_odd_rows(spark):
    rows = [(i, ("good plain words number %d again" % i) if i % 2 else "!!! ### $$$ %d" % i, "s", None) for i in range(80)]
    rows += [(200, None, "s", None), (201, "", "s", None), (None, "", "s", None), (3, "good plain words", "s", None)]
    labels = spark.createDataFrame([(i, i % 2, 0, 9) for i in range(80)] + [(None, 1, 0, 9), (5, None, 0, 9), (7000, 1, 0, 9)], "doc_id bigint, quality int, toxic int, text int")
    got = quality_classifier.classify(docs(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 80)
    blank = {r.score for r in got if r.doc_id in (200, 201, None)}
    assert len(blank) == 1
    none = labels.limit(0)
    assert {r.score for r in quality_classifier.classify(docs(spark, rows), none).collect()} == {0.5}
    assert quality_classifier.classify(docs(spark, []), labels).collect() == []


def test_decontaminate(spark):
    rng = random.Random(6)
    vocab = [f"w{k}" for k in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(8, 30)))) for i in range(12)]
    bench = spark.createDataFrame([*[(i, t, 1) for i, t in items], (50, None, 1), (51, "too short", 1), (52, "", 1)], "item_id bigint, text string, start int")
    rows = []
    for d in range(60):
        i, t = rng.choice(items)
        words = t.split()
        for _ in range(rng.randint(0, max(1, len(words) // 4))):
            p = rng.randrange(len(words))
            if rng.random() < 0.4:
                words[p] = rng.choice(vocab)
            elif rng.random() < 0.5:
                words.pop(p)
            else:
                words.insert(p, rng.choice(vocab))
        text = rng.choices(vocab, k=rng.randint(0, 20)) + [w.upper() + "," for w in words] + rng.choices(vocab, k=rng.randint(0, 20))
        rows.append((d, " ".join(text), "s", None))
    rows += [(100, None, "s", None), (101, "", "s", None), (None, items[0][1], "s", None), (None, items[0][1], "s", None)]
    want = decontaminate.brute_force([(r[0], r[1]) for r in rows], items)
    for per_pass in (5000, 5):
        got = decontaminate.find_leaks(docs(spark, rows), bench, items_per_pass=per_pass).collect()
        found = {(r.doc_id, r.item_id) for r in got}
        assert found <= want and len(found) >= 0.98 * len(want) and len([r for r in got if r.doc_id is None]) == 2
    assert decontaminate.find_leaks(docs(spark, []), bench).collect() == []
    assert decontaminate.find_leaks(docs(spark, rows), bench.limit(0)).collect() == []


def edited(rng, words, k, vocab):
    words = list(words)
    for _ in range(k):
        p, kind, new = rng.randrange(len(words)), rng.randrange(3), rng.choice(vocab)
        if kind == 0:
            words[p] = new
        elif kind == 1:
            words.insert(p, new)
        elif len(words) > 1:
            words.pop(p)
    return words


@pytest.mark.parametrize("m", [8, 10, 15, 20, 38, 59])
def test_keys_decide(m):
    """Keys find windows at the 20 % limit, and unrelated windows of frequent words seldom share one."""
    rng = random.Random(m)
    vocab = [int(x) for x in np.random.default_rng(m).integers(1, 2**62, 5000)]
    weights = [1 / (k + 2.7) for k in range(5000)]  # the most frequent word is every twentieth
    sampler = decontaminate.Sampler.reaching(0.999, 0.35, 2, 12)

    def rows(texts):
        return np.array([(t + [int(decontaminate.END)] * m)[:m] for t in texts], np.uint64)

    items = [rng.choices(vocab, weights, k=m) for _ in range(400)]
    near = [edited(rng, t, int(m * 0.2), vocab) for t in items]
    keys, usable = sampler.keys(rows(items))
    assert usable.mean() > 0.9
    shared = ((keys == sampler.keys(rows(near))[0]) & usable).any(axis=1)
    apart = ((keys == np.roll(keys, 1, axis=0)) & usable).any(axis=1)
    assert shared.mean() >= 0.95 and apart.mean() < 0.05
    # a text of the end alone has no key
    assert not sampler.keys(rows([[]]))[1].any()


def test_null_item(spark):
    item = " ".join(f"w{k}" for k in range(12))
    bench = spark.createDataFrame([(None, item), (-1, "other " * 3 + item[::-1])], "item_id bigint, text string")
    got = decontaminate.find_leaks(docs(spark, [(1, "so " + item, "s", None), (2, "x " * 2_000_000 + item, "s", None)]), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, None), (2, None)]


def test_warc(spark):
    big, small = "<p>" + "x" * 120 + "é", "tiny"
    rows = [(4, "http://a", big), (2, "http://b\r\nX: y", big), (9, None, big), (7, "u", small), (1, "u", small), (3, "u", None), (5, "u", ""), (None, "u", big), (2, "again", big), (8, "u", "other" * 40)]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id bigint, url string, html string, digest string, header string").repartition(3)
    path = warc.write_archive(pages)
    got = warc.read_archive(spark, path).collect()
    assert len(got) == len(rows) and all(r.verified for r in got)
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=str)
    want = [(4, "revisit", 2), (2, "response", None), (9, "revisit", 2), (7, "response", None), (1, "response", None), (3, "response", None), (5, "response", None), (None, "response", None), (2, "response", None), (8, "response", None)]
    assert kinds == sorted(want, key=str)
    body = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        raw = body[r.page_id] if r.page_id is not None else big.encode()
        assert r.payload_digest == hashlib.sha256(raw).hexdigest() and r.payload_bytes == len(raw) and bytes(r.payload) == raw
        record = bytes(r.record)
        head, rest = record.split(b"\r\n\r\n", 1)
        size = int(head.split(b"Content-Length: ")[1])
        assert rest[size:] == b"\r\n\r\n" and rest[:size].endswith(raw if r.record_type == "response" else b"\r\n\r\n")
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    assert warc.read_archive(spark, warc.write_archive(pages.limit(0))).collect() == []
