"""Encoding against the tokenizers library, token files against a plain layout."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from voxquarry.llm import bpe, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, ids string, key string"


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(5)
    words = ["the", "Anding", "été", "x1y22", "!!??", "ßigkeit", "don't", "日本語", "<|endoftext|>", "áb", "ΑΣ", "\x1cq"]
    out = [None, "", " \n\t ", "a", " b c", "x<|startoftext|>y"]
    out += [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)]
    for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "a", "éà", "日本", "!?"):
        out += ["".join(rng.choices(letters, k=n)) + " end" for n in (63, 64, 65, 500, 5000)]
    return out


def expected(lib, text):
    ids = lib.encode(text or "", add_special_tokens=False).ids
    return ids, lib.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("limit,leaf", [(1 << 20, 1 << 16), (40, 100)])
def test_encode(spark, lib, limit, leaf):
    rows = [(i if i != 3 else None, t, "clash", "clash") for i, t in enumerate(texts())]
    rows += [rows[-1], rows[-1]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = bpe.encode(
        df, PATH, columns=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"), parallel_chars=limit, leaf_chars=leaf
    ).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t, *_ in rows:
        want.setdefault(i, []).append(expected(lib, t))
    for r in got:
        ids, decoded = want[r.doc_id].pop()
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == decoded
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_raw_ids(spark, lib):
    df = spark.createDataFrame([(i, t, "c", "c") for i, t in enumerate(texts())], SCHEMA)
    got = bpe.encode(df, PATH, columns=("n_tokens", "ids"), parallel_chars=600, leaf_chars=100).collect()
    assert {r.doc_id: r.ids for r in got} == {i: expected(lib, t)[0] for i, t in enumerate(texts())}
    assert all(len(r.ids) == r.n_tokens for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert bpe.encode(df, PATH).collect() == []
    assert token_files.read_all(spark, token_files.write_ids(df, PATH)).collect() == []


def test_all_white_space_characters(lib):
    c = bpe.codec(PATH)
    for ch in [*map(chr, range(0x250)), " ", " ", " ", "​", " ", " ", " ", "　", "﻿"]:
        text = f"ab{ch}cd {ch} {ch.upper()}Ab"
        assert c.encode_chunks(bpe.split_text(text))[0].tolist() == lib.encode(text, add_special_tokens=False).ids, repr(ch)


def test_token_files(spark, lib):
    rng = random.Random(3)
    docs = [(rng.randint(-50, 10**12), f"doc {i} the {'x' * (i % 7)}", "c", "c") for i in range(300)]
    docs += [(docs[0][0], "same id", "c", "c"), (None, "no id", "c", "c"), (None, None, "c", "c"), (7, None, "c", "c"), (9, "the " * 3000, "c", "c")]
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    path = token_files.write_ids(df, PATH, docs_per_part=50, shard_tokens=300)
    got = token_files.read_all(spark, path).collect()
    assert len(got) == len(docs)

    def key(k):
        return (k is not None, k or 0)

    order = sorted(docs, key=lambda d: key(d[0]))
    ids = {}
    for d in order:
        ids.setdefault(d[0], []).append([*lib.encode(d[1] or "", add_special_tokens=False).ids, 2])
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [d[0] for d in order]
    at = 0
    for r in got:
        crcs = {zlib.crc32(np.array(x, "<u4").tobytes()): len(x) for x in ids[r.doc_id]}
        assert r.start == at and crcs[r.ids_crc32] == r.n_tokens
        at += r.n_tokens
    asked = spark.createDataFrame([(docs[0][0],), (docs[5][0],), (5,), (None,)], "doc_id bigint")
    found = token_files.read_keys(spark, path, asked).collect()
    assert sorted(r.doc_id for r in found) == sorted([docs[0][0]] * 2 + [docs[5][0]])
    for r in found:
        assert np.frombuffer(r.ids, "<u4").tolist() in ids[r.doc_id]


def test_perfect_hash():
    for n in (1, 2, 5, 1000, 20_000):
        keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
        seeds = token_files.build_hash(keys)
        slots = token_files.find_slots(seeds, len(keys), keys)
        assert sorted(slots.tolist()) == list(range(len(keys)))


def test_cache_rolls_over(lib):
    """Generations of a few bytes give the same ids as an endless cache."""
    with bpe.codec(PATH) as c:
        c.limit = 5
        rng = random.Random(3)
        words = ["the", "été", "日本", "don't", "x" * 300, "a!b"]
        for _ in range(40):
            some = rng.choices(words, k=3)
            cache = c.remember(set(some), lambda ids, offsets: [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])])
            assert [cache[w] for w in some] == [lib.encode(w, add_special_tokens=False).ids for w in some]
            assert len(c.cache) <= 3 + len(c.old)
    assert not c.__dict__  # nothing is held after the block
