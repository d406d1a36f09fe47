"""BPE encoding and decoding with the merges of a public tokenizer file.

A text is a sequence of chunks between white space; no merge crosses one, so a
text's ids are the ids of its chunks in order.  Plain chunks are merged here,
all new ones of a batch in lockstep; anything unusual (rare scripts, special
tokens, odd control characters) goes through the tokenizers library.

Long unsplit words are encoded by tree concatenation: halves are encoded on
their own, then a window around each join is encoded again and grows until it
shares a token with both sides.  A token sequence is the encoding of its text
exactly if every two neighbours are, so one shared token on each side makes
the splice exact.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import json
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, spread

LEAF = 64  # bytes of a word that are merged at once
CACHE = 48 << 20  # bytes in a generation of a task's cache
SLICE = 2 << 20  # characters handled between two output batches
WHITE = "\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PLAIN = "!-~\u00a1-\u012f\u0131-\u017f"
NONE = 1 << 24  # above the rank of any merge


class Codec:
    """Encoder of one tokenizer file; one per running task.

    Workers are reused by later stages, so at the end of its ``with`` block a
    codec frees its tables and its cache and hands the pages back to the system.
    """

    def __enter__(self) -> Codec:
        return self

    def __exit__(self, *_) -> None:
        self.__dict__.clear()
        gc.collect()
        with suppress(OSError, AttributeError):  # only where the C library can
            ctypes.CDLL(None).malloc_trim(0)

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or model["end_of_word_suffix"] != "</w>":
            raise ValueError(f"{path}: not a lower-casing BPE with word ends")
        vocab = model["vocab"]
        self.vocab, self.added = vocab, {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.ids = 1 + max(max(vocab.values()), max(self.added, default=0))
        self.special = [a["content"] for a in spec["added_tokens"]]
        self.words = regex.compile(split["pattern"]["Regex"] + r"|\n")
        #: characters for which normalising is lower() and categories are settled
        self.plain = regex.compile("[" + PLAIN + "]+")
        self.plain_lines = regex.compile("[" + PLAIN + r"\n]+")
        letters = byte_letters()
        self.byte = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + "</w>"] for c in letters], np.int64)
        self.value = {c: i for i, c in enumerate(letters)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.by_rank = key[order], order.astype(np.int64), made
        self.width = np.ones(self.ids, np.int64)
        self.width[made] = [len((a + b).removesuffix("</w>")) for a, b in pairs]
        self.cache: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.limit, self.held = CACHE, 0

    @cached_property
    def tokens(self) -> dict[int, str]:
        return {i: t for t, i in self.vocab.items()} | self.added

    @cached_property
    def digits(self) -> dict[int, str]:
        return {i: str(i) for i in self.tokens}

    def ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or NONE."""
        k = a << 20 | b
        at = np.searchsorted(self.key, k)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == k, self.rank[at], NONE)

    def merge_flat(self, pieces: list[tuple[bytes, bool]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and all ids of byte strings; the flag says whether the word ends with them.

        All pieces advance together: each round does the first merge of lowest
        rank in every piece that still has one.
        """
        lens = np.array([len(p) for p, _ in pieces], np.int64)
        buf = np.frombuffer(b"".join(p for p, _ in pieces), np.uint8)
        return self.merge_bytes(buf, lens, np.array([f for _, f in pieces], bool))

    def merge_bytes(self, buf: np.ndarray, lens: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for byte strings back to back."""
        sym = self.byte[buf]
        ends = np.cumsum(lens) - 1
        sym[ends[final]] = self.last[buf[ends[final]]]
        owner = np.repeat(np.arange(len(lens)), lens)
        rank = np.full(len(sym), NONE, np.int64)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self.ranked(sym[inner], sym[inner + 1])
        done_sym, done_owner = [], []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            low = np.minimum.reduceat(rank * len(sym) + np.arange(len(sym)), starts)
            open_, at = low < NONE * len(sym), low % len(sym)
            if not open_.all():
                count = np.diff(np.r_[starts, len(sym)])
                stay = np.repeat(open_, count)
                done_sym.append(sym[~stay])
                done_owner.append(owner[~stay])
                new_at = np.cumsum(stay) - 1
                at = new_at[at[open_]]
                sym, owner, rank = sym[stay], owner[stay], rank[stay]
                if not len(sym):
                    break
            sym[at] = self.by_rank[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            shifted = np.cumsum(keep) - 1
            at = shifted[at]
            sym, owner, rank = sym[keep], owner[keep], rank[keep]
            for i in (at, at - 1):
                i = i[i >= 0]
                has = np.minimum(i + 1, len(sym) - 1)
                ok = (owner[i] == owner[has]) & (has > i)
                rank[i] = np.where(ok, self.ranked(sym[i], sym[has]), NONE)
        sym, owner = np.concatenate(done_sym), np.concatenate(done_owner)
        return np.bincount(owner, minlength=len(lens)), sym[np.argsort(owner, kind="stable")]

    def merge(self, pieces: list[tuple[bytes, bool]]) -> list[np.ndarray]:
        count, flat = self.merge_flat(pieces)
        return np.split(flat, np.cumsum(count)[:-1])

    def widths(self, ids: np.ndarray) -> np.ndarray:
        return self.width[ids]

    def join(self, left: np.ndarray, right: np.ndarray, text: bytes, cut: int, final: bool) -> np.ndarray:
        """Ids of ``text`` from those of ``text[:cut]`` and ``text[cut:]``."""
        ls, rs = np.cumsum(self.widths(left)), cut + np.cumsum(self.widths(right))  # ends of tokens
        k = 8
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            lo = int(ls[a - 1]) if a else 0
            hi = int(rs[b - 1])
            mid = self.merge([(text[lo:hi], final and hi == len(text))])[0]
            ends = lo + np.cumsum(self.widths(mid))
            head, i = left[:0], 0
            if a:
                same = np.flatnonzero(np.isin(ends, ls[a:-1]))
                same = [x for x in same if left[np.searchsorted(ls, ends[x])] == mid[x] and self._start(ends, x, lo) == self._start(ls, np.searchsorted(ls, ends[x]), 0)]
                if not same:
                    k *= 2
                    continue
                i = same[0]
                head = left[: np.searchsorted(ls, ends[i])]
            tail, j = right[:0], len(mid)
            if b < len(right):
                same = [x for x in np.flatnonzero(np.isin(ends, rs[:b])) if right[np.searchsorted(rs, ends[x])] == mid[x] and self._start(ends, x, lo) == self._start(rs, np.searchsorted(rs, ends[x]), cut)]
                same = [x for x in same if x > i or not a]
                if not same:
                    k *= 2
                    continue
                j = same[-1] + 1
                tail = right[np.searchsorted(rs, ends[j - 1]) + 1 :]
            return np.concatenate([head, mid[i:j], tail])

    @staticmethod
    def _start(ends: np.ndarray, i: int, first: int) -> int:
        return int(ends[i - 1]) if i else first

    def tree(self, word: bytes, final: bool = True) -> np.ndarray:
        """Ids of a long word: leaves first, then joins from the bottom up."""
        cuts = list(range(0, len(word), LEAF)) + [len(word)]
        parts = self.merge([(word[a:b], final and b == len(word)) for a, b in zip(cuts, cuts[1:])])
        spans = list(zip(cuts, cuts[1:]))
        return self.joined(parts, spans, word, final)

    def joined(self, parts: list, spans: list, word: bytes, final: bool) -> np.ndarray:
        while len(parts) > 1:
            new_parts, new_spans = [], []
            for i in range(0, len(parts) - 1, 2):
                (a, m), (_, b) = spans[i], spans[i + 1]
                new_parts.append(self.join(parts[i], parts[i + 1], word[a:b], m - a, final and b == len(word)))
                new_spans.append((a, b))
            if len(parts) % 2:
                new_parts.append(parts[-1])
                new_spans.append(spans[-1])
            parts, spans = new_parts, new_spans
        return parts[0]

    def odd(self, chunk: str) -> bool:
        """Whether the library has to see the chunk."""
        return not self.plain.fullmatch(chunk) or ("<|" in chunk and any(s in chunk for s in self.special))

    def long_words(self, chunk: str) -> list[bytes]:
        """Words of an odd chunk, normalised by the library."""
        text = self.lib.normalizer.normalize_str(chunk)
        return [bytes(map(self.value.__getitem__, w)) for w, _ in self.lib.pre_tokenizer.pre_tokenize_str(text)]

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks that hold no white space, back to back, and their offsets."""
        if not chunks:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        joined = "\n".join(chunks)
        ids: dict[int, np.ndarray] = {}
        if "<|" in joined or not self.plain_lines.fullmatch(joined):
            rest, chunks = [n for n, c in enumerate(chunks) if self.odd(c)], list(chunks)
            texts = [chunks[n] for n in rest]
            for n in rest:
                chunks[n] = ""
            joined = "\n".join(chunks)
            short = [i for i, c in enumerate(texts) if len(c) <= LEAF or any(s in c for s in self.special)]
            for i, e in zip(short, self.lib.encode_batch([texts[i] for i in short], add_special_tokens=False)):
                ids[rest[i]] = np.array(e.ids, np.int64)
            for i, c in enumerate(texts):
                if rest[i] not in ids:
                    ids[rest[i]] = np.concatenate([self.tree(w) for w in self.long_words(c)] or [np.zeros(0, np.int64)])
        words = self.words.findall(joined.lower())
        known: dict[str, int] = {"\n": 0}
        at = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
        lens, flat = self.merged("\n".join(known).encode())
        # each word's ids in order of the chunks; a line end adds none
        first = np.cumsum(lens) - lens
        take = lens[at]
        ends = np.cumsum(take)
        out = flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[at] - ends + take, take)]
        breaks = np.flatnonzero(at == 0)
        total = int(ends[-1]) if len(ends) else 0
        offsets = np.r_[0, ends[breaks] if len(breaks) else np.zeros(0, np.int64), total]
        if ids:
            parts = np.split(out, offsets[1:-1])
            for n, x in ids.items():
                parts[n] = x
            offsets = np.cumsum([0, *map(len, parts)])
            out = np.concatenate(parts)
        return out, offsets

    def merged(self, words: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and all ids of the words between line ends; the first of them is a line end and has none."""
        data = np.frombuffer(words + b"\n", np.uint8)
        ends = np.flatnonzero(data == 10)[2:]  # those of the words after the first
        starts = np.r_[2, ends[:-1] + 1][: len(ends)]
        size = ends - starts
        letters, at = data[data != 10], np.cumsum(size) - size
        lens, flats = [np.zeros(1, np.int64)], []
        for k in range(0, len(size), 8192):
            some = size[k : k + 8192]
            long = np.flatnonzero(some > LEAF)
            if len(long):
                texts = [words[a : a + n] for a, n in zip(starts[k : k + 8192].tolist(), some.tolist())]
                own = {i: self.tree(texts[i]) for i in long.tolist()}
                parts = self.merge([(b"a" if i in own else w, True) for i, w in enumerate(texts)])
                for i, x in own.items():
                    parts[i] = x
                count, flat = np.array([*map(len, parts)], np.int64), np.concatenate(parts)
            else:
                count, flat = self.merge_bytes(letters[at[k] : at[k] + some.sum()], some, np.ones(len(some), bool))
            lens.append(count)
            flats.append(flat)
        return np.concatenate(lens), np.concatenate(flats) if flats else np.zeros(0, np.int64)

    def remember(self, chunks: set[str], make) -> dict:
        """Cache of at least ``chunks``; ``make(ids, offsets)`` lists the entries of new ones.

        A full generation becomes the old one, from which words in use come
        back, so frequent words are encoded once per worker.
        """
        if self.held > self.limit:
            self.old, self.cache, self.held = self.cache, {}, 0
        missing = chunks.difference(self.cache)
        known = missing.intersection(self.old)
        self.cache.update(zip(known, map(self.old.__getitem__, known)))
        new = list(missing.difference(known))
        if new:
            self.cache.update(zip(new, make(*self.encode_chunks(new))))
        # an entry of c characters holds about 6 c bytes of ids or texts besides its objects
        self.held += 200 * len(missing) + 6 * sum(map(len, missing))
        return self.cache


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones themselves, the others from code point 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


def split_text(text: str) -> list[str]:
    """Chunks between white space.  Python also splits at 1C-1F, which the tokenizer doesn't."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [c for c in regex.split("[" + WHITE + "]+", text) if c]
    return text.split()


def codec(path: str) -> Codec:
    """A codec of one's own, best held by a ``with`` block."""
    return Codec(path)


_HELD: dict[str, Codec] = {}


def in_task(path: str, work, hold: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work(codec, batches)`` as a function of the batches alone, with a codec of its own.

    With ``hold`` the worker keeps codec and cache for the next such task,
    which saves encoding recurring words again; any other task frees them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if hold:
            if path not in _HELD:
                _HELD[path] = codec(path)
                _HELD[path].limit = 2 * CACHE
            yield from work(_HELD[path], batches)
            return
        _HELD.clear()
        with codec(path) as c:
            yield from work(c, batches)

    return run


def slices(texts: list, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``limit`` characters."""
    at = size = 0
    for i, t in enumerate(texts):
        size += (0 if t is None else len(t)) + 64
        if size >= limit:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


KINDS = {
    "n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(),
    "ids_sha256": pa.string(), "decoded_sha256": pa.string(),
}
DDL = {"n_tokens": "bigint", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def outputs(ids: str, decoded: str, want: list[str]) -> list:
    """Wanted columns of one text, from its decimal ids and tokens joined by spaces."""
    make = {
        "n_tokens": lambda: ids.count(" ") + 1 if ids else 0,
        "ids": lambda: np.fromstring(ids, np.int32, sep=" ") if ids else np.zeros(0, np.int32),
        "decoded": lambda: decoded,
        "ids_sha256": lambda: hashlib.sha256(ids.encode()).hexdigest(),
        "decoded_sha256": lambda: hashlib.sha256(decoded.encode()).hexdigest(),
    }
    return [make[w]() for w in want]


def encode(
    docs: DataFrame,
    path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    columns: tuple[str, ...] = ("n_tokens", "ids", "decoded"),
    parallel_chars: int = 1 << 20,
    leaf_chars: int = 1 << 16,
) -> DataFrame:
    """Encode every whole text and decode it again: ``id_col`` and ``columns``.

    ``columns`` are among ``n_tokens, ids, decoded, ids_sha256,
    decoded_sha256`` (digests of the decimal ids joined by a space, and of the
    decoded text).  Texts longer than ``parallel_chars`` are cut into leaves of
    ``leaf_chars`` that are encoded in parallel, inside words too, and joined
    per text by tree concatenation.

    Null or blank text: no ids, decoded to an empty text.  Null ids and
    repeated rows: one result per row.  Other columns are ignored.  No rows: no
    rows.  ``path`` has to exist on every executor.
    """
    ship_package(docs.sparkSession)
    want = list(columns)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    out_ddl = ", ".join([f"_id {id_type}", *[f"`{c}` {DDL[c]}" for c in want]])

    plain = set(want) <= {"n_tokens", "ids"}  # then raw ids are kept, not their text

    def raw_entries(ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        raw, cut = ids.astype("<i4").tobytes(), (4 * offsets).tolist()
        return [raw[a:b] for a, b in zip(cut, cut[1:])]

    def entry(c: Codec):
        def make(ids: np.ndarray, offsets: np.ndarray) -> list[tuple[str, str]]:
            ids, offsets = ids.tolist(), offsets.tolist()
            num, tok = [c.digits[i] for i in ids], [c.tokens[i] for i in ids]
            return [(" ".join(num[a:b]), " ".join(tok[a:b])) for a, b in zip(offsets, offsets[1:])]

        return make

    def whole(c: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = raw_entries if plain else entry(c)
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, SLICE // 2):
                chunks = [split_text(t) if t else [] for t in texts[a:b]]
                cache = c.remember(set().union(*chunks), make)
                cols: list[list] = [[] for _ in want]
                for words in chunks:
                    found = [cache[w] for w in words]
                    if plain:
                        raw = np.frombuffer(b"".join(found), "<i4")
                        values = [raw if w == "ids" else len(raw) for w in want]
                    else:
                        values = outputs(" ".join([f[0] for f in found if f[0]]), " ".join([f[1] for f in found if f[0]]), want)
                    for col, v in zip(cols, values):
                        col.append(v)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *[pa.array(v, KINDS[w]) for v, w in zip(cols, want)]],
                    names=["_id", *want],
                )

    size = F.length(F.coalesce("_text", F.lit("")))
    short = rows.where(size <= parallel_chars).mapInArrow(in_task(path, whole), out_ddl)

    def leaves(c: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of about ``leaf_chars``: whole chunks, or a stretch of one long word with its number."""
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                held: list[str] = []
                size = word = 0

                def flush():
                    if held:
                        rows.append((key, len(rows), -1, False, " ".join(held).encode()))
                        held.clear()

                for chunk in split_text(text):
                    if len(chunk) <= leaf_chars or any(s in chunk for s in c.special):
                        held.append(chunk)
                        size += len(chunk)
                        if size > leaf_chars:
                            flush()
                            size = 0
                        continue
                    flush()
                    for p in c.long_words(chunk):
                        word += 1
                        for a in range(0, len(p), leaf_chars):
                            rows.append((key, len(rows), word, a + leaf_chars >= len(p), p[a : a + leaf_chars]))
                flush()
                for a in range(0, len(rows), 256):
                    k, s, w, f, x = zip(*rows[a : a + 256])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k, pa.int64()), pa.array(s, pa.int64()), pa.array(w, pa.int64()), pa.array(f), pa.array(x, pa.binary())],
                        names=["key", "seq", "word", "final", "piece"],
                    )

    def encode_leaves(c: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                piece = row.column(4)[0].as_py()
                if row.column(2)[0].as_py() < 0:
                    ids = c.encode_chunks(split_text(piece.decode()))[0]
                else:
                    ids = c.tree(piece, row.column(3)[0].as_py())
                yield row.append_column("ids", pa.array([ids.astype(np.int32).tobytes()], pa.binary()))

    def join_leaves(group: pa.Table) -> pa.Table:
        with codec(path) as c:
            return joined_text(c, group)

    def joined_text(c: Codec, group: pa.Table) -> pa.Table:
        rows = group.sort_by("seq").to_pylist()
        parts, at = [], 0
        while at < len(rows):
            end = at + 1
            while rows[at]["word"] >= 0 and end < len(rows) and rows[end]["word"] == rows[at]["word"]:
                end += 1
            ids = [np.frombuffer(r["ids"], np.int32).astype(np.int64) for r in rows[at:end]]
            if end - at > 1:
                cuts = np.cumsum([0, *[len(r["piece"]) for r in rows[at:end]]]).tolist()
                ids = [c.joined(ids, list(zip(cuts, cuts[1:])), b"".join(r["piece"] for r in rows[at:end]), True)]
            parts += ids
            at = end
        ids = np.concatenate(parts).tolist()
        values = outputs(" ".join(map(str, ids)), " ".join([c.tokens[i] for i in ids]), want)
        return pa.table([group.column("key").slice(0, 1), *[pa.array([v], KINDS[w]) for v, w in zip(values, want)]], names=["key", *want])

    long = rows.where(size > parallel_chars)
    cut = long.select(F.xxhash64("_text").alias("key"), "_text").dropDuplicates(["_text"])
    cut = cut.mapInArrow(in_task(path, leaves), "key bigint, seq bigint, word bigint, final boolean, piece binary")
    cut = spread(cut, "key", "seq").mapInArrow(
        in_task(path, encode_leaves), "key bigint, seq bigint, word bigint, final boolean, piece binary, ids binary"
    )
    joined = cut.groupBy("key").applyInArrow(join_leaves, ", ".join(["key bigint", *[f"`{c}` {DDL[c]}" for c in want]]))
    blank = outputs("", "", want)
    long_out = long.select("_id", F.xxhash64("_text").alias("key")).join(joined, "key", "left")
    empty = {c: F.array().cast("array<int>") if c == "ids" else F.lit(v) for c, v in zip(want, blank)}
    long_out = long_out.select("_id", *[F.coalesce(F.col(c), empty[c]).alias(c) for c in want])
    return short.unionByName(long_out).withColumnRenamed("_id", id_col)
