"""Token ids as binary shards with a minimal perfect hash index.

File format: a Parquet table with one row per shard, in ascending id order:
``part, shard`` (order), ``first_key, last_key, n_null, n_docs, n_tokens``,
``keys`` (little-endian int64, for scans), ``index`` and ``payload`` (raw ids
back to back, unsigned 16 bits if the vocabulary allows, else 32).  The index
is a minimal perfect hash: a seed per bucket sends each key to a slot of its
own, which holds a 32-bit fingerprint, the ordinal of the key's first document
and how many documents carry the key; a table of offsets leads from ordinals
into the payload.  A keyed read costs two hashes and never compares keys.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package
from .bpe import Codec, in_task, slices, split_text

SHARD_DDL = (
    "part int, shard int, first_key bigint, last_key bigint, n_null int, n_docs int, n_tokens bigint, "
    "width int, keys binary, index binary, payload binary"
)
BUCKET = 2  # keys a bucket of the hash holds on average; more make seeds hard to find


def mix(keys: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """64-bit finaliser of the keys under a seed, or under one seed each."""
    x = keys.astype(np.uint64) + (np.asarray(seed).astype(np.uint64) + np.uint64(1)) * np.array([0x9E3779B97F4A7C15], np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build_hash(keys: np.ndarray) -> np.ndarray:
    """Seeds of a minimal perfect hash of distinct int64 keys, one per bucket.

    Buckets are placed from the largest down, each with the first seed that
    sends its keys to free slots; a bucket of one key names its slot (-1 - slot).
    """
    n = len(keys)
    m = max(1, -(-n // BUCKET))
    if not n:
        return np.zeros(1, np.int32)
    bucket = (mix(keys, 0) % np.uint64(m)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket, minlength=m)
    start = np.cumsum(size) - size
    seeds, free = np.zeros(m, np.int32), np.ones(n, bool)
    for k in range(int(size.max()), 1, -1):
        left = np.flatnonzero(size == k)
        own = keys[order[start[left][:, None] + np.arange(k)]]
        seed = 0
        while len(left):
            seed += 1
            at = (mix(own, seed) % np.uint64(n)).astype(np.int64)
            line = np.sort(at, axis=1)
            fits = np.flatnonzero(free[at].all(axis=1) & (line[:, 1:] != line[:, :-1]).all(axis=1))
            if not len(fits):
                continue
            # where buckets of one round meet in a slot, the first keeps it
            claim = np.empty(n, np.int64)
            for j in range(k):
                claim[at[fits[::-1], j]] = fits[::-1]
            for j in range(k):
                claim[at[fits, j]] = np.minimum(claim[at[fits, j]], fits)
            won = fits[(claim[at[fits]] == fits[:, None]).all(axis=1)]
            free[at[won]] = False
            seeds[left[won]] = seed
            stay = np.ones(len(left), bool)
            stay[won] = False
            left, own = left[stay], own[stay]
    single = np.flatnonzero(size == 1)
    seeds[single] = -1 - np.flatnonzero(free)[: len(single)]
    return seeds


def find_slots(seeds: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """Slot of each key under the hash; any slot for a key that isn't in it."""
    seed = seeds[(mix(keys, 0) % np.uint64(len(seeds))).astype(np.int64)].astype(np.int64)
    return np.where(seed < 0, -1 - seed, (mix(keys, np.maximum(seed, 0)) % np.uint64(n)).astype(np.int64))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 0x5EED) >> np.uint64(32)).astype(np.uint32)


def pack_index(keys: np.ndarray, lens: np.ndarray) -> bytes:
    """Index of documents in order; ``keys`` are sorted and may repeat."""
    own, first, times = np.unique(keys, return_index=True, return_counts=True)
    seeds = build_hash(own)
    slot = find_slots(seeds, len(own), own)
    prints, ordinal, count = np.zeros(len(own), "<u4"), np.zeros(len(own), "<u4"), np.zeros(len(own), "<u4")
    prints[slot], ordinal[slot], count[slot] = fingerprint(own), first, times
    head = np.array([len(own), len(seeds), len(lens)], "<i8")
    offsets = np.cumsum(np.r_[0, lens]).astype("<i8")
    return b"".join(x.tobytes() for x in (head, offsets, seeds.astype("<i4"), prints, ordinal, count))


def look_up(index: bytes, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first ordinal, documents, offsets)`` for keys; no documents where the fingerprint differs."""
    n, m, docs = np.frombuffer(index, "<i8", 3).tolist()
    at = 24
    offsets = np.frombuffer(index, "<i8", docs + 1, at)
    at += 8 * (docs + 1)
    seeds = np.frombuffer(index, "<i4", m, at)
    at += 4 * m
    prints, ordinal, count = (np.frombuffer(index, "<u4", n, at + 4 * n * i) for i in range(3))
    if not n:
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), offsets
    slot = find_slots(seeds, n, keys)
    hit = prints[slot] == fingerprint(keys)
    return ordinal[slot].astype(np.int64), np.where(hit, count[slot], 0).astype(np.int64), offsets


def write_ids(
    docs: DataFrame,
    path: str,
    out: str | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int | None = 2,
    docs_per_part: int = 4096,
    shard_tokens: int = 1 << 18,
) -> str:
    """Encode whole texts, append ``end_id`` to each, and write the shards in ascending id order.

    Returns the folder written (``out``, or a fresh one in the shared folder).
    Ids are integers; null ids come first and are found by scans only, repeated
    ids keep all their documents (order among them: by their ids' bytes).
    Null or blank texts hold the end id alone.  Other columns are ignored.
    Part borders are approximate quantiles of the id column, so a part is about
    ``docs_per_part`` documents however ids are spread.
    """
    spark = docs.sparkSession
    ship_package(spark)
    out = out or scratch_path(spark, "token-ids")
    rows = docs.select(F.col(id_col).cast("bigint").alias("key"), F.col(text_col).alias("text"))
    n = rows.count()
    parts = max(1, -(-n // docs_per_part))
    cuts = []
    if parts > 1:
        at = [i / parts for i in range(1, parts)]
        cuts = rows.select(F.percentile_approx("key", at, max(10_000, 20 * parts))).first()[0] or []
    borders = np.unique(np.array(cuts, np.int64))

    def to_ids(c: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = "<u2" if c.ids <= 1 << 16 else "<u4"
        tail = b"" if end_id is None else np.array([end_id], dtype).tobytes()

        def make(ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
            raw = ids.astype(dtype).tobytes()
            cut = (offsets * np.dtype(dtype).itemsize).tolist()
            return [raw[a:b] for a, b in zip(cut, cut[1:])]

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                chunks = [split_text(t) if t else [] for t in texts[a:b]]
                cache = c.remember(set().union(*chunks), make)
                ids = [b"".join([cache[w] for w in words]) + tail for words in chunks]
                keys = batch.column(0).slice(a, b - a)
                part = np.searchsorted(borders, np.array(keys.fill_null(-(2**63))), side="right")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int32()), keys, pa.array(ids, pa.binary()), pa.array([np.dtype(dtype).itemsize] * len(ids), pa.int32())],
                    names=["part", "key", "ids", "width"],
                )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, part, shard = 0, None, 0

        def flush() -> pa.RecordBatch:
            width = held[0][2]
            keys = np.array([k for k, _, _ in held if k is not None], "<i8")
            nulls = len(held) - len(keys)
            lens = np.array([len(x) // width for _, x, _ in held], np.int64)
            # null keys come first and aren't in the hash: their ordinals are below nulls
            index = pack_index(keys, lens[nulls:])
            lead = int(lens[:nulls].sum())
            head = np.array([lead, *lens[:nulls]], "<i8").tobytes()
            row = {
                "part": part, "shard": shard, "first_key": int(keys[0]) if len(keys) else None,
                "last_key": int(keys[-1]) if len(keys) else None, "n_null": nulls, "n_docs": len(held),
                "n_tokens": int(lens.sum()), "width": width, "keys": keys.tobytes(), "index": head + index,
                "payload": b"".join(x for _, x, _ in held),
            }
            return pa.RecordBatch.from_pylist([row], PACKED)

        for batch in batches:
            for p, k, x, w in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if held and (p != part or size >= shard_tokens * w):
                    yield flush()
                    shard = shard + 1 if p == part else 0
                    held, size = [], 0
                elif p != part:
                    shard = 0
                part = p
                held.append((k, x, w))
                size += len(x)
        if held:
            yield flush()

    ids = rows.mapInArrow(in_task(path, to_ids, hold=True), "part int, key bigint, ids binary, width int")
    ids = ids.repartition(parts, "part").sortWithinPartitions("part", F.col("key").asc_nulls_first(), "ids")
    ids.mapInArrow(pack, SHARD_DDL).write.option("compression", "zstd").parquet(out)
    return out


PACKED = pa.schema(
    [
        ("part", pa.int32()), ("shard", pa.int32()), ("first_key", pa.int64()), ("last_key", pa.int64()),
        ("n_null", pa.int32()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("width", pa.int32()),
        ("keys", pa.binary()), ("index", pa.binary()), ("payload", pa.binary()),
    ]
)


def shards(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Shard rows, and ``(part, shard, start)`` with the number of ids in all shards before.

    Parts are summed first, so the one global window holds a row per part.
    """
    table = spark.read.schema(SHARD_DDL).parquet(path)
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = table.select("part", "shard", "n_tokens")
    totals = sizes.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    bases = totals.select("part", F.coalesce(F.sum("total").over(over), F.lit(0)).alias("base"))
    starts = sizes.select("part", "shard", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("before"))
    starts = starts.join(bases, "part").select("part", "shard", (F.col("base") + F.col("before")).alias("start"))
    # a shard is found by its place: starts have a row per shard, the payload stays where it was read
    return table, starts


def _documents(row: dict, keys: np.ndarray | None) -> Iterator[tuple]:
    """``(key, offset in the shard, ids)`` of all documents of a shard, or of the given keys, through its index."""
    nulls, width = row["n_null"], row["width"]
    head = np.frombuffer(row["index"], "<i8", nulls + 1)
    lead = int(head[0])
    payload = np.frombuffer(row["payload"], f"<u{width}")
    if keys is None:
        at = 0
        for n in head[1:].tolist():
            yield None, at, payload[at : at + n]
            at += n
        keys = np.unique(np.frombuffer(row["keys"], "<i8"))
    first, count, offsets = look_up(row["index"][8 * (nulls + 1) :], keys)
    for k, f, c in zip(keys.tolist(), first.tolist(), count.tolist()):
        for i in range(f, f + c):
            a, b = lead + int(offsets[i]), lead + int(offsets[i + 1])
            yield k, a, payload[a:b]


def _read(batches: Iterator[pa.RecordBatch], asked: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            keys = np.unique(np.array(row["asked"], np.int64)) if asked else None
            found = list(_documents(row, keys))
            for a, b in slices([x for _, _, x in found]):
                some = found[a:b]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * len(some), pa.int32()),
                        pa.array([row["shard"]] * len(some), pa.int32()),
                        pa.array([k for k, _, _ in some], pa.int64()),
                        pa.array([o for _, o, _ in some], pa.int64()),
                        pa.array([len(x) for _, _, x in some], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for _, _, x in some], pa.int64()),
                        *([pa.array([x.astype("<u4").tobytes() for _, _, x in some], pa.binary())] if asked else []),
                    ],
                    names=["part", "shard", "doc_id", "offset", "n_tokens", "ids_crc32", *(["ids"] if asked else [])],
                )


READ_DDL = "part int, shard int, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint"


def read_all(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files: ``doc_id, start, n_tokens, ids_crc32``, each found through the index.

    ``start`` counts the ids of all documents before; the checksum is the
    unsigned crc32 of the ids as little-endian 32-bit integers.  Payloads are
    read in place and not shuffled.
    """
    ship_package(spark)
    table, starts = shards(spark, path)
    rows = table.mapInArrow(lambda it: _read(it, False), READ_DDL)
    return rows.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_keys(spark: SparkSession, path: str, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """Documents of the asked keys: ``doc_id, start, n_tokens, ids_crc32, ids`` (little-endian 32-bit).

    Absent keys return nothing (a foreign key passes the fingerprint once in
    2**32), null keys neither.  Keys reach their shard by its key range, so
    only shards that are asked are decoded.
    """
    ship_package(spark)
    table, starts = shards(spark, path)
    ranges = table.select("part", "shard", "first_key", "last_key").where("first_key IS NOT NULL")
    # one first key per part of thousands of documents
    firsts = sorted((r.k, r.part) for r in ranges.groupBy("part").agg(F.min("first_key").alias("k")).collect())
    first, number = np.array([k for k, _ in firsts], np.int64), np.array([p for _, p in firsts], np.int32)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(first, np.asarray(batch.column(0)), side="right") - 1
            part = number[np.maximum(at, 0)] if len(number) else np.zeros(len(at), np.int32)
            yield batch.append_column("part", pa.array(part))

    asked = keys.select(F.col(key_col).cast("bigint").alias("k")).where("k IS NOT NULL").distinct()
    routed = asked.mapInArrow(route, "k bigint, part int").join(ranges, "part")
    routed = routed.where(F.col("k").between(F.col("first_key"), F.col("last_key")))
    routed = routed.groupBy("part", "shard").agg(F.collect_list("k").alias("asked"))
    rows = table.join(routed, ["part", "shard"]).mapInArrow(lambda it: _read(it, True), READ_DDL + ", ids binary")
    return rows.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "ids"
    )
