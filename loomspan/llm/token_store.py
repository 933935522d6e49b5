"""Token ids in binary shards, with a minimal perfect hash index for keyed access.

The store is two Parquet folders, so that it can stand on any file system that
Spark writes to and a lost executor leaves no half file:

payload/  shard, block, payload (ids as raw little-endian 16 or 32-bit integers),
          doc_ids, ranks, offsets (first id within the shard), lengths
index/    bucket, buckets, seeds, prints, shards, offsets, lengths (binary arrays by slot)

Shards hold ascending doc_id ranges. A key is (doc_id, rank), rank counting the
rows of one doc_id. Keys are dealt to buckets of a few thousand; each bucket's
hash-and-displace function sends its n keys to slots 0 to n - 1, and a stored
fingerprint tells a foreign key from an own one.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir, stored
from .tokens import encoder, tokenizer_path

END_ID = 0
BUCKET = 4096
GROUP = 4  # keys that share a seed, on average
BLOCK_IDS = 1 << 19
TEXTS = 2048  # texts that are encoded at once
NAMED = 1000  # keys whose buckets and shards a filter names
_U = np.uint64

PAYLOAD = "shard int, block int, width int, payload binary, doc_ids array<long>, ranks array<int>, offsets array<long>, lengths array<long>"
INDEX = "bucket long, buckets long, seeds binary, prints binary, shards binary, offsets binary, lengths binary"
_payload_arrow = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("width", pa.int32()), ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])


def _encode_shards(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one task come in key order: they are one shard."""
        enc, shard, block, at = encoder(path), TaskContext.get().partitionId(), 0, 0
        width = 2 if max(len(enc.spaced) - 1, end_id) < 1 << 16 else 4
        last, rank = object(), 0
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                some = batch.slice(k, TEXTS)
                ids, ends = enc.encode(some.column(1))
                keys, j = some.column(0).to_pylist(), 0
                while j < len(keys):
                    stop = max(j + 1, int(np.searchsorted(ends, ends[j] + BLOCK_IDS, "right")) - 1)
                    length = np.diff(ends[j : stop + 1]) + 1
                    body = np.insert(ids[ends[j] : ends[stop]], ends[j + 1 : stop + 1] - ends[j], end_id)
                    ranks = []
                    for key in keys[j:stop]:
                        rank = rank + 1 if key == last else 0
                        last = key
                        ranks.append(rank)
                    offsets = at + np.cumsum(length) - length
                    yield pa.RecordBatch.from_pydict({"shard": [shard], "block": [block], "width": [width], "payload": [body.astype(f"<u{width}").tobytes()], "doc_ids": [keys[j:stop]], "ranks": [ranks], "offsets": [offsets.tolist()], "lengths": [length.tolist()]}, schema=_payload_arrow)
                    at, block, j = at + int(length.sum()), block + 1, stop

    return run


def _hashes(doc_id: str, rank: str) -> list[Column]:
    return [F.xxhash64(doc_id, rank).alias("k1"), F.xxhash64(F.lit("second"), rank, doc_id).alias("k2")]


def _slots(k1: np.ndarray, k2: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    x = (k1 ^ (seed.astype(_U) * _U(0x9E3779B97F4A7C15))) + k2
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return ((x ^ (x >> _U(31))) % _U(n)).astype(np.int64)


def perfect_hash(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seed of each group, slot of each key): slots are 0 to n - 1, each once. Keys differ in k1 or k2."""
    n = len(k1)
    m = -(-n // GROUP)
    group = (k2 % _U(m)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    start = np.searchsorted(group[order], np.arange(m + 1))
    seeds, free, slot = np.zeros(m, np.uint32), np.ones(n, bool), np.zeros(n, np.int64)
    for g in np.argsort(-np.diff(start), kind="stable"):
        keys = order[start[g] : start[g + 1]]
        if not len(keys):
            break
        tried, step = 0, 64
        while True:
            seed = np.arange(tried, tried + step)
            at = _slots(k1[keys][None, :], k2[keys][None, :], seed[:, None], n)
            ok = free[at].all(axis=1)
            if len(keys) > 1:
                s = np.sort(at, axis=1)
                ok &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if ok.any():
                i = int(ok.argmax())
                seeds[g], slot[keys] = seed[i], at[i]
                free[at[i]] = False
                break
            tried, step = tried + step, min(4096, step * 4)
            if tried > 1 << 31:
                raise ValueError("two keys with the same hashes")
    return seeds, slot


def _prints(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    return ((k1 >> _U(32)) ^ k2).astype(np.uint32)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    k1, k2 = pdf["k1"].to_numpy().view(_U), pdf["k2"].to_numpy().view(_U)
    seeds, slot = perfect_hash(k1, k2)
    place = np.argsort(slot)
    raw = lambda c, t: pdf[c].to_numpy()[place].astype(t).tobytes()
    return pd.DataFrame([{"bucket": pdf["bucket"].iloc[0], "buckets": pdf["buckets"].iloc[0], "seeds": seeds.tobytes(), "prints": _prints(k1, k2)[place].tobytes(), "shards": raw("shard", "<i4"), "offsets": raw("offset", "<i8"), "lengths": raw("length", "<i8")}])


def _find(keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    k1, k2 = keys["k1"].to_numpy().view(_U), keys["k2"].to_numpy().view(_U)
    if index.empty or keys.empty:
        return pd.DataFrame({"doc_id": [], "rank": [], "shard": [], "offset": [], "length": []})
    row = index.iloc[0]
    seeds, prints = np.frombuffer(row["seeds"], np.uint32), np.frombuffer(row["prints"], np.uint32)
    slot = _slots(k1, k2, seeds[(k2 % _U(len(seeds))).astype(np.int64)], len(prints))
    own = prints[slot] == _prints(k1, k2)
    slot, keys = slot[own], keys[own]
    return pd.DataFrame({"doc_id": keys["doc_id"], "rank": keys["rank"], "shard": np.frombuffer(row["shards"], "<i4")[slot], "offset": np.frombuffer(row["offsets"], "<i8")[slot], "length": np.frombuffer(row["lengths"], "<i8")[slot]})


def write(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> str:
    """Writes the store of docs; returns its path (a new folder in the shared one by default).

    Null texts are empty: their only id is end_id. Rows of one doc_id stand in
    order of their text; null doc_ids come first. An empty table gives an empty store."""
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    payload, _ = stored(rows.mapInArrow(_encode_shards(tokenizer, end_id), PAYLOAD), f"{path}/payload", compression="zstd")
    entries = payload.select("shard", F.explode(F.arrays_zip("doc_ids", "ranks", "offsets", "lengths")).alias("e"))
    n = payload.agg(F.sum(F.size("doc_ids"))).first()[0] or 0
    keyed = entries.select("shard", F.col("e.offsets").alias("offset"), F.col("e.lengths").alias("length"), *_hashes("e.doc_ids", "e.ranks"))
    buckets = max(1, -(-n // BUCKET))
    keyed = keyed.withColumns({"bucket": F.pmod("k1", F.lit(buckets)), "buckets": F.lit(buckets).cast("long")})
    stored(keyed.groupBy("bucket").applyInPandas(_build, INDEX), f"{path}/index")
    return path


def lookup(spark: SparkSession, path: str, keys: DataFrame, few: bool = False) -> DataFrame:
    """(doc_id, rank, shard, offset, length) of those keys (doc_id, rank) that the store has: one bucket's function each, in constant time a key.

    few: the keys' buckets are collected and named to the scan, which else reads the whole index."""
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    some = index.select("buckets").first()
    buckets = some["buckets"] if some else 1
    keys = keys.select(F.col("doc_id").cast("long"), F.col("rank").cast("int"))
    keys = keys.select(F.col("doc_id").cast("string"), "rank", *_hashes("doc_id", "rank")).withColumn("bucket", F.pmod("k1", F.lit(buckets)))
    if few:
        index = index.where(F.col("bucket").isin([r[0] for r in keys.select("bucket").distinct().collect()]))
    found = keys.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(_find, "doc_id string, rank int, shard int, offset long, length long")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [np.frombuffer(x, f"<u{w}").astype(np.int64) for x, w in zip(batch.column("raw").to_pylist(), batch.column("width").to_pylist())]
        ids = pa.array(raw, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rank"), ids], names=["doc_id", "rank", "ids"])


def get(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(doc_id, rank, ids) of those keys (doc_id, rank) that the store has, the end id included.

    The buckets and shards of up to NAMED keys are named in the scans' filters, where
    statistics of the files skip the others: the index is sorted by bucket and a
    payload file holds one shard. More keys read the whole store. Repeated keys count
    once; a null doc_id is a key like any other, and a null rank finds nothing."""
    keys = cut(keys.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("rank").cast("int").alias("rank")).distinct())
    few = keys.count() <= NAMED
    found = cut(lookup(spark, path, keys, few))
    payload = spark.read.schema(PAYLOAD).parquet(f"{path}/payload")
    if few:
        payload = payload.where(F.col("shard").isin([r[0] for r in found.select("shard").distinct().collect()]))
    # the block of each document first, from its arrays alone; then the blocks' ids meet only what is wanted of them
    at = payload.select("shard", "block", F.element_at("offsets", 1).alias("first"), F.explode(F.arrays_zip("offsets", "doc_ids", "ranks")).alias("e"))
    at = at.select("shard", "block", "first", F.col("e.offsets").alias("offset"), F.col("e.doc_ids").alias("own"), F.col("e.ranks").alias("own_rank"))
    # a fingerprint may be another key's, once in four billion foreign ones: the stored key decides
    wanted = found.join(at, ["shard", "offset"]).where(F.col("own").eqNullSafe(F.col("doc_id")) & (F.col("own_rank") == F.col("rank")))
    cutting = F.substring("payload", ((F.col("offset") - F.col("first")) * F.col("width") + 1).cast("int"), (F.col("length") * F.col("width")).cast("int"))
    met = wanted.join(payload.select("shard", "block", "width", "payload"), ["shard", "block"])
    return met.select("doc_id", "rank", "width", cutting.alias("raw")).mapInArrow(_ids, "doc_id long, rank int, ids array<long>")


def _crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["payload"], f"<u{row['width']}").astype("<u4").tobytes()
            first = row["offsets"][0]
            cuts = [4 * (o - first) for o in row["offsets"]]
            crc = [zlib.crc32(memoryview(ids)[a : a + 4 * n]) for a, n in zip(cuts, row["lengths"])]
            yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(crc), pa.int32()), pa.array(row["offsets"], pa.int64()), pa.array(crc, pa.int64())], names=["shard", "offset", "ids_crc32"])


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, rank, start, n_tokens, ids_crc32) of the store's documents, from its files.

    Place and length come from the index by key, the checksum from the raw ids at
    that place. start counts the ids of all documents before."""
    payload = spark.read.schema(PAYLOAD).parquet(f"{path}/payload")
    keys = payload.select(F.explode(F.arrays_zip("doc_ids", "ranks")).alias("e")).select(F.col("e.doc_ids").alias("doc_id"), F.col("e.ranks").alias("rank"))
    placed = lookup(spark, path, keys)
    raw = payload.select("shard", "width", "payload", "offsets", "lengths").mapInArrow(_crcs, "shard int, offset long, ids_crc32 long")
    total = payload.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    # a row per shard: as many as the tasks that wrote them
    base = total.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    found = placed.join(raw, ["shard", "offset"]).join(F.broadcast(base), "shard")
    return found.select("doc_id", "rank", (F.col("base") + F.col("offset")).alias("start"), F.col("length").alias("n_tokens"), "ids_crc32")
