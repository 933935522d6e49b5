"""Histogram sort into shards of near equal bytes.

The sort key is (hash of the text, hash of the id, id), so equal texts stand
together and no value of the data can make the key uneven, but for groups of equal
texts; those share the first part and are told apart by the second. Splitters are
found by counting exact bytes below candidate boundaries: every round lays 4096
probes over the interval in which each splitter still lies and keeps the probe
interval that its target falls in, until a boundary is within tolerance. Rows then
cross the network once. Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARDS = 16
PROBE_BITS = 12
TOLERANCE = 0.0005  # of a shard's ideal size
WHOLE = 0.05  # of a shard's ideal size: a group of equal texts up to this is never cut through
SLOT_ROWS = 100_000  # rows that are numbered together, on average
_LOW, _HIGH = -(1 << 63), 1 << 63


#: An interval: the first part's value it lies in (None: over the first part itself), its start, its bits, bytes below it, bytes in it.
Interval = tuple[int | None, int, int, int, int]


def _narrow(keys: DataFrame, key: str, at: dict[int, Interval], targets: dict[int, int], near: float) -> dict[int, Interval]:
    """Refines each splitter's interval over the long column key until it is one key or begins within near bytes below the target."""
    while open_ := {s: v for s, v in at.items() if v[2] and targets[s] - v[3] > near}:
        spans = sorted({v[:3] for v in open_.values()}, key=str)
        finer = {v: max(0, v[2] - PROBE_BITS) for v in spans}
        span = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k1).cast("long").alias("k1"), F.lit(lo).cast("long").alias("lo"), F.lit(lo + (1 << bits) - 1).cast("long").alias("hi"), F.lit(finer[k1, lo, bits]).alias("bits")) for i, (k1, lo, bits) in enumerate(spans)])
        held = F.filter(span, lambda v: (F.col(key) >= v["lo"]) & (F.col(key) <= v["hi"]) & (v["k1"].isNull() | (v["k1"] == F.col("k1"))))
        hit = keys.select("size", F.col(key).alias("key"), F.explode(held).alias("v"))
        probe = F.expr("shiftright(key, v.bits) - shiftright(v.lo, v.bits)")
        counts: list[dict[int, int]] = [{} for _ in spans]
        # at most splitters x 4096 rows
        for r in hit.groupBy(F.col("v.i").alias("i"), probe.alias("p")).agg(F.sum("size").alias("b")).toLocalIterator():
            counts[r["i"]][r["p"]] = r["b"]
        for s, v in open_.items():
            below, bins = v[3], counts[spans.index(v[:3])]
            for p in sorted(bins):
                if below + bins[p] >= targets[s]:
                    at[s] = (v[0], v[1] + (p << finer[v[:3]]), finer[v[:3]], below, bins[p])
                    break
                below += bins[p]
    return at


def _nearer(v: Interval, target: int) -> int:
    """Of an interval of one key: where the boundary is, before or behind it."""
    return v[1] if v[2] or target - v[3] <= v[3] + v[4] - target else v[1] + 1


def _splitters(keys: DataFrame, targets: dict[int, int], near: float, whole: float) -> list[tuple[int, int]]:
    """Boundaries (k1, k2): a row at or above the i-th goes behind it. A group of one text above `whole` bytes may be cut through."""
    first = _narrow(keys, "k1", {s: (None, _LOW, 64, 0, 0) for s in targets}, targets, near)
    inside = {s: (v[1], _LOW, 64, v[3], v[4]) for s, v in first.items() if not v[2] and v[4] > whole and targets[s] - v[3] > near}
    bounds = {s: (_nearer(v, targets[s]), _LOW) for s, v in first.items()}
    if inside:
        group = cut(keys.where(F.col("k1").isin([v[0] for v in inside.values()])))
        for s, v in _narrow(group, "k2", inside, targets, near).items():
            bounds[s] = (v[0], _nearer(v, targets[s]))
    return [bounds[s] for s in sorted(bounds)]


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """docs with size (UTF-8 bytes of the text, null: none, plus 1), text_crc32, shard and slot (gapless from 0 within a shard).

    Shards are ranges of the sort key whose bytes differ from the ideal by less
    than the tolerance or one row. Equal texts fall in one shard unless a boundary
    has to cut through their group. Null ids sort by their hash like others; rows
    that are repeated whole may be ordered either way. Empty tables give empty results.
    Columns named size, text_crc32, shard or slot in docs are replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.drop("size", "text_crc32", "shard", "slot").withColumns({
        "size": (F.octet_length(text) + 1).cast("long"),
        "text_crc32": F.crc32(text.cast("binary")),
        "_k1": F.xxhash64(text),
        "_k2": F.xxhash64(F.col(id_col), F.lit("id")),
    })
    keys = cut(whole.select(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), "size"))
    n, total = keys.agg(F.count("*"), F.sum("size")).first()
    targets = {s: (total or 0) * s // shards for s in range(1, shards)}
    near = tolerance * (total or 0) / shards
    bounds = _splitters(keys, targets, near, WHOLE * (total or 0) / shards) if n else []
    number = F.lit(0)
    for k1, k2 in bounds:
        if k1 < _HIGH:
            over = (F.col("_k1") > k1) | ((F.col("_k1") == k1) & (F.col("_k2") >= k2)) if k2 < _HIGH else F.col("_k1") > k1
            number = number + over.cast("int")
    whole = whole.withColumn("shard", number.cast("int"))
    return _slots(whole, keys, n, number, id_col).drop("_k1", "_k2")


def _slots(whole: DataFrame, keys: DataFrame, n: int, number, id_col: str) -> DataFrame:
    """slot: the row's number within its shard in key order. Rows are numbered in ranges of the key with about SLOT_ROWS rows; a range that one text fills is dealt out by the second hash."""
    bits = max(0, (max(1, n) // SLOT_ROWS).bit_length() + 4)
    first = F.shiftright("_k1", 64 - bits) if bits else F.lit(0).cast("long")
    named = keys.withColumnsRenamed({"k1": "_k1", "k2": "_k2"}).withColumn("shard", number.cast("int")).withColumn("_r1", first)
    heavy = cut(named.groupBy("_r1").agg(F.count("*").alias("m")).where(F.col("m") > SLOT_ROWS // 4).select("_r1", F.lit(True).alias("_heavy")))
    fine = F.when(F.col("_heavy"), F.struct(F.col("_k1").alias("k"), F.shiftright("_k2", 64 - bits - 2).alias("s"))).otherwise(F.struct(F.lit(_LOW).cast("long").alias("k"), F.lit(0).cast("long").alias("s")))
    named = named.join(heavy, "_r1", "left").withColumn("_r2", fine)
    sizes = named.groupBy("shard", "_r1", "_r2").agg(F.count("*").alias("m"))
    # about 16 ranges for each SLOT_ROWS rows, and few rows per shard
    base = sizes.select("shard", "_r1", "_r2", (F.sum("m").over(Window.partitionBy("shard").orderBy("_r1", "_r2")) - F.col("m")).alias("_base"))
    rows = whole.withColumn("_r1", first).join(heavy, "_r1", "left").withColumn("_r2", fine).drop("_heavy")
    within = F.row_number().over(Window.partitionBy("shard", "_r1", "_r2").orderBy("_k1", "_k2", id_col)) - 1
    rows = rows.withColumn("_n", within).join(base, ["shard", "_r1", "_r2"])
    return rows.withColumn("slot", (F.col("_n") + F.col("_base")).cast("long")).drop("_n", "_base", "_r1", "_r2")


def shard_map(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row; the texts themselves don't move."""
    found = shard(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), shards=shards)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
