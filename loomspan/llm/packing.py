"""Best-fit packing of token sequences, large items matched first.

Lengths are whole numbers up to the capacity, so the packing is decided on the
histogram of lengths, whose size the capacity bounds: pieces above a third of it
are matched, at most two in a bin, and smaller ones go by best fit, longest first,
into the gaps that remain. The plan (some thousand rows at any corpus size) says
which ranks of which length lie where; pieces get ranks in a distributed way.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slim
from .tokens import encoder, tokenizer_path

CAPACITY = 1024
END_ID = 2
TEXTS = 512  # encoded at once; with tokens.PART this bounds a task's arrays
RANK_ROWS = 500_000  # rows that are numbered together, on average
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut_pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                some = batch.slice(k, TEXTS)
                ids, ends = enc.encode(some.column(1))
                raw = memoryview(ids.astype("<u4").tobytes())
                out: list[tuple] = []
                for key, a, b in zip(some.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                    n = b - a + 1
                    at, piece = 0, 0
                    size = n % capacity or capacity
                    while at < n:
                        last = at + size == n
                        crc = zlib.crc32(raw[4 * (a + at) : 4 * (a + at + size - last)])
                        out.append((key, piece, at, size, zlib.crc32(end, crc) if last else crc))
                        at, piece, size = at + size, piece + 1, capacity
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents as ids with end_id last, cut into full pieces; the first may be shorter."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(slim(_cut_pieces(tokenizer or tokenizer_path(), capacity, end_id)), PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Rows (length, first, last, sequence, offset): the pieces of that length with ranks first to last - 1 lie in sequences sequence, sequence + 1, ... at offset."""
    gaps: dict[int, list[list]] = {}  # gap -> groups [bins, [(length, first rank), ...]] of alike bins
    order: list[int] = []

    def put(gap: int, group: list) -> None:
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(order, gap)
        gaps[gap].append(group)

    def take(gap: int, most: int) -> list:
        """A group of at most so many bins, split off if need be."""
        group = gaps[gap].pop()
        if group[0] > most:
            gaps[gap].append([group[0] - most, [(n, r + most) for n, r in group[1]]])
            group = [most, group[1]]
        if not gaps[gap]:
            del gaps[gap]
            order.remove(gap)
        return group

    large = sorted((n for n in counts if 3 * n > capacity), reverse=True)
    left = {n: counts[n] for n in large}
    rank = dict.fromkeys(counts, 0)
    ascending = large[::-1]
    for n in large:
        while left[n]:
            # the largest partner that still fits
            k = bisect.bisect_right(ascending, capacity - n) - 1
            while k >= 0 and (left[ascending[k]] == 0 or ascending[k] == n and left[n] < 2):
                k -= 1
            if k < 0:
                put(capacity - n, [left[n], [(n, rank[n])]])
                rank[n], left[n] = rank[n] + left[n], 0
                break
            m = ascending[k]
            bins = left[n] // 2 if m == n else min(left[n], left[m])
            group = [bins, [(n, rank[n])]]
            rank[n], left[n] = rank[n] + bins, left[n] - bins
            group[1].append((m, rank[m]))
            rank[m], left[m] = rank[m] + bins, left[m] - bins
            put(capacity - n - m, group)
    for n in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
        todo = counts[n]
        while todo:
            k = bisect.bisect_left(order, n)
            gap = order[k] if k < len(order) else capacity
            if k == len(order):
                put(capacity, [-(-todo // (capacity // n)), []])
            each = min(gap // n, todo)  # best fit stays with a bin while it has room
            group = take(gap, todo // each)
            for _ in range(each):
                group[1].append((n, rank[n]))
                rank[n] += group[0]
            todo -= each * group[0]
            put(gap - each * n, group)
    rows, sequence = [], 0
    for groups in gaps.values():
        for bins, held in groups:
            offset = 0
            for n, first in held:
                rows.append((n, first, first + bins, sequence, offset))
                offset += n
            sequence += bins
    return pd.DataFrame(rows, columns=["length", "first", "last", "sequence", "offset"]).sort_values(["length", "first"], ignore_index=True)


def _placing(table: pd.DataFrame):
    first_of = {n: g for n, g in table.groupby("length")}
    arrays = {n: tuple(g[c].to_numpy() for c in ("first", "sequence", "offset")) for n, g in first_of.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sequence, offset = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            by = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[by])) + 1
            for at in np.split(by, cuts):
                first, seq, off = arrays[length[at[0]]]
                k = np.searchsorted(first, rank[at], "right") - 1
                sequence[at], offset[at] = seq[k] + rank[at] - first[k], off[k]
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def ranked(rows: DataFrame, parts: int) -> DataFrame:
    """rows with rank: a number from 0 without gaps within each length. A length may hold any share of the rows: it is numbered in many parts."""
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int")
    rows = rows.withColumn("part", part)
    sizes = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    # at most capacity x parts rows
    base = sizes.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece")) - 1
    return rows.withColumn("rank", within).join(base, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base")).drop("part", "base")


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (doc_id, piece, length, ...) with sequence_id and offset: no sequence above capacity, offsets gapless from 0.

    Lengths must be 1 to capacity. Repeated rows are packed each; empty tables give empty results."""
    rows = cut(rows)
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).toLocalIterator()}  # at most capacity rows
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError(f"lengths must be 1 to {capacity}")
    out = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", sequence_id long, offset long"
    parts = max(64, -(-sum(counts.values()) // RANK_ROWS))
    return ranked(rows, parts).select(*rows.columns, "rank").mapInArrow(_placing(plan(counts, capacity)), out)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of docs. Null texts are empty: one piece, the end id."""
    found = pack(pieces(docs, id_col, text_col, capacity, tokenizer, end_id), capacity)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
