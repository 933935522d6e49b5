"""Prefix trie of conversations, and sums over its subtrees by centroid decomposition.

A node is a distinct sequence of first turns; it is named by its depth and 128 bits of
hashes of its turns, so texts don't move. Sums over subtrees come from the edges to
parents alone: a component is split at its centroid (no part that is left has over
half of its nodes), the totals of what hangs below are added along the path from the
centroid to the component's top, and the parts are split in turn. Components of up to
MOST nodes are decomposed in one task each; larger ones are split by joins until they
are that small, which takes as many rounds as halvings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

CHUNK_BITS = 10  # turns of a conversation are numbered and hashed in chunks of 1024
HEAVY = 1 << 16  # turns in a chunk of turn numbers before those are dealt out again
MOST = 16_384  # nodes that one task decomposes
ENDS_BITS = 12  # conversation ids are joined in stretches of 4096
_NONE = -(1 << 63)


def numbered(conversations: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(conv_id, position, c0, c1, words) of each turn: its place in its conversation from 1, two hashes of role and text, and the words of the text.

    Turns go by turn, null first, turns of one number by their hashes. Null roles and
    texts are empty; rows without a conv_id take no part. A conversation is numbered in
    chunks of turn numbers, and those of too many rows again by the hashes, so that no
    task holds a whole long one."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(F.lit(0), role, text).alias("c0"),
        F.xxhash64(F.lit(1), role, text).alias("c1"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    ).withColumns({"b1": F.coalesce(F.shiftright("turn", CHUNK_BITS), F.lit(_NONE)), "b2": F.lit(_NONE), "b3": F.lit(0).cast("long")})
    key = ["conv_id", "b1", "b2", "b3"]
    over = cut(rows.groupBy("conv_id", "b1").agg(F.count("*").alias("m")).where(F.col("m") > heavy).select("conv_id", "b1", F.lit(True).alias("over")))
    if not over.isEmpty():
        rows = rows.join(over, ["conv_id", "b1"], "left")
        rows = rows.withColumns({"b2": F.when(F.col("over"), F.coalesce("turn", F.lit(_NONE))).otherwise(F.col("b2")), "b3": F.when(F.col("over"), F.shiftright("c0", 48)).otherwise(F.col("b3"))}).drop("over")
    sizes = rows.groupBy(*key).agg(F.count("*").alias("m"))
    base = sizes.select(*key, (F.sum("m").over(Window.partitionBy("conv_id").orderBy("b1", "b2", "b3")) - F.col("m")).alias("before"))
    within = F.row_number().over(Window.partitionBy(*key).orderBy(F.asc_nulls_first("turn"), "c0", "c1"))
    return rows.join(base.hint("merge"), key).select("conv_id", (F.col("before") + within).alias("position"), "c0", "c1", "words")


def planted(turns: DataFrame, every: int = 20) -> tuple[DataFrame, DataFrame]:
    """The turns with the shared openings of the query's contract, and (conv_id, length) of all conversations, turnless ones too.

    The first h turns of conversation c - c % 20 stand before c's own after its first
    h; h is crc32 of the id, modulo 4."""
    turns = cut(turns)
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = counts.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4, "base": F.col("conv_id") - F.col("conv_id") % every})
    bases = counts.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    convs = cut(convs.join(bases.hint("merge"), "base", "left").withColumn("got", F.least("h", F.coalesce("there", F.lit(0)))).select("conv_id", "base", "n", "h", "got"))
    opening = turns.where("position <= 3").withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "h").hint("merge"), "base").where("position <= h")
    own = turns.join(convs.select("conv_id", "h", "got").hint("merge"), "conv_id").where("position > h").withColumn("position", F.col("position") - F.col("h") + F.col("got"))
    keep = ["conv_id", "position", "c0", "c1", "words"]
    return opening.select(*keep).union(own.select(*keep)), convs.select("conv_id", (F.col("got") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def prefixes(turns: DataFrame) -> DataFrame:
    """turns with k0, k1, which name the sequence up to each of them, and p0, p1, which name the one before it.

    Hashes of (position, turn) are combined by exclusive or, so a long conversation is
    hashed in chunks and what lies before a chunk is one value."""
    rows = turns.withColumns({"x0": F.xxhash64("position", "c0"), "x1": F.xxhash64("position", "c1"), "chunk": F.shiftright(F.col("position") - 1, CHUNK_BITS)})
    so_far = Window.partitionBy("conv_id", "chunk").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"k{i}": F.bit_xor(f"x{i}").over(so_far) for i in (0, 1)})
    longest = turns.agg(F.max("position")).first()[0] or 0
    if longest > 1 << CHUNK_BITS:
        before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        chunks = rows.groupBy("conv_id", "chunk").agg(*[F.bit_xor(f"x{i}").alias(f"x{i}") for i in (0, 1)])
        carry = chunks.select("conv_id", "chunk", *[F.coalesce(F.bit_xor(f"x{i}").over(before), F.lit(0)).alias(f"y{i}") for i in (0, 1)])
        rows = rows.join(carry.hint("merge"), ["conv_id", "chunk"]).withColumns({f"k{i}": F.col(f"k{i}").bitwiseXOR(F.col(f"y{i}")) for i in (0, 1)})
    return rows.select("conv_id", "position", "words", "k0", "k1", *[F.col(f"k{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i in (0, 1)])


def decompose(parent: list[int], values: list[list[int]]) -> list[list[int]]:
    """Sums of each column of values over the subtree of every node of a forest, by centroids. A top's parent is below 0."""
    below: list[list[int]] = [[] for _ in parent]
    work = []
    for i, p in enumerate(parent):
        (below[p] if p >= 0 else work).append(i)
    out, size = [[0] * len(parent) for _ in values], [1] * len(parent)
    parts = []
    for top in work:  # each tree in preorder, so that what lies below a node is a stretch
        order, stack = [], [top]
        while stack:
            order.append(i := stack.pop())
            stack.extend(below[i])
        parts.append(order)
    while parts:
        part = parts.pop()
        n = len(part)
        for i in part:
            size[i] = 1
        for i in part[:0:-1]:
            size[parent[i]] += size[i]
        # nodes with half of the part below them form a chain from the top; the last is the centroid
        k = next(k for k in range(n - 1, -1, -1) if 2 * size[part[k]] >= n)
        end = k + size[part[k]]
        for column, sums in zip(values, out):
            total, a = sum(column[i] for i in part[k:end]), part[k]
            sums[a] += total
            while a != part[0]:
                a = parent[a]
                sums[a] += total
        if n - end + k:
            parts.append(part[:k] + part[end:])
        k += 1
        while k < end:
            parts.append(part[k : k + size[part[k]]])
            k += size[part[k]]
    return out


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of whole blocks, of rows that come sorted by block."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        at = int(np.searchsorted(pdf["block"].to_numpy(), pdf["block"].iloc[-1])) if len(pdf) else 0
        if at:
            yield pdf.iloc[:at]
        rest = pdf.iloc[at:]
    if rest is not None and len(rest):
        yield rest


def _local(names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole(batches):
            ids, up = pdf["id"].to_numpy(), pdf["parent"].to_numpy()
            order = np.argsort(ids)
            parent = np.where(up == ids, -1, order[np.searchsorted(ids, up, sorter=order)])
            sums = decompose(parent.tolist(), [pdf[c].tolist() for c in names])
            yield pd.DataFrame({"id": ids} | dict(zip(names, sums)))

    return run


def _tops(edges: DataFrame) -> DataFrame:
    """(id, label): the top above each node of (id, parent), by pointer jumping; settled nodes leave the joins."""
    state = cut(edges.select("id", F.coalesce("parent", "id").alias("label"), F.col("parent").isNull().alias("settled")))
    while not state.where("not settled").isEmpty():
        up = state.select(F.col("id").alias("label"), F.col("label").alias("to"), F.col("settled").alias("there"))
        moved = state.where("not settled").join(up.hint("merge"), "label").select("id", F.col("to").alias("label"), F.col("there").alias("settled"))
        state = cut(state.where("settled").union(moved))
    return state.select("id", "label")


def _split(rows: DataFrame, names: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """Every component of rows (id, parent, label, values) split at its centroid: the rows left under their new labels, and what paths gain.

    label is the component's top, whose parent is null. Where no part below the top
    has over half of the nodes, the top is the centroid and its path is itself; only
    for other components are sizes and paths worked out."""
    total = [F.sum(c).alias(c) for c in names]
    below = rows.where("id <> label").select("id", F.when(F.col("parent") != F.col("label"), F.col("parent")).alias("parent"), F.col("label").alias("top"), *names)
    below = cut(below.join(_tops(below).hint("merge"), "id"))
    parts = below.groupBy("top", "label").agg(F.count("*").alias("n")).groupBy("top").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    tall = cut(parts.where("2 * most > n + 1").select(F.col("top").alias("label")))  # one row a component of over MOST nodes, at most
    bushes = below.join(tall.select(F.col("label").alias("top")), "top", "left_anti")
    whole = bushes.select(F.col("top").alias("id"), *names).union(rows.where("id = label").join(tall, "label", "left_anti").select("id", *names))
    left, gains = bushes.select("id", "parent", "label", *names), [whole.groupBy("id").agg(*total)]
    if not tall.isEmpty():
        more, gain = _split_tall(cut(rows.join(tall, "label", "left_semi").select("id", "parent", "label", *names)), names)
        left, gains = left.union(more), [*gains, gain]
    return left, gains


def _split_tall(rows: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """_split where the centroid lies below the top: sizes and paths by doubling."""
    sizes = cut(rows.select("id", "label", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size")))
    steps = []
    while True:  # after k rounds: nodes within 2**k steps below, and the node 2**k steps above
        steps.append(sizes.where("up is not null").select("id", "up"))
        if steps[-1].isEmpty():
            break
        more = sizes.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("more"))
        far = sizes.where("up <> label").join(sizes.select(F.col("id").alias("up"), F.col("up").alias("far")).hint("merge"), "up").select("id", "far")
        sizes = cut(sizes.join(more.hint("merge"), "id", "left").join(far.hint("merge"), "id", "left").select("id", "label", F.col("far").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
    tops = sizes.where("id = label").select("label", F.col("size").alias("n"))
    centre = cut(sizes.join(tops, "label").where("2 * size >= n").groupBy("label").agg(F.min(F.struct("size", "id"))["id"].alias("centre")))
    rows = cut(rows.join(centre, "label").withColumn("below", F.coalesce(F.col("parent") == F.col("centre"), F.lit(False))))
    left = rows.where("id <> centre").select("id", F.when(~F.col("below"), F.col("parent")).alias("parent"), "centre", "below", *names)
    left = cut(left.join(_tops(left).hint("merge"), "id"))
    # totals of the parts that hang on a centroid, each combined before it moves
    hung = left.where("below").select(F.col("id").alias("label"), "centre")
    totals = left.groupBy("label").agg(*[F.sum(c).alias(c) for c in names]).join(hung.hint("merge"), "label").select("centre", *names)
    totals = totals.union(rows.where("id = centre").select("centre", *names)).groupBy("centre").agg(*[F.sum(c).alias(c) for c in names])
    path = cut(centre.select("centre", F.col("centre").alias("id")))
    for step in steps[:-1]:
        path = cut(path.union(path.join(step.hint("merge"), "id").select("centre", F.col("up").alias("id"))))
    return left.select("id", "parent", "label", *names), cut(path.join(totals, "centre").select("id", *names))


def subtree_sums(nodes: DataFrame, names: list[str], most: int = MOST) -> DataFrame:
    """(id, *names): the sums of the long columns `names` over the subtree of each node of a forest (id, parent), itself included.

    Ids are unique longs; a null parent makes a top, any other must be an id of the
    table. Values that are null count as 0. An empty table gives an empty one."""
    rows = nodes.select("id", "parent", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in names])
    tops = rows.where("parent is null").select("id").limit(2).collect()
    rows = rows.withColumn("label", F.lit(tops[0][0])) if len(tops) == 1 else rows.join(_tops(cut(rows)).hint("merge"), "id")
    rows, parts, gains = cut(rows.select("id", "parent", "label", *names)), [], []
    while True:
        large = cut(rows.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > most).select("label"))
        if large.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(large, "label", "left_anti").select(rows.columns))
        rows, more = _split(cut(rows.join(large, "label", "left_semi").select(rows.columns)), names)
        rows, gains = cut(rows), gains + more
    small = reduce(DataFrame.union, parts).select(F.col("label").alias("block"), "id", F.coalesce("parent", "id").alias("parent"), *names)
    schema = ", ".join(f"{c} long" for c in ("id", *names))
    sums = small.repartition("block").sortWithinPartitions("block", "id").mapInPandas(_local(names), schema)
    if not gains:
        return sums
    return reduce(DataFrame.union, [sums, *gains]).groupBy("id").agg(*[F.sum(c).alias(c) for c in names])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the id lists that come in stretches, sorted by node: one running hash, however long a list is."""
    key, running, out = None, None, []
    for batch in batches:
        for *now, part in zip(*(c.to_pylist() for c in batch.columns)):
            if now != key:
                if key:
                    out.append((*key, running.hexdigest()))
                key, running = now, hashlib.sha256(part.encode())
            else:
                running.update(b",")
                running.update(part.encode())
        if len(out) > 10_000:
            yield _hashes(out)
            out = []
    if key:
        out.append((*key, running.hexdigest()))
    yield _hashes(out)


def _hashes(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [[]] * 4
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], ["position", "k0", "k1", "ends_sha256"])


def prefix_trie(turns: DataFrame, convs: DataFrame, most: int = MOST) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: (conv_id, position, c0, c1, words) of `numbered`; convs: (conv_id, length) of
    every conversation once, also those without turns, which are members of the root
    alone. saved_tokens sums words times (members - 1) over the subtree: what is not
    computed again where prefixes are shared. Equal conversations share all nodes; no
    list of members is gathered, their ids are hashed as a stream. No conversation, no root."""
    rows = cut(prefixes(turns))
    key = ["position", "k0", "k1"]
    nodes = rows.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p0").alias("p0"), F.min("p1").alias("p1"), F.min("words").alias("words"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in key], "conv_id", "n_convs", F.lit(None).cast("long").alias("p0"), F.lit(None).cast("long").alias("p1"), zero.alias("words"))
    nodes = cut(nodes.unionByName(root)).withColumn("id", F.monotonically_increasing_id())  # a checkpoint's partitions stay
    above = nodes.select((F.col("position") + 1).alias("position"), F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    cols = ["id", *key, "conv_id", "n_convs", "words", "parent", "parent_conv_id"]
    edges = nodes.where("position > 1").join(above.where("position > 1").hint("merge"), ["position", "p0", "p1"]).select(*cols)
    first = nodes.where("position = 0").select("id", "conv_id").first() or (None, None)  # the root, above all that start
    top = nodes.where("position <= 1").withColumns({c: F.when(F.col("position") == 1, F.lit(v).cast("long")) for c, v in zip(cols[-2:], first)})
    edges = cut(edges.union(top.select(*cols)))
    children = edges.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    full = cut(edges.join(children.hint("merge"), "id", "left").withColumn("n_children", F.coalesce("n_children", zero)))
    sums = subtree_sums(full.select("id", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), ["n_leaves", "saved_tokens"], most)

    last = rows.groupBy("conv_id").agg(F.max(F.struct("position", "k0", "k1")).alias("e")).select("conv_id", "e.*")
    last = last.union(convs.where("length = 0").select("conv_id", *[zero.alias(c) for c in key]))
    parts = last.groupBy(*key, F.shiftright("conv_id", ENDS_BITS).alias("stretch")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("part"))
    ends = parts.repartition(*key).sortWithinPartitions(*key, "stretch").select(*key, "part").mapInArrow(_joined, "position long, k0 long, k1 long, ends_sha256 string")
    found = full.join(sums.hint("merge"), "id").join(ends.hint("merge"), key, "left")
    return found.select("conv_id", F.col("position").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
