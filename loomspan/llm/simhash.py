"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints of 64 bits are dealt to blocks by shared bits (pigeonhole: two that
differ in at most r bits agree on one of r + 1 bands). A block keeps its
fingerprints vertically: word p of a lane group holds bit p of 64 fingerprints.
One query is then compared with 64 others at once: XOR with each plane, added into
carry-save counters, and a lane group is abandoned when all 64 exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .common import components, cut, without

RADIUS = 3
SHINGLE = 3
BLOCK = 4096  # fingerprints in a block before it is dealt out by more bits
SEED = 42
_U = np.uint64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text: A-Z lowered, words split at ASCII white space, shingles
    with repeats hashed by XXH64 (seed 42). Fewer words than a shingle: the whole
    sequence is the one shingle. No word, or null: 0."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    one = xxhash.xxh64_intdigest
    h = np.fromiter((one(g, SEED) for g in grams), _U)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 65536):  # whole texts, in pieces that bound memory
        counts += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8)[:, ::-1], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], _U).view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), fp(F.col(text_col)).alias("fp"))


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of lane groups: fps has shape (groups, 64); result[p, g] holds bit p of the 64 in group g."""
    bits = np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(*fps.shape, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0]


def within(plane: np.ndarray, group: np.ndarray, query: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each (lane group, query fingerprint): a word whose bit l is 1 if lane l lies within radius.

    Distances grow in carry-save counter words, as many as the radius has bits; what
    leaves them sets the lane's dead bit. After every eight planes lanes above the
    radius die and groups with no lane left are abandoned."""
    n = len(group)
    out, live = np.zeros(n, _U), np.arange(n)
    counters, dead = [np.zeros(n, _U) for _ in range(max(1, radius.bit_length()))], np.zeros(n, _U)
    full = _U(0xFFFFFFFFFFFFFFFF)
    for p in range(64):
        carry = plane[p][group] ^ (_U(0) - ((query >> _U(p)) & _U(1)))
        for k, word in enumerate(counters):
            counters[k], carry = word ^ carry, word & carry
        dead |= carry
        if p % 8 == 7:
            dead |= _above(counters, radius)
            keep = np.flatnonzero(dead != full)
            if len(keep) < len(live):
                live, group, query, dead = live[keep], group[keep], query[keep], dead[keep]
                counters = [word[keep] for word in counters]
    out[live] = ~dead
    return out


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count is above the radius, highest counter bit first."""
    above, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above, equal = above | equal & counters[k], equal & ~counters[k]
    return above


def forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label after the links a-b: equal where linked, by hooking on the smaller label and pointer jumping."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (up := label[label]).tobytes() != label.tobytes():
            label = up


def block_pairs(key: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions within radius inside each block, some at a time, the greater position first. key is sorted; equal keys are one block."""
    n = len(key)
    if n < 2:
        return
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, n))
    # lane groups: 64 rows of one block each
    groups = (size + 63) // 64
    base = np.cumsum(groups) - groups
    block = np.repeat(np.arange(len(first)), size)
    rank = np.arange(n) - first[block]
    lane = np.zeros((int(groups.sum()), 64), _U)
    lane[base[block] + rank // 64, rank % 64] = fps
    plane = planes(lane)
    many = np.where(size[block] > 1, rank // 64 + 1, 0)  # a row meets its own group and those before it
    ends = np.cumsum(many)
    row0 = 0
    while row0 < n:
        row1 = max(row0 + 1, int(np.searchsorted(ends, (ends[row0 - 1] if row0 else 0) + 100_000, "right")))
        rows = np.arange(row0, row1)
        query = np.repeat(rows, many[row0:row1])
        group = base[block[query]] + np.arange(len(query)) - np.repeat(np.cumsum(many[row0:row1]) - many[row0:row1], many[row0:row1])
        hit = within(plane, group, fps[query], radius)
        some = np.flatnonzero(hit)
        for k in range(0, len(some), 2_000):
            part = some[k : k + 2_000]
            bits = np.unpackbits(hit[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, l = np.nonzero(bits)
            q = query[part[i]]
            other = first[block[q]] + (group[part[i]] - base[block[q]]) * 64 + l
            ok = other < q
            yield q[ok], other[ok]
        row0 = row1


def block_links(key: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each block: two arrays of positions."""
    label = np.arange(len(key))
    for a, b in block_pairs(key, fps, radius):
        label = forest(label, a, b)
    at = np.flatnonzero(label != np.arange(len(key)))
    return at, label[at]


def whole_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows that come sorted by block, in frames that hold whole blocks."""
    rest = None
    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        last = pdf["block"].iloc[-1] if len(pdf) else None
        start = int(np.searchsorted(pdf["block"].to_numpy(), last)) if len(pdf) else 0
        rest = pdf.iloc[start:]
        if start:
            yield pdf.iloc[:start]
    if rest is not None and len(rest) > 1:
        yield rest


def _compare(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_blocks(batches):
            yield _linked(pdf, radius)

    return run


def _linked(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    ids = pdf["id"].to_numpy()
    a, b = block_links(pdf["block"].to_numpy(), pdf["fp"].to_numpy().view(_U), radius)
    return pd.DataFrame({"a": ids[a], "b": ids[b]})


def _bands(free: list[int], pieces: int) -> list[list[int]]:
    return [[int(x) for x in part] for part in np.array_split(np.array(free), pieces)]


def _take(bits: list[int]):
    """The named bits of fp, side by side."""
    runs, parts, at = [], [], 0
    for x in bits:
        if runs and x == runs[-1][-1] + 1:
            runs[-1].append(x)
        else:
            runs.append([x])
    for run in runs:
        parts.append(F.shiftleft(F.shiftrightunsigned("fp", run[0]).bitwiseAND((1 << len(run)) - 1), at))
        at += len(run)
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between ids of (id, fp), fp unique, that connect what lies within radius bits.

    First the bands of 16 bits deal fingerprints to blocks. A block above `block`
    rows is dealt out again by bands of its remaining bits (each pair still meets),
    twice; what then is still too large is cut in chunks and every two chunks are
    compared. No block is dropped or capped. Returned are spanning forests: all
    connected fingerprints stay connected, though not each pair is a row."""
    pieces = radius + 1
    todo = [(fps.select("id", "fp", F.lit(0).cast("long").alias("up")), list(range(64)))]
    parts = []
    for level in range(3):
        wide: list[tuple[DataFrame, list[int]]] = []
        for rows, free in todo:
            bands = _bands(free, pieces)
            if level == 0:
                dealt = rows.select("id", "fp", F.posexplode(F.array(*[_take(b) for b in bands])).alias("band", "value"))
                dealt = dealt.withColumn("block", F.shiftleft(F.col("band").cast("long"), 58).bitwiseOR(F.col("value")))
            else:
                dealt = rows.select("id", "fp", F.posexplode(F.array(*[F.xxhash64("up", F.lit(i), _take(b)) for i, b in enumerate(bands)])).alias("band", "block"))
            sizes = dealt.groupBy("block").agg(F.count("*").alias("size"))
            large = cut(sizes.where(F.col("size") > block))
            if not large.isEmpty():
                over = dealt.join(large, "block")
                dealt = dealt.join(large.select("block"), "block", "left_anti")
                if level < 2:
                    for i, band in enumerate(bands):
                        wide.append((over.where(F.col("band") == i).select("id", "fp", F.col("block").alias("up")), [x for x in free if x not in band]))
                else:
                    parts.append(chunks(over, block).select("block", "id", "fp"))
            parts.append(dealt.select("block", "id", "fp"))
        todo = wide
        if not todo:
            break
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    rows = rows.repartition("block").sortWithinPartitions("block", "id")
    return rows.mapInPandas(_compare(radius), "a long, b long")


def chunks(over: DataFrame, block: int, id_col: str = "id") -> DataFrame:
    """Blocks of `size` rows, all oversize, in chunks of about block/2 rows; every two chunks of one are a block of their own."""
    dealt = over.withColumn("k", F.ceil(F.col("size") / F.lit(block // 2)).cast("int")).withColumn("c", F.pmod(F.xxhash64(id_col), F.col("k")).cast("int"))
    meets = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).where("o <> c")
    return meets.withColumn("block", F.xxhash64("block", F.least("c", "o"), F.greatest("c", "o"))).drop("size", "k", "c", "o")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    Fingerprints link at radius or fewer differing bits; component_id is the
    smallest doc_id reachable. Null and wordless texts have fingerprint 0 and link
    like any other. Repeated rows stay. A row with null doc_id gets its component
    but carries no link of its own; if no row has an id, the component is null.
    Columns beside the two named are not read. Empty tables give empty results."""
    sig = cut(fingerprints(docs, id_col, text_col, shingle))
    reps = sig.groupBy("fp").agg(F.min("doc_id").alias("id"))
    found = components(links(reps.where("id is not null"), radius, block))
    classes = reps.join(found, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return sig.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, similarity: float = near_copies.SIMILARITY, shingle: int = near_copies.SHINGLE) -> DataFrame:
    """docs with one document of each group of near copies: the one with the smallest doc_id, once.

    Near copies are texts of Jaccard similarity 0.8 or more over shingles of five
    words, linked over each other. Their fingerprints lie about 10 of 64 bits apart,
    where bands of bits deal to blocks no more, so blocks are dealt by the rarest
    shingles; inside a block fingerprints are compared by bit planes with a wide
    radius, and the pairs found are compared whole. Of rows that share a doc_id one
    stays (the greatest text, then the others of its columns). Rows without a doc_id stay, as nothing can
    name them. An empty table gives an empty one."""
    found = cut(near_copies.groups(docs, shingle, similarity))
    left = without(docs, found.where("doc_id <> component_id"))
    twice = cut(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if twice.isEmpty():
        return left
    again = left.join(twice, "doc_id", "left_semi").select(F.struct("text", *[c for c in docs.columns if c != "text"]).alias("row"))
    again = again.groupBy(F.col("row.doc_id").alias("key")).agg(F.max("row").alias("row")).select("row.*").select(*docs.columns)
    return without(left, twice).unionByName(again)
