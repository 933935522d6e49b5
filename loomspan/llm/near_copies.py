"""Near copies by exact Jaccard similarity of word shingles.

Two sets of similarity t or more share one of the first n - ceil(t n) + 1 of their
n shingles in any order that all sets keep (prefix filter), so no pair is lost to
chance, as it would be to bands of a fingerprint. The order here is rare shingles
first, so that passages many texts share don't nominate pairs. Every row of a block
knows how many of its text's shingles come earlier in that order: at the first
shingle that two texts share, no more than what comes from there on can be common,
so a block whose places leave too little for the similarity doesn't nominate the
pair (positional filter; places only grow from block to block, and a pair that is
similar passes at its first one). Nominated pairs are compared whole; pairs that
are connected already are not compared. In a block of
texts that share a rare shingle, fingerprints are compared first, by bit planes:
at similarity 0.8 each of the 64 bits differs with a chance of about 0.16,
independently, so more than RADIUS bits do so for fewer than one pair in ten
million. Texts of few shingles, where that doesn't hold, are not told apart so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_IDS, among, components, cut, slim
from .decontamination import _B, _KIND, _U, _bytes, _mix, _word_hash

SHINGLE = 5
SIMILARITY = 0.8
COUNTER_BITS = 18  # counters of shingles for the order: 262,144 at any size
STARS = 8  # rounds against one pivot a block, at most, before all that is left is compared
EASY = 0.5  # so many pairs a row may be left for that
STALLED = 0.7  # or that share of the pairs is left by a round
RADIUS = 28  # bits of the fingerprint
FEW = 64  # shingles: pairs with a smaller set are compared whole without a look at fingerprints
BLOCK = 4096  # rows of a block that one task compares
_STEP = 1 << 20


def shingles(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, bounds, signatures) of the different shingles of each text data[offsets[i]:offsets[i + 1]].

    Words are split at ASCII white space, A-Z lowered; fewer words than a shingle are
    one. A signature names the set (0: no word)."""
    n_docs = len(offsets) - 1
    kind = _KIND[data]
    gap = kind == 1
    first = np.ones(len(data) + 1, bool)
    first[1:] = np.concatenate([gap, [True]])[:-1] if len(data) else True
    first[offsets] = True
    start = np.flatnonzero(first[: len(data)] & ~gap)
    if not len(start):
        return np.zeros(0, _U), np.zeros(n_docs + 1, np.int64), np.zeros(n_docs, _U)
    stop = np.append(np.flatnonzero(gap), len(data))
    end = np.minimum(stop[np.searchsorted(stop, start)], offsets[np.searchsorted(offsets, start, "right")])
    doc = np.searchsorted(offsets, start, "right") - 1
    low = np.where(kind == 3, data + 32, data).astype(np.uint8)
    word = _word_hash(low, start, end, np.ones(len(data), bool))
    begin = np.searchsorted(doc, np.arange(n_docs + 1))
    size = np.minimum(np.diff(begin), shingle)[doc]  # words in a shingle of this text
    at = np.flatnonzero(np.arange(len(word)) + size <= begin[doc + 1])
    h = np.zeros(len(at), _U)
    for k in range(shingle):
        more = size[at] > k
        h[more] = _mix(h[more] * _B + word[at[more] + k] + _U(k + 1))
    doc = doc[at]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
    h, doc = h[new], doc[new]
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    total = np.concatenate([np.zeros(1, _U), np.cumsum(_mix(h + _U(1)), dtype=_U)])
    n = np.diff(bounds)
    sig = np.where(n > 0, _mix(total[bounds[1:]] - total[bounds[:-1]] + n.astype(_U) * _B), _U(0))
    return h, bounds, sig


def fingerprints(h: np.ndarray, bounds: np.ndarray, step: int = 65536) -> np.ndarray:
    """SimHash of each set h[bounds[i]:bounds[i + 1]]: a bit is 1 if set in over half of the hashes."""
    n = len(bounds) - 1
    total = np.zeros((n, 64), np.int32)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    for k in range(0, len(h), step):  # in pieces that bound memory
        bits = np.unpackbits(h[k : k + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        part = doc[k : k + step]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        total[part[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    over = 2 * total > np.diff(bounds)[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8")[:, 0] if n else np.zeros(0, _U)


def _parts(batches: Iterator[pa.RecordBatch], shingle: int):
    """(ids, hashes, bounds, signatures) of some texts at once, to bound memory; a text is never cut."""
    for batch in batches:
        data, offsets = _bytes(batch.column(1))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _STEP, "right")) - 1)
            yield batch.column(0).slice(i, j - i), *shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
            i = j


def _signatures(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text; at the end the partition's counters, as rows without an id."""
        counters = np.zeros(1 << COUNTER_BITS, np.int64)
        for ids, h, bounds, sig in _parts(batches, shingle):
            counters += np.bincount((h >> _U(64 - COUNTER_BITS)).astype(np.int64), minlength=len(counters))
            fps = fingerprints(h, bounds)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sig.view(np.int64)), pa.array(np.diff(bounds)), pa.array(fps.view(np.int64))], ["doc_id", "sig", "n", "fp"])
        used = np.flatnonzero(counters)
        for k in range(0, len(used), 50_000):
            some = used[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.array(some), pa.array(counters[some]), pa.nulls(len(some), pa.int64())], ["doc_id", "sig", "n", "fp"])

    return run


def _prefixes(counters: np.ndarray, shingle: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, bounds, sig in _parts(batches, shingle):
            n = np.diff(bounds)
            doc = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, counters[h >> _U(64 - COUNTER_BITS)], doc))
            long = n - np.ceil(n * similarity - 1e-6).astype(np.int64) + 1
            h, place = h[order], np.arange(len(h)) - bounds[doc]
            keep = place < long[doc]
            h, doc, place = h[keep], doc[keep], place[keep]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(sig[doc].view(np.int64)), pa.array(place.astype(np.int32))], ["token", "sig", "place"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (token, sig, ...) sorted by both: one of each, for tokens that have more than one sig. Nothing but one row waits for the next batch."""
    last, known = None, False  # the last row, and whether its token is known to be shared
    for batch in batches:
        rows = [c.to_numpy() for c in batch.columns]
        token, sig, *_ = rows = rows if last is None else [np.concatenate(x) for x in zip(last, rows)]
        if not len(token):
            continue
        same = np.concatenate([[False], token[1:] == token[:-1]])
        new = ~(same & np.concatenate([[False], sig[1:] == sig[:-1]]))
        new[0] = not known  # a row that waited is out already if its token was known to be shared
        group = np.cumsum(~same) - 1
        kinds = np.bincount(group, new)
        kinds[0] += known
        out = new & ((kinds > 1)[group] | (known & (group == 0)))
        # the last group may go on: if it has one kind so far, that row waits
        waits = kinds[-1] == 1 and not (known and group[-1] == 0)
        yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in rows], batch.schema.names)
        last, known = [x[-1:] for x in rows], not waits


def _different(met: DataFrame) -> DataFrame:
    """The blocks (token, sig, place) without those of just the same texts as another: a shared passage has many shingles, and the first of them in the order does.

    As all texts keep one order, that is the one whose places add up to least. Sets are
    told apart by their size and 128 bits of hash sums (by exclusive or, as members are unique)."""
    same = met.groupBy("token").agg(F.count("*").alias("c"), F.sum("place").alias("places"), *[F.bit_xor(F.xxhash64("sig", F.lit(k))).alias(f"h{k}") for k in (0, 1)])
    one = same.groupBy("c", "h0", "h1").agg(F.min_by("token", "places").alias("token")).select("token")
    return met.join(one, "token", "left_semi")


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, bounds, sig in _parts(batches, shingle):
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), lists], ["sig", "items"])

    return run


def _near(a: str, b: str, similarity: float) -> Column:
    """Sizes that allow the similarity."""
    return F.least(a, b) >= F.greatest(a, b) * F.lit(similarity) - F.lit(1e-6)


def _room(n: str, place: str, other: str, similarity: float) -> Column:
    """From this place on a text of n shingles has as many as it must share with one of `other` shingles."""
    return F.col(n) - F.col(place) >= (F.col(n) + F.col(other)) * F.lit(similarity / (1 + similarity)) - F.lit(1e-6)


def _stars(rows: DataFrame, turn: int, similarity: float, radius: int) -> DataFrame:
    """Each row with the pivot of its block, unless connected or told apart by fingerprints.

    The first pivots are the texts that share most of their rare shingles, as the
    source of many edited copies does; later ones are drawn by hash."""
    rank = F.lit(0.0) if turn else F.col("hub")
    pivots = rows.groupBy("token").agg(F.max(F.struct(rank.alias("rank"), F.xxhash64("sig", F.lit(turn)).alias("key"), "sig", "n", "comp", "fp", "place")).alias("p"))
    alike = (F.bit_count(F.col("fp").bitwiseXOR(F.col("p.fp"))) <= radius) | (F.least("n", "p.n") < FEW)
    room = _room("n", "place", "p.n", similarity) & _room("p.n", "p.place", "n", similarity)
    met = rows.join(pivots, "token").where((F.col("comp") != F.col("p.comp")) & _near("n", "p.n", similarity) & room & alike)
    return met.select(F.least("sig", "p.sig").alias("a"), F.greatest("sig", "p.sig").alias("b")).distinct()


def _apart(items: list[bytes], x: np.ndarray, y: np.ndarray, similarity: float, step: int = 1 << 20) -> np.ndarray:
    """Whether the histograms of x and y differ by more than two sets of that similarity can (empty ones don't). The finer one is added up to the other's parts, some pairs at once: step bytes of a side."""
    size = np.fromiter(map(len, items), np.int64, len(items))
    out = np.zeros(len(x), bool)
    known = np.flatnonzero((size[x] > 0) & (size[y] > 0))
    kind = size[x[known]] << 32 | size[y[known]]
    for k in np.unique(kind).tolist():
        parts = min(k >> 32, k & 0xFFFFFFFF)
        these = known[kind == k]
        many = max(1, step // max(k >> 32, k & 0xFFFFFFFF))
        for i in range(0, len(these), many):
            some = these[i : i + many]
            p, q = (np.frombuffer(b"".join(items[j] for j in z[some].tolist()), np.uint8).reshape(len(some), parts, -1).sum(axis=2, dtype=np.int32) for z in (x, y))
            most = (1 - similarity) / (1 + similarity) * (p.sum(axis=1) + q.sum(axis=1)) + 1e-6
            out[some] = np.abs(p - q).sum(axis=1) > most
    return out


def _planes(similarity: float, radius: int):
    from .simhash import block_pairs, whole_blocks

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_blocks(batches):
            sig, n, comp, place = (pdf[c].to_numpy() for c in ("sig", "n", "comp", "place"))
            items = pdf["items"].tolist()
            for x, y in block_pairs(pdf["block"].to_numpy(), pdf["fp"].to_numpy().view(_U), radius):
                met = (comp[x] != comp[y]) & (np.minimum(n[x], n[y]) >= np.maximum(n[x], n[y]) * similarity - 1e-6)
                met &= np.minimum(n[x] - place[x], n[y] - place[y]) >= (n[x] + n[y]) * (similarity / (1 + similarity)) - 1e-6
                if radius == 64:
                    met &= np.minimum(n[x], n[y]) < FEW
                x, y = x[met], y[met]
                a, b = np.minimum(sig[x], sig[y]), np.maximum(sig[x], sig[y])
                order = np.lexsort((b, a))  # texts meet in many blocks
                new = np.concatenate([[True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)]) if len(a) else order
                at = order[new]
                at = at[~_apart(items, x[at], y[at], similarity)]
                yield pd.DataFrame({"a": a[at], "b": b[at]})

    return run


def _crossing(rows: DataFrame, texts: DataFrame, reps: DataFrame, shingle: int, similarity: float, radius: int) -> DataFrame:
    """The pairs of a block that are not connected, found by bit planes, of which histograms allow the similarity. Those of few shingles all meet.

    A block of over BLOCK rows goes in chunks, so that none is gathered in one task; every two chunks meet."""
    from .simhash import chunks

    ids = cut(reps.join(rows.select("sig").distinct(), "sig", "left_semi").select(F.col("id").alias("doc_id")))
    items = among(texts, ids, ids.count()).mapInArrow(slim(_histograms(shingle, 2)), "sig long, items binary").dropDuplicates(["sig"])
    each = rows.select(F.col("token").alias("block"), "sig", "n", "comp", "fp", "place")
    large = cut(each.groupBy("block").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK))
    if not large.isEmpty():
        whole = each.join(large, "block", "left_anti")
        each = whole.unionByName(chunks(each.join(large, "block"), BLOCK, "sig"))
    each = each.join(items, "sig")
    sides = ((each.where(F.col("n") >= FEW), radius), (each.where(F.col("n") < FEW / similarity), 64))
    found = [x.repartition("block").sortWithinPartitions("block", "sig").mapInPandas(slim(_planes(similarity, r)), "a long, b long") for x, r in sides]
    return found[0].union(found[1]).distinct()


def _histograms(shingle: int, halvings: int):
    """Per text: how many of its n hashes fall in each equal part of their range; empty where a byte can't hold that.

    There are n parts, rounded down to a power of two and halved so many times. Coarse
    ones go along with each row of a block, finer ones with the pairs left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, bounds, sig in _parts(batches, shingle):
            found = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                bits = min(16, max(4, int(b - a).bit_length() - halvings))
                count = np.bincount((h[a:b] >> _U(64 - bits)).astype(np.int64), minlength=1 << bits)
                found.append(count.astype(np.uint8).tobytes() if count.max() < 256 else b"")
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(found, pa.binary())], ["sig", "items"])

    return run


def _plausible(similarity: float):
    """Pairs whose histograms don't differ too much: none of that similarity is lost."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            items = [x or b"" for x in (*pdf["x"], *pdf["y"])]
            at = np.arange(len(pdf))
            yield pdf.loc[~_apart(items, at, at + len(pdf), similarity), ["a", "b"]]

    return run


def _together(pairs: DataFrame, rows: DataFrame, reps: DataFrame, make, kind: str) -> DataFrame:
    """(a, b, x, y): the pairs with what make gives for the texts of their sides; only the texts that are named are read."""
    sigs = pairs.select(F.explode(F.array("a", "b")).alias("sig"))
    ids = cut(reps.join(sigs.distinct(), "sig", "left_semi").select(F.col("id").alias("doc_id")))
    items = among(rows, ids, ids.count()).mapInArrow(make, f"sig long, items {kind}")
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("sig"))
    sides = F.broadcast(sides) if 6 * pairs.count() <= MOST_IDS else sides.hint("merge")  # 24 bytes a row
    side = lambda c: F.first(F.when(F.col("sig") == F.col(c), F.col("items")), ignorenulls=True)
    return items.join(sides, "sig").groupBy("a", "b").agg(side("a").alias("x"), side("b").alias("y"))


def _verified(pairs: DataFrame, rows: DataFrame, reps: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets, brought together once for each pair and compared whole, have the similarity."""
    pairs = cut(_together(pairs, rows, reps, slim(_histograms(shingle, 1)), "binary").mapInPandas(slim(_plausible(similarity)), "a long, b long"))
    two = _together(pairs, rows, reps, slim(_sets(shingle)), "array<long>")
    same = two.select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("same"))
    return same.where(F.col("same") / (F.col("nx") + F.col("ny") - F.col("same")) >= F.lit(similarity)).select("a", "b")


def groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, sig, component_id): texts whose different shingles have Jaccard similarity `similarity` or more link.

    component_id is the smallest doc_id reachable. Texts without a word equal one
    another. Rows of (doc_id, text) without a doc_id are not read. The radius holds
    for a similarity of 0.8 or more; give a lower one a wider radius."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    seen = cut(rows.mapInArrow(slim(_signatures(shingle)), "doc_id long, sig long, n long, fp long"))
    counts = seen.where("doc_id is null").groupBy("sig").agg(F.sum("n").alias("n")).toPandas()  # 2**COUNTER_BITS rows at most
    counters = np.zeros(1 << COUNTER_BITS, np.int64)
    counters[counts["sig"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    named = seen.where("doc_id is not null").select("doc_id", "sig")
    reps = seen.where("doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("id"), F.min("n").alias("n"), F.min("fp").alias("fp"))

    # prefixes cross the network once and are sorted; tokens of one text end there
    prefix = rows.mapInArrow(slim(_prefixes(counters, shingle, similarity)), "token long, sig long, place int").repartition("token").sortWithinPartitions("token", "sig")
    met = cut(prefix.mapInArrow(_shared, "token long, sig long, place int"))
    facts = reps.join(met.groupBy("sig").agg(F.count("*").alias("met")), "sig").select("sig", "n", "fp", (F.col("met") / F.col("n")).alias("hub"))
    blocks = cut(_different(met).join(facts, "sig"))

    links = comp = before = None
    for turn in range(STARS + 1):
        left = blocks.withColumn("comp", F.col("sig")) if comp is None else blocks.join(comp, "sig", "left").withColumn("comp", F.coalesce("component", "sig")).drop("component")
        open_ = left.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("least")).where("low < high").select("token", "least")
        left = left.join(open_, "token").where(_room("n", "place", "least", similarity))
        left = cut(left.select("token", "sig", "n", "comp", "fp", "hub", "place"))
        kinds = left.groupBy("token", "comp").agg(F.count("*").cast("double").alias("c")).groupBy("token").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("cc"))
        size, apart = kinds.agg(F.sum("c"), F.sum((F.col("c") * F.col("c") - F.col("cc")) / 2)).first()
        if not size:
            break
        last = turn == STARS or bool(turn) and (apart <= EASY * size or apart > STALLED * before)
        before = apart
        pairs = cut(_crossing(left, rows, reps, shingle, similarity, radius) if last else _stars(left, turn, similarity, radius))
        found = cut(_verified(pairs, rows, reps, shingle, similarity))
        links = found if links is None else links.union(found)
        comp = components(links).select(F.col("id").alias("sig"), "component")
        if last:
            break
    if comp is None:
        return named.join(reps, "sig").select("doc_id", "sig", F.col("id").alias("component_id"))
    classes = reps.join(comp, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    least = classes.groupBy("component").agg(F.min("id").alias("component_id"))
    return named.join(classes.join(least, "component").select("sig", "component_id"), "sig").select("doc_id", "sig", "component_id")
