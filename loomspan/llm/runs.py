"""Periodic runs in word sequences by Kruskal's descent over the longest common prefixes of suffixes.

Suffixes that share a prefix of l words are one class. Classes are united by
decreasing l (the links of neighbours in suffix order, union-find), each kept as its
ordered positions, the smaller one merged into the larger. Two positions i < j that
become neighbours in a class when it is united at l, at a distance j - i <= l, seed a
run of period j - i that ends at j + l: no smaller period fits, or a position between
them would have joined before. The leftmost such pair of a run names it.

A run of `least` words and `times` periods shares a prefix of `deep` words with itself
one period on, so only positions whose next `deep` words occur again in the text are
sorted at all, and the descent ends there.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, TIMES = 24, 3
_U = np.uint64
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, text string, runs array<struct<start:long,length:long,period:long>>, strongest struct<start:long,length:long,period:long>"


def deep(least: int = LEAST, times: int = TIMES) -> int:
    """The shortest prefix that the suffixes at a run's start and one period on can share."""
    return min(least - least // times, (times - 1) * -(-least // times))


def _recur(ids: np.ndarray, size: int) -> bool:
    """Whether any `size` words in a row may occur twice: by 64-bit hashes, which never deny what is there."""
    if len(ids) <= size:
        return False
    h, have = (ids.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15), 1
    while have < size:
        more = min(have, size - have)
        h = (h[:-more] ^ (h[:-more] >> _U(29))) * _U(0xBF58476D1CE4E5B9) + h[more:]
        have += more
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def suffixes(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, shared): positions whose next `size` words recur, in suffix order, and the words each shares with the one before it (0 for the first).

    Ranks of 1, 2, 4, ... words by prefix doubling; they also give the shared lengths."""
    n = len(ids)
    ranks, k = [np.append(ids.astype(np.int64), -1)], 1
    while k < n:
        rank = ranks[-1]
        ahead = np.zeros(n, np.int64)
        ahead[: n - k] = rank[k:n] + 1
        _, new = np.unique(rank[:n] * (n + 1) + ahead, return_inverse=True)
        ranks.append(np.append(new, -1))
        k *= 2
        if new.max() == n - 1:
            break
    order = np.argsort(ranks[-1][:n], kind="stable")
    a, b, shared = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        same = ranks[level][a] == ranks[level][b]
        step = same.astype(np.int64) << level
        a, b, shared = np.minimum(a + step, n), np.minimum(b + step, n), shared + step
    shared = np.append(0, shared)
    recurs = (shared >= size) | np.append(shared[1:] >= size, False)
    return order[recurs], shared[recurs]


def _united(large: list[int], small: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
    """Both ordered sets as one, and the pairs of one position of each that are neighbours in it."""
    pairs = []
    if 8 * len(small) > len(large) and len(small) > 8:
        mine, both = set(small), sorted(large + small)  # two ascending stretches: a linear merge
        for x, y in zip(both, both[1:]):
            if (x in mine) != (y in mine):
                pairs.append((x, y))
        return both, pairs
    before = -1  # the last one that was put in
    for k, x in enumerate(small):
        at = bisect_left(large, x)
        if at and large[at - 1] != before:
            pairs.append((large[at - 1], x))
        if at < len(large) and (k + 1 == len(small) or small[k + 1] > large[at]):
            pairs.append((x, large[at]))
        large.insert(at, x)
        before = x
    return large, pairs


def find_runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period. ids number the words."""
    size = deep(least, times)
    if not _recur(ids, size):
        return []
    position, shared = suffixes(ids, size)
    links = np.flatnonzero(shared >= size)
    links = links[np.argsort(-shared[links], kind="stable")]
    up = list(range(len(position)))
    sets: list[list[int] | None] = [[x] for x in position.tolist()]
    found = []
    words = ids.tolist()
    for r, l in zip(links.tolist(), shared[links].tolist()):
        a, b = r - 1, r
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        sets[a], pairs = _united(sets[a], sets[b])
        up[b], sets[b] = a, None
        for i, j in pairs:
            q = j - i
            if q <= l and q + l >= max(least, times * q) and (i == 0 or words[i - 1] != words[j - 1]):
                found.append((i, q + l, q))
    return sorted(found)


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods, exactly; ties to the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats, joined by one space: of each run its first period stays."""
    if runs:
        depth = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            depth[start + period] += 1
            depth[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
    return b" ".join(words)


def _per_text(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, texts, every, best = [], [], [], []
            for text in batch.column(1).cast(pa.binary()):
                words = (text.as_py() or b"").split()  # ASCII white space alone, as these are bytes
                number: dict[bytes, int] = {}
                ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
                runs = find_runs(ids, least, times)
                sizes.append(len(words))
                texts.append(collapsed(words, runs).decode("utf-8", "surrogatepass"))
                every.append(runs)
                best.append(_strongest(runs))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(texts, pa.string()), pa.array(every, pa.list_(_RUN)), pa.array(best, _RUN)],
                ["doc_id", "n_words", "text", "runs", "strongest"],
            )

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, n_words, text, runs, strongest) of each row.

    runs: every (start, length, period) in words of a stretch with that smallest period
    that holds `least` words and `times` periods and can't be extended, by start, then
    period. strongest: the one of most periods (ties: smallest start, then period).
    text: the words that no run repeats, joined by one space.

    Words are what stands between ASCII white space. Null, empty and wordless texts
    have no runs and an empty text; a text is never cut, and takes memory in proportion
    to its words. Repeated rows and null ids stay, each row for itself; other columns
    are not read. An empty table gives an empty one."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_per_text(least, times), SCHEMA)


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, h in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist()):
            text = text.as_py()
            if h is not None and h % 10 == 0 and text and (n := len(words := text.split())):
                g = h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                text = b" ".join(words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a])
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the repetition that the query's contract writes into a tenth of the texts, chosen by crc32 of the id; a row without an id is left as it is."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    return rows.mapInArrow(_planted, "doc_id long, text string")


def digest(found: DataFrame) -> DataFrame:
    """The query's columns: counts, the strongest run, and SHA-256 of all runs and of the collapsed text."""
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )
