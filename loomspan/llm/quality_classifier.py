"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is good or bad; its features and those of the lines beside
it speak for one of the two, and so do its neighbours' labels. Forward-backward
gives each line's probability of being good, and their mean, weighted by line
length, is the document's quality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slim
from .decontamination import _B, _U, _bytes, _mix, _word_hash

TRAIN_DOCUMENTS = 4000  # labelled documents that the model is fitted on, at most
TRAIN_LINES = 128  # a longer training document counts as several
STEPS = 150
RIDGE = 1e-3
WINDOW = 5

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_GROUPS = {"lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "symbol": b"#*$%&|<>@~^=+_\\{}[]/", "mark": b"!?", "stop": b".,;:", "high": range(128, 256)}
N_FEATURES = len(_GROUPS) + 7


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of each line, its length in bytes without white space, features) for the lines with a word of the texts data[offsets[i]:offsets[i + 1]]."""
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    start = start[start < len(data)]
    end = np.append(start[1:], len(data))
    doc = np.searchsorted(offsets, start, "right") - 1
    solid = ~_SPACE[data]
    sums = lambda x: (lambda c: (c[end] - c[start]).astype(float))(np.concatenate([[0], np.cumsum(x)]))
    size = sums(solid)
    keep = size > 0
    start, end, doc, size = start[keep], end[keep], doc[keep], size[keep]
    if not len(start):
        return doc, size, np.zeros((0, N_FEATURES))
    shares = []
    for members in _GROUPS.values():
        flag = np.zeros(256, bool)
        flag[list(members)] = True
        shares.append(sums(flag[data]) / size)
    head = solid.copy()
    head[1:] &= ~solid[:-1]
    fresh = offsets[:-1][np.diff(offsets) > 0]
    head[fresh] = solid[fresh]
    at = np.flatnonzero(head)
    stops = np.flatnonzero(np.concatenate([solid[:-1] & ~solid[1:], solid[-1:]])) + 1
    stops = np.union1d(stops, fresh[(fresh > 0) & solid[fresh - 1]])
    stop = stops[np.searchsorted(stops, at, "right")]
    line = np.searchsorted(start, at, "right") - 1
    words = np.bincount(line, minlength=len(start)).astype(float)
    code = _word_hash(data, at, stop, solid)
    same = np.concatenate([[False], (code[1:] == code[:-1]) & (line[1:] == line[:-1])])
    owner = doc[line]
    repeated = np.zeros(len(at), bool)
    if len(at) >= WINDOW:
        h = _mix(owner[: len(at) - WINDOW + 1].astype(_U) + _U(7))
        for k in range(WINDOW):
            h = _mix(h * _B + code[k : k + len(h)])
        whole = owner[: len(h)] == owner[WINDOW - 1 :]
        _, inverse, count = np.unique(h[whole], return_inverse=True, return_counts=True)
        repeated[np.flatnonzero(whole)] = count[inverse] > 1
    text = _mix(_word_hash(data, start, end, solid) + doc.astype(_U) * _B)
    _, inverse, count = np.unique(text, return_inverse=True, return_counts=True)
    per = lambda x: np.bincount(line, x, len(start)) / words
    last = data[stops[np.searchsorted(stops, end, "right") - 1] - 1]
    features = np.column_stack([*shares, np.log1p(words), np.minimum(size / words, 30.0), per(same), per(repeated), (count[inverse] > 1).astype(float), np.isin(last, list(b".!?:;\"")).astype(float), np.log1p(size)])
    return doc, size, features


def _beside(doc: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Each line's features with those of the line before and behind, zeros at a document's ends, and a constant."""
    before, behind = np.zeros_like(x), np.zeros_like(x)
    if len(x):
        joined = (doc[1:] == doc[:-1])[:, None]
        before[1:], behind[:-1] = x[:-1] * joined, x[1:] * joined
    return np.column_stack([x, before, behind, np.ones(len(x))])


def marginals(doc: np.ndarray, good: np.ndarray, move: np.ndarray, gold: np.ndarray | None = None):
    """Forward-backward over all documents side by side.

    doc is sorted; good is each line's score for good (bad has 0), move[a, b] that of b behind a.
    Returns each line's probability of good and, with gold labels, the expected
    counts of moves minus those seen."""
    n = len(doc)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if n else np.zeros(0, int)
    size = np.diff(np.append(first, n))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    longest = int(size[0]) if n else 0
    alive = np.searchsorted(-size, -np.arange(longest), "left")  # documents with more than t lines
    score = np.zeros((n, 2))
    score[:, 1] = good
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    for t in range(longest):
        at = first[: alive[t]] + t
        if t:
            old = forward[at - 1]
            forward[at] = score[at] + np.logaddexp(old[:, :1] + move[0], old[:, 1:] + move[1])
        else:
            forward[at] = score[at]
    for t in range(longest - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        ahead = backward[at + 1] + score[at + 1]
        backward[at] = np.logaddexp(move[:, 0] + ahead[:, :1], move[:, 1] + ahead[:, 1:])
    both = forward + backward
    z = np.logaddexp(both[:, 0], both[:, 1])
    p = np.exp(both[:, 1] - z)
    if gold is None:
        return p
    excess = np.zeros((2, 2))
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    for a in (0, 1):
        for b in (0, 1):
            joint = np.exp(forward[inner, a] + move[a, b] + score[inner + 1, b] + backward[inner + 1, b] - z[inner])
            excess[a, b] = joint.sum() - ((gold[inner] == a) & (gold[inner + 1] == b)).sum()
    return p, excess


def fit(doc: np.ndarray, raw: np.ndarray, labels: np.ndarray) -> dict:
    """The model, from lines (their document's number, ascending, and features) and each document's label: feature means
    and spreads, weights, moves, and the score of a text without a line (the share of good documents)."""
    gold_doc = np.asarray(labels, int)
    prior = float(gold_doc.mean()) if len(gold_doc) else 0.5
    mean, spread = (raw.mean(axis=0), raw.std(axis=0) + 1e-6) if len(raw) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    x, gold = _beside(doc, (raw - mean) / spread), gold_doc[doc]
    begin = np.searchsorted(doc, doc) if len(doc) else doc
    part = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | ((np.arange(len(doc)) - begin)[1:] % TRAIN_LINES == 0)])) if len(doc) else doc
    # a document's lines count as one document together, and both classes alike
    weight = 1 / np.bincount(doc, minlength=len(labels))[doc] if len(doc) else np.zeros(0)
    w, move = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for step in range(1, STEPS + 1):
        p, excess = marginals(part, x @ w, move, gold)
        g = np.concatenate([x.T @ ((p - gold) * weight) / max(1, len(labels)) + RIDGE * w, excess.ravel() / max(1, len(part)) + RIDGE * move.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move_by = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, move = w - move_by[:-4], move - move_by[-4:].reshape(2, 2)
    return {"mean": mean, "spread": spread, "w": w, "move": move, "prior": prior}


def scores(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    doc, size, raw = line_features(data, offsets)
    out = np.full(len(offsets) - 1, model["prior"])
    if len(doc):
        p = marginals(doc, _beside(doc, (raw - model["mean"]) / model["spread"]) @ model["w"], model["move"])
        total = np.bincount(doc, size, len(out))
        out = np.where(total > 0, np.bincount(doc, size * p, len(out)) / np.maximum(total, 1), out)
    return np.clip(out, 0.0, 1.0)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Line features of training documents, made where the texts are; the driver gets numbers only."""
    for batch in batches:
        found = []
        for i in range(batch.num_rows):
            _, _, raw = line_features(*_bytes(batch.column(1).slice(i, 1)))
            found.append(raw.astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(found, pa.binary())], names=["doc_id", "y", "lines"])


def _scoring(model: dict, step: int = 2 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes(batch.column(1))
            i, out = 0, []
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + step, "right")) - 1)
                out.append(scores(model, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                i = j
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], names=["doc_id", "score"])

    return run


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3, is 1. Null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_DOCUMENTS) -> dict:
    """A model from at most `most` labelled documents that are not held out (those with the smallest id hashes)."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most `most` ids and labels
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y"))
    rows = sorted((r["doc_id"], r["y"], r["lines"]) for r in texts.select("doc_id", "text", "y").mapInArrow(_lines, "doc_id long, y int, lines binary").toLocalIterator())
    lines = [np.frombuffer(x, "<f4").reshape(-1, N_FEATURES) for _, _, x in rows]
    doc = np.repeat(np.arange(len(rows)), [len(x) for x in lines]).astype(int)
    return fit(doc, np.concatenate(lines).astype(float) if lines else np.zeros((0, N_FEATURES)), np.array([y for _, y, _ in rows], int))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_DOCUMENTS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    The score is 0 to 1, higher for good; a null, empty or wordless text gets the
    share of good training documents, 0.5 if there are none. Repeated rows score
    alike and stay. Columns beside id and text are not read."""
    model = train(docs, labels, id_col, text_col, most=most)
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scoring(model), "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs whose text scores 0.5 or more. Each row is scored on its own text, in place, so no row is shuffled."""
    model = train(docs, labels)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _scoring(model)
        for batch in batches:
            for scored in one([pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text")], names=["doc_id", "text"])]):
                kept = batch.filter(pa.array(scored.column("score").to_numpy() >= 0.5))
                yield kept.select(names)

    return docs.mapInArrow(slim(run), docs.schema)
