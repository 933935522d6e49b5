"""The pipeline's near-copy stage against brute-force Jaccard similarity of five-word shingles."""

import itertools

import pytest

from loomspan.llm import near_copies, simhash
from loomspan.llm.common import table


def slow_kept(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in texts}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x == y or min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) / len(x | y) >= 0.8:
            p, q = sorted((root(a), root(b)))
            group[q] = p
    return {i for i in group if root(i) == i}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_stage_is_brute_force(spark, sf):
    docs = table(spark, f"/root/testdata/{sf}", "documents")
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == slow_kept({r["doc_id"]: r["text"] for r in docs.collect()})


@pytest.mark.parametrize("easy", [near_copies.EASY, -1])
def test_chains_cliques_and_edges(spark, monkeypatch, easy):
    monkeypatch.setattr(near_copies, "EASY", easy)
    if easy < 0:
        monkeypatch.setattr(near_copies, "BLOCK", 6)  # blocks in chunks
    base = [f"w{k}" for k in range(100)]
    texts = {k: " ".join(base[:-1] + [f"end{k}"]) for k in range(20)}  # a clique
    texts |= {100 + k: " ".join(f"c{j}" for j in range(8 * k, 8 * k + 100)) for k in range(12)}  # a chain: only neighbours are near
    texts |= {200: None, 201: " \n", 202: "Three short words", 203: "three SHORT  words", 204: "three short", 205: "a b c d e f", 206: "a b c d e g"}
    texts |= {300 + k: " ".join(base[10:40] + [f"own{k}x{j}" for j in range(80)]) for k in range(20)}  # one passage in many texts
    docs = spark.createDataFrame([*texts.items(), (None, texts[0]), (5, texts[5])], "doc_id long, text string")
    rows = simhash.keep_one(docs).collect()
    kept = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert len(rows) == len(kept) + 1 and len(kept) == len(set(kept)) and set(kept) == slow_kept(texts)


def test_shared_tokens_in_any_batches():
    import collections
    import random

    import pyarrow as pa

    rng = random.Random(1)
    for _ in range(500):
        rows = sorted((rng.randint(0, 5), rng.randint(0, 3)) for _ in range(rng.randint(0, 30)))
        batches, at = [], 0
        while at < len(rows):
            some = rows[at : at + rng.randint(0, 6)]
            batches.append(pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], pa.int64()) for i in (0, 1)], ["token", "sig"]))
            at += len(some)
        got = [tuple(r.values()) for b in near_copies._shared(iter(batches)) for r in b.to_pylist()]
        kinds = collections.defaultdict(set)
        for t, s in rows:
            kinds[t].add(s)
        assert sorted(got) == sorted((t, s) for t, v in kinds.items() if len(v) > 1 for s in v)


def test_edited_copies_around_the_threshold(spark, monkeypatch):
    """Copies of one text with so many edits that some link, some just don't: all links are found, and far fewer pairs than all are compared."""
    import random

    seen = []
    compared = near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *a: seen.append(pairs.count()) or compared(pairs, *a))
    rng = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    texts = {}
    for i in range(150):
        words = base[: rng.choice((150, 150, 148, 140))]
        for at in rng.sample(range(len(words)), rng.choice((0, 2, 3, 4, 5, 6))):
            words[at] = f"x{rng.choice((at % 3, i))}"  # some edits are shared
        texts[i] = " ".join(words)
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == slow_kept(texts)
    assert sum(seen) < 150 * 149 / 2 / 4
