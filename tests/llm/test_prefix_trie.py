"""The prefix trie against a plain one and through SQL; subtree sums against adding up ancestors."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import prefix_trie, queries
from loomspan.llm.common import table
from tests.compare import differ, views

SF = "/root/testdata/sf0.001"


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(int(c / 20) * 20, [])[:h] + own[c][h:])
    nodes = {p[:d]: [] for p in built.values() for d in range(len(p) + 1)}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            nodes[built[c][:d]].append(c)
    out = []
    for p, members in nodes.items():
        sub = [q for q in nodes if q[: len(p)] == p]
        kids = [q for q in sub if len(q) == len(p) + 1]
        saved = sum((len(nodes[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in sub if q)
        leaves = sum(not any(r[:-1] == q for r in sub if r) for q in sub)
        ends = ",".join(str(c) for c in members if len(built[c]) == len(p))
        out.append((members[0], len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(df, **named):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(*prefix_trie.planted(prefix_trie.numbered(df)), **named).collect()), key=str)


def test_query(spark):
    got = queries.queries()["op13_prefix_trie"](spark, SF).toPandas()
    assert differ(got, views(SF).execute(queries.oracle_sql()["op13_prefix_trie"]).fetchdf()) is None


@pytest.mark.parametrize("most", [30, prefix_trie.MOST])
def test_against_plain(spark, most):
    """Copies, conversations shorter than what they take over, missing bases; parts of 30 nodes go the way of large tries."""
    rng = np.random.default_rng(5)
    rows = []
    for c in (0, 1, 2, 3, 4, 7, 20, 25, 26, 39, 45, 46, 101, 119, -3, -20):
        for t in range(int(rng.integers(1, 7))):
            rows.append((c, t, "user", f"x {rng.integers(2)} y"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert trie(df, most=most) == plain(rows)


def test_edges(spark):
    rows = [(1, None, None, None), (1, 2, "a", "b c"), (2, None, "", ""), (2, 5, "a", "b c"), (None, 1, "a", "b"), (20, 1, "x", "\t \n"), (20, 1, "x", "\t \n"), (21, 0, "user", "w " * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit("clash")).withColumn("c0", F.lit(None).cast("string"))
    assert trie(df) == plain(rows)
    assert trie(df.limit(0)) == []
    assert [r[:6] for r in trie(df.where("conv_id = 20"))][0][:2] == (20, 0)


def test_long_conversations_and_repeated_turns(spark):
    """Over a chunk of turns, and a chunk of turn numbers that goes by hashes, give the same places."""
    rows = [(40, t // 3, "u", f"w{t % 5}") for t in range(1300)] + [(60, t // 3, "u", f"w{t % 5}") for t in range(1299)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wide, fine = (sorted(tuple(r) for r in prefix_trie.numbered(df, heavy).collect()) for heavy in (prefix_trie.HEAVY, 100))
    assert wide == fine and [r[1] for r in wide if r[0] == 40] == list(range(1, 1301))
    k = [(r["k0"], r["p0"]) for r in prefix_trie.prefixes(prefix_trie.numbered(df)).where("conv_id = 40").orderBy("position").collect()]
    assert k[0][1] == 0 and all(a[0] == b[1] for a, b in zip(k, k[1:])) and len({a for a, _ in k}) == 1300


@pytest.mark.parametrize("kind", ["path", "star", "random", "broom"])
def test_subtree_sums(spark, kind):
    rng = np.random.default_rng(1)
    n = 30
    up = {"path": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: int(rng.integers(i)), "broom": lambda i: i - 1 if i < n // 2 else n // 2 - 1}[kind]
    ids = (rng.permutation(n) * 1_000_003 - 7).tolist()
    parents = [None, *[up(i) for i in range(1, n)]]
    parents[n - 1] = None  # a second tree
    values = rng.integers(-5, 100, n).tolist()
    want = list(values)
    for i in range(n):
        a = parents[i]
        while a is not None:
            want[a] += values[i]
            a = parents[a]
    plain_sums = prefix_trie.decompose([-1 if p is None else p for p in parents], [values])[0]
    assert plain_sums == want
    df = spark.createDataFrame([(ids[i], None if parents[i] is None else ids[parents[i]], values[i]) for i in range(n)], "id long, parent long, v long")
    for most in (20, 1000):
        got = {r["id"]: r["v"] for r in prefix_trie.subtree_sums(df, ["v"], most).collect()}
        assert [got[i] for i in ids] == want
