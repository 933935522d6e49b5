"""Threshold top-k against all scores, as numbers and through SQL."""

import numpy as np
import pytest

from loomspan.llm import queries, topk

from tests.compare import differ, views

SF = "/root/testdata/sf0.01"


def slow(ids, v, q, own, k):
    s = sorted((-int(x), int(i)) for x, i in zip(v @ q, ids) if i != own)[:k]
    return [(i, -x) for x, i in s]


@pytest.mark.parametrize("width, spread", [(1, 3), (4, 2), (16, 100), (64, 130)])
def test_lists(width, spread):
    rng = np.random.default_rng(width)
    for n in (1, 4, 40, 700):
        v, ids = rng.integers(-spread, spread + 1, (n, width)).astype(float), rng.permutation(10 * n)[:n]
        lists = topk.Lists(ids, v)
        for _ in range(20):
            q = rng.integers(-spread, spread + 1, width).astype(float) * (rng.random(width) < 0.7)
            own = int(ids[rng.integers(n)])
            near, scores, reads = lists.best(q, own, 5)
            assert list(zip(near.tolist(), scores.tolist())) == slow(ids, v, q, own, 5) and reads <= 2 * width * n


def test_stops_early():
    """One vector far ahead on few dimensions: the lists are left near their ends."""
    rng = np.random.default_rng(0)
    v = rng.integers(-10, 11, (5000, 8)).astype(float)
    v[:20, :2] = 200
    _, _, reads = topk.Lists(np.arange(5000), v).best(np.array([9.0, 8, 0, 0, 0, 0, 0, -1]), 3, 5)
    assert reads <= 3 * 64


@pytest.mark.parametrize("block", [64, topk.BLOCK])
def test_query(spark, block):
    from loomspan.llm.common import table

    vectors = table(spark, SF, "embeddings")
    got = topk.nearest(vectors, vectors.where("vec_id % 50 = 0"), 5, block=block).toPandas()
    assert differ(got, views(SF).execute(queries.oracle_sql()["op11_threshold_topk"]).fetchdf()) is None
    assert set(got.groupby("query_id").size()) == {5}


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 2), (2, [1.0, 0.5], 3), (2, [1.0, 0.5], 3), (3, None, 4), (4, [1.0, None], 5), (5, [nan, 1.0], 6), (6, [inf, 1.0], 7), (None, [9.0, 9.0], 8), (7, [-1.0, 0.0], 9), (8, [2.0], 10), (9, [], 11), (50, [0.0, 0.0], 12), (100, [-0.001, 0.001, 5.0], 13)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = {}
    for r in topk.nearest(df, df.where("vec_id % 50 = 0"), 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got[0] == [(1, 8, 512 * 256), (2, 1, 81920), (3, 2, 81920), (4, 2, 81920)]
    assert got[50] == [(1, 0, 0), (2, 1, 0), (3, 2, 0), (4, 2, 0)]
    assert got[100][0] == (1, 7, 256)  # floor(-0.256) = -1 and floor(0.256) = 0
    assert topk.nearest(df.limit(0), df).count() == 0 and topk.nearest(df, df.limit(0)).count() == 0
    few = df.where("vec_id in (7, 50)")
    assert [tuple(r) for r in topk.nearest(few, few, 5).orderBy("query_id").collect()] == [(7, 1, 50, 0), (50, 1, 7, 0)]


def test_large_components(spark):
    df = spark.createDataFrame([(0, [3e6, 1.0]), (1, [3e6, -1.0]), (2, [3e6, 2.0])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in topk.nearest(df, df.where("vec_id = 0"), 2).orderBy("rank").collect()]
    assert got == [(2, 768000000**2 + 256 * 512), (1, 768000000**2 - 256 * 256)]
