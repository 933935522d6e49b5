"""Periodic runs against every start and period tried one by one, and the query against a plain version."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import queries, runs
from loomspan.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_runs(w, least=24, times=3):
    """Maximal stretches of equal words q apart, smallest q of each stretch only."""
    n, found = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    # a multiple of the smallest period gives the same stretch, or one inside it
    return sorted((s, length, q) for (s, length), q in found.items() if not any(q % p == 0 and p < q and t <= s and s + length <= t + m for (t, m), p in found.items()))


@pytest.mark.parametrize("least, times", [(24, 3), (6, 2), (9, 3)])
def test_random_words(least, times):
    rng = np.random.default_rng(least)
    for _ in range(300):
        n, kinds = int(rng.integers(0, 90)), int(rng.integers(1, 4))
        w = rng.integers(0, kinds, n)
        if rng.random() < 0.6 and n > 10:
            p, a = int(rng.integers(1, n // 3 + 1)), int(rng.integers(0, n // 2))
            w[a:] = w[a : a + p][np.arange(n - a) % p] if a + p <= n else w[a:]
        assert runs.find_runs(w, least, times) == slow_runs(w.tolist(), least, times)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=12), st.integers(3, 9), st.lists(st.integers(0, 2), max_size=30))
def test_nested_repeats(unit, times, around):
    w = around + unit * times + around + [7] + unit * times
    assert runs.find_runs(np.array(w, np.int64)) == slow_runs(w)


def test_one_word_and_fibonacci_words():
    assert runs.find_runs(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]
    a, b = [0], [0, 1]
    while len(b) < 2000:
        a, b = b, b + a
    assert runs.find_runs(np.array(b)) == slow_runs(b)


def plain(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = slow_runs(w)
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join(f"{a},{b},{c}\n" for a, b, c in found)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    short = {i for i, t in docs if len(WORD.findall(t or "")) <= 1500}
    got = {r["doc_id"]: tuple(r) for r in queries.queries()["op12_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        if i in short:
            assert got[i] == plain(i, t)
    assert any(r[1] for r in got.values()) and any(not r[1] for r in got.values())


def test_edges(spark):
    line = "a b c " * 10
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "a b c", "x"), (None, line, "x"), (5, line, "x"), (5, line, "x"), (6, "x " * 30 + "y " + line, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted((tuple(r) for r in runs.periodic_runs(df).collect()), key=str)
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r[1:])
    assert by[1] == by[2] == by[3] == [(0, "", [], None)]
    assert by[4] == [(2, "a b c", [], None)]  # no ASCII white space inside the first word
    assert by[5] == [(30, "a b c", [(0, 30, 3)], (0, 30, 3))] * 2 and by[None] == by[5][:1]
    assert by[6] == [(61, "x y a b c", [(0, 30, 1), (31, 30, 3)], (0, 30, 1))]
    assert runs.periodic_runs(df.limit(0)).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    d = {r["doc_id"]: r for r in runs.digest(runs.periodic_runs(df)).collect()}
    assert d[1]["runs_sha256"] == d[1]["collapsed_sha256"] == empty and d[1]["start"] is None and d[6]["exponent_milli"] == 30000
