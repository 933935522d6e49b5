"""What nulls, empty texts, ties and repeated rows give, by value, for the operators that other edge tests only count."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import fixity, quality_classifier, token_store

ROWS = [(1, None), (2, ""), (5, "same words here"), (5, "same words here"), (None, "no id"), (None, None), (7, "a " * 30_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("shard", "rank", "offset", "file", "record", "payload", "score", "line")})


def test_token_store(spark, docs):
    rows = sorted((tuple(r) for r in token_store.documents(spark, token_store.write(docs)).select("start", "doc_id", "rank", "n_tokens", "ids_crc32").collect()))
    assert [r[1] for r in rows] == [None, None, 1, 2, 5, 5, 7]
    assert [r[3] for r in rows][:4] == [1, rows[1][3], 1, 1] and rows[1][3] > 1  # null first among the rows without an id
    assert rows[2][4] == rows[3][4] == rows[0][4] and rows[4][3:] == rows[5][3:] and {r[2] for r in rows[4:6]} == {0, 1}
    starts = [r[0] for r in rows]
    assert starts == [sum(r[3] for r in rows[:i]) for i in range(7)] and rows[6][3] >= 30_000


def test_fixity(spark, docs):
    ours = fixity.records(docs, "doc_id", "shard", "text")
    assert fixity.audit(ours, ours).isEmpty() and ours.where("record is null and file = -1").count() == 2
    theirs = ours.withColumn("payload", F.when(F.col("record").isNull(), F.lit(b"other")).otherwise(F.col("payload")))
    assert [(r["record"], r["file"], r["kind"]) for r in fixity.audit(ours, theirs).collect()] == [(None, -1, "changed")]
    half = ours.where("record is null or record <> 5")
    assert [(r["record"], r["kind"]) for r in fixity.audit(ours, half).collect()] == [(5, "missing")]
    assert [(r["record"], r["kind"]) for r in fixity.audit(half, ours).collect()] == [(5, "extra")]


def test_classifier(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in (1, 2, 5, 7)], "doc_id long, quality int, toxic int")
    found = quality_classifier.score(docs, labels).collect()
    assert len(found) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r["score"])
    assert by[1] == by[2] and by[5][0] == by[5][1]  # a null text is an empty one; equal texts score alike


def test_ids_by_key(spark, docs, monkeypatch):
    from loomspan.llm.tokens import encoder, tokenizer_path

    store = token_store.write(docs)
    enc = encoder(tokenizer_path())
    want = {}
    for r in sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        rank = sum(k[0] == r[0] for k in want)
        want[r[0], rank] = np.frombuffer(enc.plain([r[1] or ""])[0], "<u4").tolist() + [token_store.END_ID]
    keys = spark.createDataFrame([*want, (10**9, 0), (None, None), *want], "doc_id long, rank int")
    for named in (token_store.NAMED, 0):
        monkeypatch.setattr(token_store, "NAMED", named)
        rows = token_store.get(spark, store, keys).collect()
        assert len(rows) == len(want) and {(r["doc_id"], r["rank"]): r["ids"] for r in rows} == want
    assert token_store.get(spark, store, keys.limit(0)).isEmpty()


def test_fixity_of_a_record_with_many_rows(spark):
    """All rows without an id are one record: found changed whatever the change, equal in any order, folded in steps."""
    rows = spark.range(3000).select(F.lit(-1).cast("long").alias("file"), F.lit(None).cast("long").alias("record"), F.concat(F.lit("row "), (F.col("id") % 2000).cast("string")).cast("binary").alias("payload"))
    assert fixity.audit(rows, rows.repartition(7).orderBy(F.desc("payload"))).isEmpty()
    for other in (rows.limit(2999), rows.unionByName(rows.limit(1)), rows.withColumn("payload", F.when(F.col("payload") == F.lit("row 7").cast("binary"), F.lit("row x").cast("binary")).otherwise(F.col("payload")))):
        assert [(r["record"], r["kind"]) for r in fixity.audit(rows, other).collect()] == [(None, "changed")]
    found = fixity.digests(rows).first()
    assert found["length"] == sum(4 + len(str(i % 2000)) for i in range(3000)) and len(found["digest"]) == 64
