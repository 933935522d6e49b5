"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomspan.llm import decontamination, fixity, html_extraction, licenses, packing, quality_classifier, quality_rules, sharding, simhash, token_store

LONG = ("one two three four five six seven eight nine ten eleven twelve " * 3 + "\n") * 700
ROWS = [(1, None, "en"), (2, "", None), (3, " \t\n ", "en"), (4, LONG, "en"), (5, "The same words stand here and there again today", "en"), (5, "The same words stand here and there again today", "en"), (6, "The same words stand here and there again today", "xx"), (None, "The one without an id has words of its own too", "en"), (7, "Ünï cödé \U0001f600 wörds\r\nand a\x0bbreak", "de"), (8, "x", None)]
EXTRA = ["size", "shard", "slot", "hash", "block", "fp", "words", "host", "rank", "p", "k1", "file", "salt"]


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("clash") for c in EXTRA})


def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(1, 9)], "doc_id long, quality int, toxic int")


def bench(spark):
    return spark.createDataFrame([(0, None), (1, ""), (2, "The same words stand here and there again today"), (None, "x y")], "item_id long, text string")


OPERATORS = {
    "html": (lambda s, d: html_extraction.extract(d.withColumns({"page_id": F.col("doc_id"), "url": F.lit("http://a.b/c"), "html": F.col("text")})), True),
    "rules": (lambda s, d: quality_rules.judge(d), True),
    "packing": (lambda s, d: packing.pack_documents(d), False),
    "simhash": (lambda s, d: simhash.near_duplicates(d), True),
    "classifier": (lambda s, d: quality_classifier.score(d, labels(s)), True),
    "sharding": (lambda s, d: sharding.shard(d), True),
    "store": (lambda s, d: token_store.documents(s, token_store.write(d)), True),
    "decontamination": (lambda s, d: decontamination.matches(d, bench(s)), False),
    "fixity": (lambda s, d: fixity.audit(*[fixity.records(d, "doc_id", "lang", "text")] * 2), False),
    "licenses": (lambda s, d: licenses.scan(d, licenses.train(s, d)), False),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, name):
    run, one_each = OPERATORS[name]
    found = run(spark, table(spark, ROWS)).collect()
    if one_each:
        assert len(found) == len(ROWS)
    assert run(spark, table(spark, [])).count() == 0


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, stage, tmp_path):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    f = dict(corpus_pipeline.STAGES)[stage]
    docs = table(spark, ROWS)
    out = f(spark, docs, str(tmp_path))
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
    assert out.count() <= 2000
    assert f(spark, table(spark, []), str(tmp_path)).count() == 0


def test_null_cases(spark):
    docs = table(spark, ROWS)
    rules = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert rules[1]["n_words"] == rules[3]["n_words"] == 0 and rules[1]["base_failed"]
    assert rules[4]["base_failed"] and rules[4]["n_words"] == 12 * 3 * 700
    near = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert near[1]["fingerprint"] == "0" * 16 and near[3]["component_id"] == 1 and near[6]["component_id"] == 5
    sizes = {r["doc_id"]: r["size"] for r in sharding.shard_map(docs).collect()}
    assert sizes[1] == 1 and sizes[8] == 2
    pieces = [r for r in packing.pack_documents(docs).collect() if r["doc_id"] == 1]
    assert [(r["piece"], r["length"]) for r in pieces] == [(0, 1)]
    assert {r["doc_id"] for r in decontamination.matches(docs, bench(spark)).collect()} == {5, 6}
    kept = simhash.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").where("doc_id in (5, 6)").collect()) == [5]
