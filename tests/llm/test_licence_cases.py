"""Notices that aren't in the training set, look-alikes, wrapped lines, and the gate's proof."""

import pytest

from loomspan.llm import licenses
from loomspan.llm.common import table

UNSEEN = {
    "MIT": ["Distributed under the MIT license.", "The code is released under the terms of the MIT License", "permission is hereby granted, free of charge, to any person obtaining a copy of these files"],
    "Apache-2.0": ["This file is licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004"],
    "GPL": ["Released under gpl v3.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published", "This program is distributed in the hope that it will be useful"],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 3."],
    "AGPL": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD": ["Released under the BSD 3-Clause license.", "Redistribution and use in source and binary forms are permitted provided that the following conditions are met"],
    "MPL": ["This file is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY": ["Released under CC BY 4.0."],
    "CC-BY-SA": ["This page is licensed under CC BY-SA 4.0."],
    "CC-BY-NC": ["Text licensed under CC BY-NC 4.0."],
    "Public-Domain": ["Dedicated to the public domain under cc0 1.0."],
    "All-Rights-Reserved": ["Copyright 2023 Some Press. All rights reserved.", "Unauthorized copying of this file is strictly prohibited."],
}
OTHERS = [
    "The police asked for his license and the papers of the car.", "You need a permit to use the hall for a public meeting.", "The warranty is free of charge for any person who bought it.",
    "He copied the notice and gave it to the members of the club.", "The general manager and the public were pleased with the new version.", "Her rights as a tenant were reserved in the contract.",
    "MIT und ohne Zucker.", "The common people were creative.", "All reserved seats are on the right.", "Use the source of the river to fill the jug.", "This program starts at nine and ends at ten.",
    "The terms of the loan are kind.", "A distribution of food took place in the village.", "The software runs without any problem.", "Copyright is a hard subject for students.",
]


@pytest.fixture(scope="module")
def model(spark):
    return licenses.train(spark, table(spark, "/root/testdata/sf0.01", "documents"))


def test_unseen_notices(spark, model):
    rows = [(i, k, t) for i, (k, t) in enumerate((k, t) for k, ts in UNSEEN.items() for t in ts)]
    assert not {t for _, _, t in rows} & {t for ts in licenses.NOTICES.values() for t in ts}
    docs = spark.createDataFrame([(i, t) for i, _, t in rows] + [(1000 + i, t) for i, t in enumerate(OTHERS)], "doc_id long, text string")
    got = {r["doc_id"]: r["family"] for r in licenses.scan(docs, model).collect() if r["confirmed"]}
    right = [i for i, k, _ in rows if got.get(i) == k]
    wrong = [(k, t, got.get(i)) for i, k, t in rows if got.get(i) != k]
    assert len(right) >= 0.9 * len(rows), wrong
    assert len([i for i in got if i >= 1000]) <= 1, got


def test_wrapped_and_odd_texts(spark, model):
    texts = [
        "One sentence.\nPermission is hereby granted, free of charge,\nto any person obtaining a copy of this software\nand associated documentation files\n\nAnother text.\nReleased under the MIT License.",
        None, "", "\n\n", "word " * 50_000 + "\nAll rights reserved.",
    ]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    got = [(r["doc_id"], r["paragraph"], r["family"]) for r in licenses.scan(docs, model).collect() if r["confirmed"]]
    # the last line of 4 goes on from a line without a stop
    assert sorted(got) == [(0, 1, "MIT"), (0, 1, "MIT"), (0, 6, "MIT"), (0, 6, "MIT")] + [x for x in got if x[0] == 4]


def test_gate_loses_nothing(spark, model):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = lambda m: {(r["doc_id"], r["paragraph"]): r["predicted"] for r in licenses.scan(docs, m).collect()}
    gated, whole = rows(model), rows(model | {"gate": []})
    assert model["gate"] and len(gated) < len(whole) / 2
    assert {k: v for k, v in whole.items() if v != "unknown"} == {k: v for k, v in gated.items() if v != "unknown"}


def test_every_paragraph_trains(spark):
    """All of 5600 paragraphs of 700 texts are counted, by the n-grams that they hold; two that hold most of a template are not."""
    odd = "The software is free of charge to any person under the terms of the club"
    docs = [(k, "\n\n".join(["A plain line number %d stands here." % (8 * k + j) for j in range(7)] + ["Nothing else is said."])) for k in range(700)]
    few = spark.createDataFrame([(k, t) for k, t in docs], "doc_id long, text string")
    each = licenses._paragraphs(few, "doc_id", "text", []).selectExpr("text", "true as fit")
    vocabulary = ["free", "free of", "free of charge", "is", "license", "mit", "mit license", "number", "of", "released", "released under", "the", "the mit", "under", "under the"]
    counted = {tuple(r["grams"]): r["n"] for r in each.mapInArrow(licenses._usual(vocabulary, licenses.NOTICES), "grams array<string>, fit boolean, n long").groupBy("grams").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert counted == {("number",): 4900, ("is",): 700}
    one = spark.createDataFrame([(odd, True), ("Released under the MIT License.", True), ("released under the mit license", True)], "text string, fit boolean")
    assert [r["grams"] for r in one.mapInArrow(licenses._usual(vocabulary, licenses.NOTICES), "grams array<string>, fit boolean, n long").collect()] == [["free", "free of", "free of charge", "is", "of", "the", "under", "under the"]]


def test_counted_without_python(spark):
    """The paragraphs that train are counted by DataFrame expressions alone, as plain Python counts them; repeated words and parts of templates too."""
    notices = [t for ts in licenses.NOTICES.values() for t in ts]
    odd = ["", "MIT", "under the under the under the", "license the license of the license", "İ mit K. the MIT-license 2.0.1", *notices, *[" ".join(t.split(" ")[k::2]) for t in notices for k in (0, 1)], *OTHERS]
    given = spark.createDataFrame([(t, i % 2 == 0) for i, t in enumerate(odd)], "text string, fit boolean")
    corpus = licenses._paragraphs(table(spark, "/root/testdata/sf0.001", "documents"), "doc_id", "text", [])
    each = given.unionByName(corpus.selectExpr("text", "length(text) % 2 = 0 as fit"))
    vocabulary = sorted({g for r in given.select(licenses.grams(given.text)).collect() for g in r[0]})
    counted = licenses._counted(each, vocabulary, licenses.NOTICES)
    plain = each.mapInArrow(licenses._usual(vocabulary, licenses.NOTICES), "grams array<string>, fit boolean, n long").groupBy("grams", "fit").agg({"n": "sum"})
    rows = lambda df: {(tuple(r[0]), r[1]): r[2] for r in df.collect()}
    assert rows(counted) == rows(plain) and len(rows(counted)) > 50


def test_training_runs_no_python(spark, monkeypatch):
    """No plan of the training runs Python: its map over the paragraphs isn't asked for."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")

    def refuse(*_):
        raise AssertionError("Python on the executors")

    monkeypatch.setattr(type(docs), "mapInArrow", refuse)
    monkeypatch.setattr(type(docs), "mapInPandas", refuse)
    assert licenses.train(spark, docs)["threshold"] >= licenses.MIN_PROBABILITY
