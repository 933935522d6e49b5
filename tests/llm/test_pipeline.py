"""The pipeline against its operators, one after the other, on whole small tables."""

import corpus_pipeline
from loomspan.llm import decontamination, quality_classifier, quality_rules
from loomspan.llm.common import table

from test_near_copies import slow_kept

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    left = {r["doc_id"] for r in docs.select("doc_id").collect()}
    now = docs
    for (name, stage), bad in zip(corpus_pipeline.STAGES[:-1], (
        lambda d: {r["doc_id"] for r in quality_rules.judge(d).where("not kept").collect()},
        lambda d: {r["doc_id"] for r in quality_classifier.score(d, table(spark, SF, "labels")).where("predicted = 0").collect()},
        lambda d: (lambda t: set(t) - slow_kept(t))({r["doc_id"]: r["text"] for r in d.collect()}),
        lambda d: {r["doc_id"] for r in decontamination.matches(d, table(spark, SF, "benchmark")).collect()},
    )):
        gone = bad(now)
        now = stage(spark, now, SF)
        assert now.columns == docs.columns, name
        left -= gone
        assert sorted(r["doc_id"] for r in now.select("doc_id").collect()) == sorted(left), name
    assert 100 < len(left) < 200
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == left


def test_packing_task_holds_little():
    """A task's arrays are bounded, whatever the rows of a batch: 8 MB of text take less than 100 MB beside the encoder's memory."""
    import tracemalloc

    import pyarrow as pa

    from loomspan.llm import packing, tokens

    path = tokens.tokenizer_path()
    texts = [f"word {k % 7} and some more of it, " * 140 for k in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    run = packing._cut_pieces(path, packing.CAPACITY, packing.END_ID)
    list(run([batch.slice(0, 10)]))  # the encoder is made and has met the words
    tracemalloc.start()
    rows = sum(x.num_rows for x in run([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows >= len(texts) and most < 100e6, most


def test_histograms_in_parts():
    """Pairs of large histograms are compared some at once, with the results of all at once."""
    import tracemalloc

    import numpy as np

    from loomspan.llm.near_copies import _apart

    rng = np.random.default_rng(5)
    base = rng.integers(0, 3, 1 << 16).astype(np.uint8)
    items = [base.tobytes(), (base + (rng.random(1 << 16) < 0.01)).astype(np.uint8).tobytes(), rng.integers(0, 3, 1 << 16).astype(np.uint8).tobytes()]
    x, y = np.tile([0, 0, 1], 400), np.tile([1, 2, 2], 400)
    tracemalloc.start()
    got = _apart(items, x, y, 0.8)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == [False, True, True] * 400 and most < 50e6, most
