"""What a task holds at once."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from tagloom.llm import ngram_join, toxicity
from tagloom.llm.common import chunks


def traced(call):
    tracemalloc.start()
    try:
        return call(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_stretch_of_texts_is_hashed_within_32_mb():
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(600)) for _ in range(1600)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    shingles = ngram_join._Shingles(4)

    def longest():
        return sum(len(s) for part in chunks([batch], "text", ngram_join.STRETCH) for s in shingles(part.column("text")))

    total, peak = traced(longest)
    assert peak < 32 << 20
    whole = shingles(batch.column("text"))  # all at once: the same sets
    cut = [s for part in chunks([batch], "text", 10_000) for s in shingles(part.column("text"))]
    assert total == sum(map(len, whole)) and all(np.array_equal(a, b) for a, b in zip(whole, cut, strict=True))


def test_repeated_values_are_counted_in_place():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 1 << 62, 1_000_000).astype(np.uint64)
    values[::7] = values[3]
    values[1::11] = values[4]
    for often in (1, 2, 3):
        tokens, times = np.unique(values, return_counts=True)
        want = tokens[times >= often], times[times >= often]
        own = values.copy()
        (found, n), peak = traced(lambda: ngram_join._repeated(own, often))  # noqa: B023
        assert np.array_equal(found, want[0]) and np.array_equal(n, want[1])
        assert often == 1 or peak < values.nbytes
    for few in (0, 1, 2):
        assert ngram_join._repeated(np.zeros(few, np.uint64), 3)[0].size == 0


KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_rows_of_the_pipeline_go_to_python_in_small_batches(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, f"text {i} " * 400) for i in range(3000)], "doc_id long, text string").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [b.nbytes]})

    longest = lambda: max(r["bytes"] for r in docs.mapInArrow(sizes, "bytes long").collect())
    before = spark.conf.get(KEY)
    try:
        spark.conf.unset(KEY)
        assert longest() > 8 << 20
        corpus_pipeline.pack(spark, docs, str(tmp_path))
        assert longest() < 5 << 20
        spark.conf.set(KEY, "1m")  # a value of the session's own stays
        corpus_pipeline.pack(spark, docs, str(tmp_path))
        assert spark.conf.get(KEY) == "1m"
    finally:
        spark.conf.set(KEY, before)


def test_a_text_that_is_kept_is_scored_from_the_one_copy(spark):
    machine = toxicity.Machine(np.array([1, 2]), 0.1, np.ones(2), np.ones((2, 2)))
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    whole = toxicity.score(docs, machine)
    assert "__text" not in whole._jdf.queryExecution().analyzed().toString()
    alone = {r["doc_id"]: r["score"] for r in toxicity.score(docs, machine, keep=["doc_id"]).collect()}
    assert {r["doc_id"]: (r["text"], r["score"]) for r in whole.collect()} == {i: (t, alone[i]) for i, t in docs.collect()}
