"""What a Python worker holds while an operator runs and after it."""

import tracemalloc

import public_tokenizers
import pyarrow as pa

from factloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_no_pre_token_outlives_its_task():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["the house of unheardofwords", None])], names=["doc_id", "text"])
    rows = [row for out in bpe._digest_batches(PATH, public_tokenizers.PATTERN)(iter([batch, batch])) for row in out.to_pylist()]
    own = bpe.encoder(PATH, public_tokenizers.PATTERN)
    assert [r["n_tokens"] for r in rows] == 2 * [len(own.encode("the house of unheardofwords")), 0]
    assert not own.ids and not own.raw and own.older == ({}, {})


def test_repeated_pre_tokens_are_held_once():
    own = bpe.encoder(PATH, public_tokenizers.PATTERN)
    texts = ["the house of the king " * 1000] * 80
    want = list(own.digests(texts[:1]))
    tracemalloc.start()
    try:
        found = list(own.digests(texts))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == want * 80
    assert peak < 12e6  # 400,000 places in lists are 3 MB, as many strings of their own 20 MB more


def test_spark_returns_whole_results_from_workers_that_are_used_again(spark):
    docs = spark.createDataFrame([(i, f"the house number {i} of {i % 3} streets") for i in range(200)], "doc_id long, text string").repartition(4)
    once, again = (sorted(bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect()) for _ in range(2))
    assert once == again and [r.doc_id for r in once] == list(range(200))
