"""Memory of the kernels on texts: bounded by a chunk, not by an Arrow batch."""

import tracemalloc
from unittest import mock

import numpy as np
import public_tokenizers
import pyarrow as pa

import corpus_pipeline
from unitloom.llm import bpe, shared
from unitloom.llm.minhash import Shingles, _set_rows


def _texts(n):
    rnd = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(5_000)])
    return [" ".join(words[rnd.integers(0, len(words), 500)]) for _ in range(n)]


def _peak(run):
    run()
    tracemalloc.start()
    run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / (1 << 20)


def test_sets_of_a_batch_need_the_memory_of_a_chunk():
    column = pa.array(_texts(1_500))
    shingles = Shingles(5)
    assert column.nbytes > 3 << 20
    assert _peak(lambda: [None for _ in shingles.sets(column)]) < 20


def test_sets_wait_in_small_batches():
    texts = pa.array(_texts(1_500))
    n = len(texts)
    ids = pa.array(range(n), pa.int64())
    role = pa.StructArray.from_arrays([ids, pa.array([0] * n, pa.int32()), pa.array([1] * n, pa.int32())], ["lead", "salt", "role"])
    roles = pa.ListArray.from_arrays(pa.array(range(n + 1), pa.int32()), role)
    batch = pa.RecordBatch.from_arrays([ids, texts, roles], ["doc_id", "text", "roles"])
    out = list(_set_rows(5)([batch]))
    assert sum(b.num_rows for b in out) == n and max(b.nbytes for b in out) < 3 << 20


def test_batches_are_bounded_in_bytes(spark):
    names = [f"spark.sql.execution.arrow.{n}" for n in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = [spark.conf.get(n, None) for n in names]
    try:
        spark.conf.set(names[1], "2147483647")
        shared.small_batches(spark)
        assert int(spark.conf.get(names[1])) == 4 << 20
        spark.conf.set(names[1], "1000")
        shared.small_batches(spark)
        assert int(spark.conf.get(names[1])) == 1000
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def test_blocks_of_the_tokenize_stage_need_little_memory(spark, monkeypatch):
    used = []

    def noted(docs, ranks, pattern, block_chars=bpe.BLOCK_CHARS):
        used.append(block_chars)
        return bpe.encode(docs, ranks, pattern, block_chars)

    monkeypatch.setattr(corpus_pipeline, "encode", noted)
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert corpus_pipeline.tokenize(spark, docs, "").first().text == "a b"
    texts = pa.array(_texts(4_000))
    batches = pa.Table.from_arrays([pa.array(range(len(texts)), pa.int64()), texts], ["doc_id", "text"]).to_batches(500)
    cut = bpe._positions(bpe.splitter_spec(public_tokenizers.PATTERN), 12, used[0])
    assert sum(len(t.as_py()) for t in texts) > 10 << 20
    assert _peak(lambda: [None for _ in bpe_task(cut, batches)]) < 60


def bpe_task(cut, batches):
    """As a task runs it."""
    with mock.patch("pyspark.TaskContext.get", lambda: mock.Mock(partitionId=lambda: 0)):
        yield from cut(batches)
