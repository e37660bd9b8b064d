"""Batches are small in both directions, and workers keep nothing for a function they have left."""

import os

import pyarrow as pa
from pyspark.sql import functions as F

from fringeworks.llm import scratch, wordids
from fringeworks.llm.queries import tokenizer_path

MOST = 4 << 20


def test_batches_are_small_both_ways(spark):
    def sized(batches):
        for batch in batches:
            n = batch.nbytes
            yield pa.RecordBatch.from_arrays([pa.array([n] * batch.num_rows), batch.column(0)], names=["n", "text"])

    def joined(batches):
        yield pa.Table.from_batches(list(batches)).combine_chunks().to_batches()[0]

    texts = spark.range(0, 3000, 1, 1).select(F.expr("repeat(cast(id as string), 2000)").alias("text"))
    for df in (texts, scratch.in_arrow(texts, joined, "text string")):
        rows = scratch.in_arrow(df, sized, "n long, text string").collect()
        assert sorted(r.text for r in rows) == sorted(str(i) * 2000 for i in range(3000))
        assert max(r.n for r in rows) <= MOST


def test_slices_hold_all_rows_in_order():
    for rows in ([], [b"x"], [b"x" * (5 << 20), b"", b"y"], [b"%d" % i * 1000 for i in range(4000)]):
        batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(range(len(rows)), pa.int64())], names=["a", "b"])
        parts = list(scratch.in_slices(batch))
        assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
        assert all(p.nbytes <= MOST or p.num_rows == 1 or len(rows) == 3 for p in parts)


def test_an_encoder_goes_when_its_worker_turns_to_another_function(spark):
    path = tokenizer_path()

    def encodes(batches):
        for batch in batches:
            wordids.encoder(path).encode(["a word"])
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()] * batch.num_rows), pa.array([len(wordids._encoders)] * batch.num_rows)], names=["pid", "n"])

    def other(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()] * batch.num_rows), pa.array([len(wordids._encoders)] * batch.num_rows)], names=["pid", "n"])

    def told(f):
        return {r.pid: r.n for r in scratch.in_arrow(spark.range(0, 64, 1, 8), f, "pid long, n long").collect()}

    first, again, after = told(encodes), told(encodes), told(other)
    assert set(first.values()) == set(again.values()) == {1}
    assert set(first) & set(after) and set(after.values()) == {0}
