"""Keyed sinks: replacement, atomic publication, conflicts, formats."""

import os

import pytest
from pyspark.sql import functions as F

from shoprank.session import scratch_path
from shoprank.sources.sinks import KeyedSink

SCHEMA = "query_id long, rank int, product_id long, note string"


def rows(spark, items):
    return spark.createDataFrame([(q, r, p, f"n{q}\n\"{r}\"") for q, r, p in items], SCHEMA)


def got(spark, sink):
    return sorted((r.query_id, r["rank"], r.product_id) for r in sink.read(spark).collect())


@pytest.mark.parametrize("form", ["parquet", "json"])
def test_written_twice_is_there_once(spark, form):
    sink = KeyedSink(scratch_path(spark, "sink"), parts=4, format=form)
    first = [(q, r, 10 * q + r) for q in range(20) for r in (1, 2, 3)]
    assert sink.write(rows(spark, first)) == 1 and got(spark, sink) == first
    assert sink.write(rows(spark, first)) == 2 and got(spark, sink) == first
    # a question that is answered anew loses its old ranks; others stay
    assert sink.write(rows(spark, [(3, 1, 999), (77, 1, 5)])) == 3
    want = sorted([x for x in first if x[0] != 3] + [(3, 1, 999), (77, 1, 5)])
    assert got(spark, sink) == want
    assert {r.note for r in sink.read(spark).where("query_id = 3").collect()} == {"n3\n\"1\""}
    assert sink.write(rows(spark, [])) == 3 and got(spark, sink) == want
    if form == "json":
        folder = os.path.join(sink.path.removeprefix("file:"), "data")
        assert any(f.endswith(".json") for _, _, files in os.walk(folder) for f in files)


def test_a_broken_write_leaves_the_old_rows(spark, monkeypatch):
    sink = KeyedSink(scratch_path(spark, "sink"), parts=3)
    first = [(q, 1, q) for q in range(12)]
    sink.write(rows(spark, first))
    fails = rows(spark, [(q, 1, 100 + q) for q in range(12)]).withColumn("product_id", F.when(F.col("query_id") == 7, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("product_id")))
    with pytest.raises(Exception, match="killed"):
        sink.write(fails)
    assert got(spark, sink) == first
    with monkeypatch.context() as m:  # dies after its files, before its manifest
        m.setattr(KeyedSink, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("gone")))
        with pytest.raises(RuntimeError, match="gone"):
            sink.write(rows(spark, [(5, 1, 55)]))
    assert got(spark, sink) == first
    sink.write(rows(spark, [(5, 1, 56)]))
    assert (5, 1, 56) in got(spark, sink) and len(got(spark, sink)) == 12


def test_of_two_writers_one_fails(spark, monkeypatch):
    sink = KeyedSink(scratch_path(spark, "sink"), parts=3)
    sink.write(rows(spark, [(1, 1, 1)]))
    publish = KeyedSink._publish

    def late(self, spark, number, content):
        monkeypatch.setattr(KeyedSink, "_publish", publish)
        self.write(rows(spark, [(2, 1, 2)]))  # another writer comes first
        publish(self, spark, number, content)

    monkeypatch.setattr(KeyedSink, "_publish", late)
    with pytest.raises(RuntimeError, match="run this one again"):
        sink.write(rows(spark, [(3, 1, 3)]))
    assert got(spark, sink) == [(1, 1, 1), (2, 1, 2)]


def test_checks(spark):
    sink = KeyedSink(scratch_path(spark, "sink"), parts=3)
    with pytest.raises(FileNotFoundError):
        sink.read(spark)
    with pytest.raises(ValueError, match="share a key"):
        sink.write(rows(spark, [(1, 1, 1), (1, 1, 2)]))
    with pytest.raises(Exception, match="without a key"):
        sink.write(rows(spark, [(None, 1, 1)]))
    sink.write(rows(spark, [(1, 1, 1)]))
    with pytest.raises(ValueError, match="the sink holds"):
        sink.write(spark.createDataFrame([(1, "x")], "query_id long, rank string"))
    empty = KeyedSink(scratch_path(spark, "sink"), parts=3)
    empty.write(rows(spark, []))
    assert got(spark, empty) == []
