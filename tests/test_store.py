"""Stored vector sets and catalog: pruning, joins without a shuffle, checks at the write."""

import re

import pytest
from pyspark.sql import functions as F

from shoprank.config import MODE_SPACES, SPACE_SLICES
from shoprank.plans.fixtures import mixed_mode_questions, parity_questions
from shoprank.plans.retrieval import resolved_mode, retrieve
from shoprank.sources.catalog import catalog_from_tables
from shoprank.sources.store import drop_store, space_vectors, store_stats, stored_catalog, stored_corpus, used_spaces, write_store
from shoprank.sources.vectors import corpus_stats, product_vectors

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def store(spark):
    s = write_store(space_vectors(spark, SF_SMALL), catalog_from_tables(spark, SF_SMALL), buckets=4)
    yield s
    drop_store(spark, s)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_store_holds_what_the_slices_give(spark, store):
    assert store.dims == {name: n for name, (_, n) in SPACE_SLICES.items()} and store.rows == 200
    want = product_vectors(spark, SF_SMALL).select("group_key", "product_id", "tv", "iv")
    got = stored_corpus(spark, store)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    stats, known = store_stats(store), corpus_stats(spark, SF_SMALL)
    assert (stats.dim_t, stats.dim_i) == (known.dim_t, known.dim_i) and stats.rows == 800


def test_text_and_image_join_without_a_shuffle(spark, store):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "Exchange" not in plan_of(stored_corpus(spark, store, modes=["Clip-STrans"]))
        asked = spark.range(50).select(F.col("id").alias("product_id"))
        plan = plan_of(asked.join(stored_catalog(spark, store), "product_id"))
        assert plan.count("Exchange hashpartitioning") == 1  # of the asking side, into the catalog's buckets
        assert "SelectedBucketsCount: 4 out of 4" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_catalog_side_of_the_flagship_has_no_exchange(spark, store):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = retrieve(parity_questions(spark, SF_SMALL), stored_corpus(spark, store, modes=["Clip-STrans"]), stored_catalog(spark, store),
                       cstats=store_stats(store, ["Clip-STrans"]))
        plan = plan_of(out)
        scan = next(i for i, line in enumerate(plan.splitlines()) if store.catalog in line)
        depth = lambda line: len(re.match(r"[ :|+\-]*", line)[0])
        lines = plan.splitlines()
        here = depth(lines[scan])
        above = []
        for line in reversed(lines[:scan]):
            if depth(line) < here:
                here = depth(line)
                above.append(line)
                if "Join" in line:
                    break
        assert "Join" in above[-1] and not any("Exchange" in x for x in above)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_used_spaces_are_read(spark, store):
    modes = mixed_mode_questions(spark, SF_SMALL).select(resolved_mode().alias("route_mode"))
    assert {r.space for r in used_spaces(modes).collect()} == {s for pair in MODE_SPACES.values() for s in pair if s}
    text_only = modes.where("route_mode = 'Blip-Text'")
    assert [r.space for r in used_spaces(text_only).collect()] == ["amazon_text"]
    corpus = stored_corpus(spark, store, text_only)
    assert "dynamicpruning" in plan_of(corpus)
    assert {r.group_key for r in corpus.select("group_key").distinct().collect()} == {"amazon_text|"}


def test_static_partitions_are_pruned(spark, store):
    plan = plan_of(stored_corpus(spark, store, modes=["Blip-Text"]))
    assert re.search(r"PartitionFilters: \[[^\]]*amazon_text", plan) and "clip_image" not in plan


def test_write_checks(spark):
    schema = "space string, product_id long, embedding array<float>"
    bad = spark.createDataFrame([("a", 1, [1.0, 2.0]), ("a", 2, [1.0]), ("b", 1, [1.0])], schema)
    with pytest.raises(ValueError, match=r"\['a'\]"):
        write_store(bad, buckets=2)
    rows = spark.createDataFrame([("a", 1, [3.0, 4.0]), (None, 2, [1.0]), ("a", None, [1.0]), ("a", 3, None), ("a", 4, [0.0, 0.0])], schema)
    s = write_store(rows, buckets=2)
    assert {(r.product_id, r.norm) for r in spark.table(s.vectors).collect()} == {(1, 5.0), (4, 0.0)} and s.catalog is None
    assert write_store(rows.limit(0), buckets=2).dims == {}
