"""Approximate search by cells against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoprank.operators import cells
from shoprank.operators.cells import build_cells, calibrated_probes, fit_centroids, search_cells
from shoprank.plans.queries import QUERIES

from .conftest import SF_ORACLE, SF_SMALL


def plain(q, x, ids, n):
    den = np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum())
    s = np.divide(x @ q, den, out=np.zeros(len(x)), where=den != 0)
    return [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s))[:n]]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 6)) * 2
    x = np.concatenate([centre[rng.integers(0, 12, 400)] + rng.normal(size=(400, 6)) * 0.3, np.zeros((2, 6)), np.ones((5, 6))]).astype(np.float32)
    rows = [(1000 + i, [float(v) for v in r]) for i, r in enumerate(x)]
    return x.astype(float), spark.createDataFrame(rows, "product_id long, vec array<float>").repartition(4)


def asked(spark, x, n):
    return spark.createDataFrame([(i, [float(v) for v in r], n[i % len(n)]) for i, r in enumerate(x.astype(np.float32))], "query_id long, vec array<float>, n int")


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_all_cells_are_the_exact_answer(spark, corpus, monkeypatch, broadcast):
    monkeypatch.setattr(cells, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(cells, "CELL_ROWS", 40)
    monkeypatch.setattr(cells, "PROBE_ROWS", 7)
    x, df = corpus
    index = build_cells(df, 9)
    q = np.concatenate([x[::40], np.zeros((1, 6))])
    stored = index.table(spark).select("cell", F.explode("pids").alias("p")).collect()
    assert sorted(r.p for r in stored) == [1000 + i for i in range(len(x))]  # every row once, crowded cells in parts
    got = {}
    for r in search_cells(asked(spark, q, [3, 10, 500]), index, 9).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.product_id, r.sim))
    for i, v in enumerate(q):
        want = plain(v, x, np.arange(len(x)) + 1000, [3, 10, 500][i % 3])
        assert [(p, pytest.approx(s, abs=1e-12)) for _, p, s in sorted(got[i])] == want


def test_fewer_cells_and_calibration(spark, corpus):
    x, df = corpus
    index = build_cells(df, 12)
    questions = asked(spark, x[:60], [10])
    exact = search_cells(questions, index, 12)
    one = search_cells(questions, index, 1).join(exact, ["query_id", "product_id"], "left_semi").count()
    probes = calibrated_probes(questions, index, exact, 0.9)
    some = search_cells(questions, index, probes).join(exact, ["query_id", "product_id"], "left_semi").count()
    assert one <= some and some >= 0.9 * 600 and probes < 12


def test_probed_cells_are_pruned(spark, corpus):
    index = build_cells(corpus[1], 12)
    plan = search_cells(asked(spark, corpus[0][:1], [5]), index, 1)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan


def test_awkward_corpora(spark):
    schema = "product_id long, vec array<float>"
    questions = spark.createDataFrame([(1, [1.0, 0.0], 3)], "query_id long, vec array<float>, n int")
    assert search_cells(questions, build_cells(spark.createDataFrame([], schema)), 3).collect() == []
    same = build_cells(spark.createDataFrame([(i, [1.0, 1.0]) for i in range(50)], schema), 8)
    assert len(same.centroids) == 1 and [r.product_id for r in search_cells(questions, same, 4).orderBy("rank").collect()] == [0, 1, 2]
    assert search_cells(questions.limit(0), same, 4).collect() == []
    assert len(fit_centroids(np.zeros((5, 3)), 2)) == 1


def test_recall_query(spark):
    r = QUERIES["cell_recall"](spark, SF_ORACLE).first()
    assert r.recall >= 0.9 and r.n_exact == 5000 and r.probed < r.cells
    got = QUERIES["cell_topk"](spark, SF_SMALL)
    assert got.groupBy("query_id").count().where("count <> 10").count() == 0 and got.count() == 2000
