"""Two-phase search over product codes against brute force, and the tile join under it."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shoprank.operators import product_codes, tile_join
from shoprank.operators.product_codes import build_codes, search_codes, survivors
from shoprank.plans.queries import QUERIES

from .conftest import SF_ORACLE


def frames(spark, x, q, n):
    v = "vec array<float>"
    rows = [(500 + i, [float(a) for a in r]) for i, r in enumerate(x)]
    asked = [(i, [float(a) for a in r], n[i % len(n)]) for i, r in enumerate(q)]
    return spark.createDataFrame(rows, f"product_id long, {v}").repartition(5), spark.createDataFrame(asked, f"query_id long, {v}, n int").repartition(3)


def plain(q, x, n):
    q, x = q.astype(np.float32).astype(float), x.astype(np.float32).astype(float)
    den = np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum())
    s = np.divide(x @ q, den, out=np.zeros(len(x)), where=den != 0)
    ids = np.arange(len(x)) + 500
    return [int(ids[j]) for j in np.lexsort((ids, -np.round(s, 12)))[:n]]


@pytest.mark.parametrize("broadcast", [0, 1 << 26])
@pytest.mark.parametrize("dim, m", [(10, 4), (3, 3), (7, 2)])
def test_same_as_exact(spark, monkeypatch, broadcast, dim, m):
    monkeypatch.setattr(tile_join, "BROADCAST_BYTES", broadcast)
    rng = np.random.default_rng(dim)
    x = np.concatenate([rng.normal(size=(300, dim)), np.zeros((2, dim)), np.ones((6, dim)), rng.normal(size=(40, dim)) * 0.01 + 1])
    q = np.concatenate([x[::29], rng.normal(size=(5, dim)), np.zeros((1, dim))])
    corpus, questions = frames(spark, x, q, [1, 7, 400])
    coded = build_codes(corpus, m, sample_rows=100, tile_bytes=900)
    got = {}
    for r in search_codes(questions, coded).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.product_id))
    for i, v in enumerate(q):
        assert [p for _, p in sorted(got[i])] == plain(v, x, [1, 7, 400][i % 3])


def test_few_survive_and_none_is_lost(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 8))
    corpus, questions = frames(spark, x, x[:40] + rng.normal(size=(40, 8)) * 0.1, [5])
    coded = build_codes(corpus, 8)
    kept = survivors(questions, coded).groupBy("query_id").agg(F.count("*").alias("n")).collect()
    assert len(kept) == 40 and all(5 <= r.n for r in kept) and sum(r.n for r in kept) < 0.1 * 40 * 3000


def test_bounds_hold():
    rng = np.random.default_rng(4)
    x = product_codes._unit(rng.normal(size=(500, 9)))
    books = product_codes.fit_books(x[:50], 4)
    p = product_codes._pieces(x, 4)
    codes = np.stack([product_codes._nearest(p[:, j], books[j]) for j in range(4)], 1)
    near = books[np.arange(4), codes]
    err = np.sqrt(((p - near) ** 2).sum((1, 2)))
    q = product_codes._pieces(product_codes._unit(rng.normal(size=(30, 9))), 4)
    true, about = np.einsum("qmw,nmw->qn", q, p), np.einsum("qmw,nmw->qn", q, near)
    assert (np.abs(true - about) <= err + 1e-12).all()


def test_empty_tables(spark):
    none, questions = frames(spark, np.zeros((0, 2)), np.ones((2, 2)), [3])
    assert search_codes(questions, build_codes(none, 2)).collect() == []
    some, _ = frames(spark, np.ones((4, 2)), np.ones((2, 2)), [3])
    assert search_codes(questions.limit(0), build_codes(some, 2)).collect() == []


@pytest.mark.parametrize("broadcast", [0, 1 << 26])
def test_every_tile_meets_every_tile_once(spark, monkeypatch, broadcast):
    monkeypatch.setattr(tile_join, "BROADCAST_BYTES", broadcast)

    def score(pairs):
        for _, a, _, b in pairs:
            i = np.repeat(a.column("id").to_numpy(), len(b))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.tile(b.column("id").to_numpy(), len(a)))], names=["a", "b"])

    left, right = (tile_join.pack(spark.range(n).repartition(p), rows) for n, p, rows in ((37, 3, 4), (53, 4, 5)))
    got = tile_join.tile_join(left, right, score, "a long, b long")
    assert got.count() == 37 * 53 == got.distinct().count()


def test_report(spark):
    r = QUERIES["coded_search_report"](spark, SF_ORACLE).first()
    assert r.n_pairs == r.n_questions * r.n_vectors and 200 * r.n_questions <= r.n_rescored < r.n_pairs and 2 * r.code_bytes <= r.float_bytes
