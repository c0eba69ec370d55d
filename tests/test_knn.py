"""Tiled kNN join + pools against a numpy brute force (two-path test)."""

import numpy as np
import pytest

from shoprank.operators.knn import SideStats, TileConfig, hybrid_candidates
from shoprank.operators.rank import fuse, pools, top_k

DIM = 8


def _frames(spark, q_t, q_i, c_t, c_i, n_text, n_image, k=3, alpha=0.3):
    qrows = [("g", int(i), int(n_text[i]), int(n_image[i]), k, alpha,
              [float(x) for x in q_t[i]], None if q_i[i] is None else [float(x) for x in q_i[i]])
             for i in range(len(q_t))]
    crows = [("g", int(100 + j), [float(x) for x in c_t[j]], [float(x) for x in c_i[j]]) for j in range(len(c_t))]
    qdf = spark.createDataFrame(qrows, "group_key string, query_id bigint, n_text int, n_image int, k int, "
                                       "alpha double, qt array<float>, qi array<float>")
    cdf = spark.createDataFrame(crows, "group_key string, product_id bigint, tv array<float>, iv array<float>")
    return qdf, cdf


def _cos(q, c):
    q = q.astype(np.float32).astype(np.float64)
    c = c.astype(np.float32).astype(np.float64)
    d = np.array([sum(float(a) * float(b) for a, b in zip(q, row)) for row in c])
    nq = np.sqrt(sum(float(a) * float(a) for a in q))
    nc = np.array([np.sqrt(sum(float(a) * float(a) for a in row)) for row in c])
    den = nq * nc
    return np.where(den != 0, d / np.where(den == 0, 1, den), 0.0)


def _brute_pool(q_t, q_i, c_t, c_i, n_text, n_image):
    ids = np.arange(len(c_t)) + 100
    out = {}
    for i in range(len(q_t)):
        ts = _cos(q_t[i], c_t)
        keep = set(ids[np.lexsort((ids, -ts))[: n_text[i]]])
        if q_i[i] is not None and n_image[i] > 0:
            im = _cos(q_i[i], c_i)
            keep |= set(ids[np.lexsort((ids, -im))[: n_image[i]]])
        out[i] = keep
    return out


CONFIGS = [
    TileConfig(),
    TileConfig(corpus_tile_bytes=300, query_tile_rows=3),           # many tiles, corpus broadcast
    TileConfig(corpus_tile_bytes=300, query_tile_rows=3, broadcast_bytes=0),  # replicated join
    TileConfig(corpus_tile_bytes=300, query_tile_rows=3, broadcast_bytes=0, merge_above=1),  # two merge levels
]


@pytest.mark.parametrize("cfg", CONFIGS)
def test_pools_equal_brute_force(spark, cfg):
    rng = np.random.default_rng(7)
    nq, nc = 12, 40
    q_t, c_t = rng.normal(size=(nq, DIM)), rng.normal(size=(nc, DIM))
    q_i = [rng.normal(size=DIM) for _ in range(nq)]
    c_i = rng.normal(size=(nc, DIM))
    c_t[5] = c_t[6]          # exact tie: product 105 and 106
    c_i[5] = c_i[6]
    q_t[3] = 0.0             # zero question vector scores 0 everywhere
    q_i[4] = None            # text-only question
    n_text = [5] * nq
    n_image = [5] * nq
    n_image[4] = 0
    n_text[7] = 100          # pool larger than the corpus: whole corpus, no sentinel
    qdf, cdf = _frames(spark, q_t, q_i, c_t, c_i, n_text, n_image)
    got = pools(hybrid_candidates(qdf, cdf, cfg, SideStats(nq, DIM, DIM), SideStats(nc, DIM, DIM))).collect()
    pool = {}
    for r in got:
        pool.setdefault(r.query_id, set()).add(r.product_id)
    want = _brute_pool(q_t, q_i, c_t, c_i, n_text, n_image)
    assert pool == want
    # both similarities are exact for every candidate, also when found in one space only
    for r in got:
        assert r.text_sim == pytest.approx(_cos(q_t[r.query_id], c_t[[r.product_id - 100]])[0], abs=1e-12)
        if q_i[r.query_id] is not None:
            assert r.image_sim == pytest.approx(_cos(q_i[r.query_id], c_i[[r.product_id - 100]])[0], abs=1e-12)
        else:
            assert r.image_sim is None


def test_ties_break_by_product_id(spark):
    c = np.ones((4, DIM))
    q_t = np.ones((1, DIM))
    qdf, cdf = _frames(spark, q_t, [np.ones(DIM)], c, c, [2], [2], k=2)
    got = top_k(fuse(pools(hybrid_candidates(qdf, cdf))), 2).orderBy("rank").collect()
    assert [r.product_id for r in got] == [100, 101]


def test_alpha_extremes_follow_one_space(spark):
    rng = np.random.default_rng(3)
    q_t, q_i = rng.normal(size=(1, DIM)), [rng.normal(size=DIM)]
    c_t, c_i = rng.normal(size=(30, DIM)), rng.normal(size=(30, DIM))
    for alpha, space in ((1.0, "text_sim"), (0.0, "image_sim")):
        qdf, cdf = _frames(spark, q_t, q_i, c_t, c_i, [30], [30], k=5, alpha=alpha)
        got = top_k(fuse(pools(hybrid_candidates(qdf, cdf))), 5).orderBy("rank").collect()
        sims = [getattr(r, space) for r in got]
        assert sims == sorted(sims, reverse=True)
        ref = _cos(q_t[0] if space == "text_sim" else q_i[0], c_t if space == "text_sim" else c_i)
        assert sims[0] == pytest.approx(ref.max(), abs=1e-12)


def test_result_invariant_to_repartitioning(spark):
    rng = np.random.default_rng(11)
    q_t, c_t, c_i = rng.normal(size=(6, DIM)), rng.normal(size=(50, DIM)), rng.normal(size=(50, DIM))
    q_i = [rng.normal(size=DIM) for _ in range(6)]
    qdf, cdf = _frames(spark, q_t, q_i, c_t, c_i, [10] * 6, [10] * 6)
    a = top_k(fuse(pools(hybrid_candidates(qdf, cdf))), 3).select("query_id", "rank", "product_id", "score")
    cands = hybrid_candidates(qdf.repartition(5), cdf.repartition(7), TileConfig(corpus_tile_bytes=500))
    b = top_k(fuse(pools(cands)), 3).select("query_id", "rank", "product_id", "score")
    assert sorted(a.collect()) == sorted(b.collect())


@pytest.mark.parametrize("bcast", [64 << 20, 0])
def test_early_emission_keeps_pools_exact(spark, monkeypatch, bcast):
    """A worker that flushes its merge buffer many times still yields the exact pools
    (broadcast pairing and co-grouped replicate pairing)."""
    import pyarrow as pa

    from shoprank.operators import knn

    rng = np.random.default_rng(5)
    nq, nc = 9, 60
    q_t, c_t, c_i = rng.normal(size=(nq, DIM)), rng.normal(size=(nc, DIM)), rng.normal(size=(nc, DIM))
    q_i = [rng.normal(size=DIM) for _ in range(nq)]
    n = [4] * nq
    qdf, cdf = _frames(spark, q_t, q_i, c_t, c_i, n, n)
    # pool_hint=1 makes broadcasting the questions the cheaper plan when it is allowed
    cfg = TileConfig(corpus_tile_bytes=400, query_tile_rows=2, broadcast_bytes=bcast, pool_hint=1 if bcast else 400)
    pairs, mode = knn.tile_pairs(qdf, cdf, cfg,
                                 SideStats(nq, DIM, DIM), SideStats(nc, DIM, DIM))
    assert (mode == "replicate") == (bcast == 0)
    # one partition's rows in partition order, as mapInArrow sees them
    table = pairs.toArrow()
    monkeypatch.setattr(knn, "_EMIT_ROWS", 3)
    score = knn._score_cogrouped if mode == "replicate" else knn._score_batches
    if mode == "replicate":
        table = table.sort_by([("group_key", "ascending"), ("q_tile", "ascending"), ("side", "ascending"),
                               ("c_tile", "ascending")])
    out = list(score(iter(table.to_batches(max_chunksize=1))))
    assert len(out) > 1
    cands = spark.createDataFrame(pa.Table.from_batches(out).to_pandas(), knn.CANDIDATE_SCHEMA)
    assert cands.count() == cands.select("query_id", "product_id").distinct().count()
    got = {}
    for r in pools(cands).collect():
        got.setdefault(r.query_id, set()).add(r.product_id)
    assert got == _brute_pool(q_t, q_i, c_t, c_i, n, n)
