"""The certified fused top k against brute force over the whole corpus."""

import numpy as np
import pytest

from shoprank.plans.certified import certified_topk


def setup(spark, seed, rows=150, dim=5):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(rows, 2, dim)).astype(np.float32)
    c[3] = c[4]  # an exact tie
    q = rng.normal(size=(24, 3, dim)).astype(np.float32)
    pairs = ["sbert_text|clip_image", "clip_text|clip_image", "blip_text|clip_image", "amazon_text|"]
    f = lambda v: [float(x) for x in v]
    corpus = spark.createDataFrame([(p, i, f(t), f(m) if "image" in p else None) for p in pairs for i, (t, m) in enumerate(c)],
                                   "group_key string, product_id long, tv array<float>, iv array<float>")
    modes = ["Clip-STrans", "Clip-Clip", "Clip-Blip", "Blip-Text"]
    asked = [(i, modes[i % 4], [3, 7, 200][i % 3], [0.0, 0.3, 0.5, 1.0][(i // 3) % 4], 1 + i % 2, f(a), f(b), f(d)) for i, (a, b, d) in enumerate(q)]
    questions = spark.createDataFrame(asked, "query_id long, model_choice string, k int, alpha double, multiplier int, clip array<float>, sbert array<float>, blip array<float>")
    return c.astype(float), q.astype(float), asked, corpus, questions


def plain(c, q, row):
    i, mode, k, alpha, mult, *_ = row
    probe = {"Clip-STrans": 1, "Clip-Clip": 0, "Clip-Blip": 2, "Blip-Text": 1}[mode]

    def cos(x, v):
        return (x @ v) / np.sqrt((x * x).sum(1) * (v * v).sum())

    t, m = cos(c[:, 0], q[i, probe]), cos(c[:, 1], q[i, 0])
    ids = np.arange(len(c))
    score = t if mode == "Blip-Text" else alpha * t + (1 - alpha) * m
    best = np.lexsort((ids, -np.round(score, 12)))[:k].tolist()
    n = k * mult
    pool = np.array(sorted(set(np.lexsort((ids, -t))[:n].tolist()) | set(np.lexsort((ids, -m))[:n].tolist())))
    in_pool = best if mode == "Blip-Text" else pool[np.lexsort((pool, -np.round(score[pool], 12)))][:k].tolist()
    return best, best == in_pool


@pytest.mark.parametrize("seed, growth", [(1, 2), (2, 4)])
def test_true_top_k(spark, seed, growth):
    c, q, asked, corpus, questions = setup(spark, seed)
    got = {}
    for r in certified_topk(questions, corpus, growth=growth).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.product_id, r.pool_is_exact, r.rounds))
    wrong = 0
    for row in asked:
        best, same = plain(c, q, row)
        mine = sorted(got[row[0]])
        assert [p for _, p, _, _ in mine] == best and {x for _, _, x, _ in mine} == {same}
        wrong += not same
    assert wrong >= 3  # small pools do miss rows
    assert max(r for rows in got.values() for *_, r in rows) > 1


def test_no_corpus_and_no_questions(spark):
    _, _, _, corpus, questions = setup(spark, 3)
    assert certified_topk(questions, corpus.limit(0)).collect() == []
    assert certified_topk(questions.limit(0), corpus).collect() == []


def test_no_pool_is_enlarged(spark, monkeypatch):
    """Questions that their pools don't certify are searched once more, for k rows each: nothing that is held or written grows with the pools
    that a certificate would need."""
    from shoprank.operators import knn
    from shoprank.plans import certified

    asked = []
    search = certified.hybrid_candidates
    monkeypatch.setattr(certified, "hybrid_candidates", lambda q, *a, **b: asked.append(q.agg({"n_text": "max"}).first()[0]) or search(q, *a, **b))
    pooled = []
    pools = certified.candidate_pools
    monkeypatch.setattr(certified, "candidate_pools", lambda q, *a, **b: pooled.append(q.count()) or pools(q, *a, **b))
    monkeypatch.setattr(knn, "_STEP", 16)
    c, q, rows, corpus, questions = setup(spark, 4, rows=400)
    got = certified_topk(questions.where("k < 10"), corpus.repartition(3), knn.TileConfig(corpus_tile_bytes=3000)).collect()
    assert len(pooled) == 1 and asked == [7]
    assert {r.rounds for r in got} == {1, 2}
    for row in rows:
        if row[2] < 10:
            assert [p for _, p in sorted((r["rank"], r.product_id) for r in got if r.query_id == row[0])] == plain(c, q, row)[0]
