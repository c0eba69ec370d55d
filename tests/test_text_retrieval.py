"""Text questions: distinct encoding and search, fan-out, settings and rejects."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoprank.config import MODE_CHOICES, TEXT_ENCODERS, TEXT_SPACES
from shoprank.functions.encoders import Encoder, encode_distinct, hashing_encoder
from shoprank.plans.text_retrieval import search_texts, text_corpus

ENCODERS = {n: hashing_encoder(n, d) for n, d in TEXT_ENCODERS.items()}


def counting(name, dim, folder):
    """A hashing encoder that notes every text it is given."""
    def factory():
        inner = hashing_encoder(name, dim).factory()

        def encode(texts):
            with open(os.path.join(folder, f"{os.getpid()}"), "a") as f:
                f.writelines(f"{name}|{t}\n" for t in texts)
            return inner(texts)

        return encode

    return Encoder(name, dim, factory)


def seen(folder):
    return sorted(x for f in os.listdir(folder) for x in open(os.path.join(folder, f)).read().splitlines())


@pytest.fixture(scope="module")
def products(spark):
    rows = [(i, f"{c} {t}", f"kind {i % 3}", f"store{i % 2}") for i, (c, t) in enumerate((c, t) for c in ("red", "blue", "green", "red") for t in ("shirt", "mug", "lamp"))]
    return spark.createDataFrame(rows, "product_id long, title string, description string, store string")


def plain(products, text, mode, k, alpha, n):
    """Brute force over all products with numpy."""
    space = {"Clip-Clip": ("clip_text", "clip"), "Clip-STrans": ("sbert_text", "sbert"), "Clip-Blip": ("blip_text", "blip"), "Blip-Text": ("amazon_text", "sbert")}[mode]

    def sims(name, probe):
        encoder, cols = TEXT_SPACES[name]
        model = ENCODERS[encoder].factory()
        c = np.asarray(model([" ".join(r[x] for x in cols) for r in products]), float)
        v = np.asarray(ENCODERS[probe].factory()([text]), float)[0]
        den = np.sqrt((c * c).sum(1)) * np.sqrt((v * v).sum())
        return np.divide(c @ v, den, out=np.zeros(len(c)), where=den != 0)

    ids = np.array([r.product_id for r in products])
    t = sims(*space)
    if mode == "Blip-Text":
        return [(int(ids[j]), t[j]) for j in np.lexsort((ids, -t))[:k]]
    i = sims("clip_image", "clip")
    pool = set(np.lexsort((ids, -t))[:n].tolist()) | set(np.lexsort((ids, -i))[:n].tolist())
    score = {j: alpha * t[j] + (1 - alpha) * i[j] for j in pool}
    return [(int(ids[j]), score[j]) for j in sorted(pool, key=lambda j: (-score[j], ids[j]))[:k]]


def test_each_distinct_text_is_encoded_once(spark):
    folder = tempfile.mkdtemp()
    pairs = [(e, f"text {i % 7}") for i in range(400) for e in ("clip", "sbert")] + [("clip", None), ("unknown", "x"), ("sbert", "")]
    df = spark.createDataFrame(pairs, "encoder string, text string").repartition(6)
    got = encode_distinct(df, [counting("clip", 32, folder), counting("sbert", 24, folder)]).collect()
    want = sorted({f"{e}|{t}" for e, t in pairs if t is not None and e != "unknown"})
    assert seen(folder) == want and sorted(f"{r.encoder}|{r.text}" for r in got) == want
    assert {(r.encoder, len(r.vec)) for r in got} == {("clip", 32), ("sbert", 24)}


def test_wrong_vectors_fail(spark):
    bad = Encoder("clip", 32, lambda: lambda texts: [[1.0]] * len(texts))
    with pytest.raises(Exception, match="wrong shape"):
        encode_distinct(spark.createDataFrame([("clip", "x")], "encoder string, text string"), [bad]).collect()


def test_every_mode_against_brute_force(spark, products):
    folder = tempfile.mkdtemp()
    encoders = {n: counting(n, d, folder) for n, d in TEXT_ENCODERS.items()}
    corpus = text_corpus(products, TEXT_SPACES, encoders)
    encoded = seen(folder)
    assert len(encoded) == len(set(encoded))  # 12 products of 9 titles: each distinct (encoder, text) once
    texts = ["a red mug", "blue lamp, kind 2", "store1 shirt", "nothing alike"]
    settings = [(m, k, a) for m in [*MODE_CHOICES, "Unknown"] for k, a in ((3, 0.15), (5, 1.0))]
    rows = [(i, texts[i % 4], *settings[i % len(settings)], 2) for i in range(200)]
    asked = spark.createDataFrame(rows, "query_id long, text string, model_choice string, k int, alpha double, multiplier int").repartition(5)
    got = search_texts(asked, corpus, encoders).collect()
    base = products.collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.product_id, r.score))
    for i, text, mode, k, alpha, mult in rows:
        want = plain(base, text, mode if mode in MODE_CHOICES else "Clip-Clip", k, alpha, k * mult)
        have = [(p, s) for _, p, s in sorted(by[i])]
        assert [p for p, _ in have] == [p for p, _ in want]
        assert np.allclose([s for _, s in have], [s for _, s in want])
    asked_once = [x for x in seen(folder)]
    for x in encoded:
        asked_once.remove(x)
    assert len(asked_once) == len(set(asked_once)) <= 3 * len(texts)  # 200 questions, four texts, three encoders


def test_rejects_defaults_and_empty(spark, products):
    corpus = text_corpus(products, TEXT_SPACES, ENCODERS, ["Clip-STrans"])
    schema = "query_id long, text string, alpha double"
    rows = [(1, "red mug", None), (2, "", 0.5), (3, None, 0.5), (4, "red mug", 1.5), (None, "red mug", 0.5), (5, "red mug", 0.5), (5, "red mug", 0.5)]
    out = search_texts(spark.createDataFrame(rows, schema), corpus, ENCODERS).groupBy("query_id").agg(F.count("*").alias("n")).collect()
    assert {(r.query_id, r.n) for r in out} == {(1, 5), (5, 10)}  # k of 5 by default; a question asked twice is answered twice
    assert search_texts(spark.createDataFrame([], schema), corpus, ENCODERS).collect() == []


def test_scoring_of_a_small_corpus_is_spread(spark, products):
    """A corpus that lies in one partition is scored by several tasks."""
    from shoprank.operators.knn import SideStats, TileConfig, tile_pairs

    q = spark.createDataFrame([("g", 1, 1, 0, 1, 1.0, [1.0, 0.0], None)], "group_key string, query_id long, n_text int, n_image int, k int, alpha double, qt array<float>, qi array<float>")
    c = spark.range(5000).coalesce(1).selectExpr("'g' AS group_key", "id AS product_id", "array(CAST(id AS float), CAST(1 AS float)) AS tv", "CAST(NULL AS array<float>) AS iv")
    pairs, mode = tile_pairs(q, c, TileConfig(), SideStats(1, 2, 0), SideStats(5000, 2, 0))
    tasks = pairs.select(F.spark_partition_id().alias("p"), F.size("c_ids").alias("n")).collect()
    assert mode == "questions" and len({r.p for r in tasks}) >= 4 and sum(r.n for r in tasks) == 5000
