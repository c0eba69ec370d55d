"""What grows with the tables: memory, rows and copies of the searches on tables larger than a tile."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from shoprank.functions.hashing import dense_counts, token_buckets
from shoprank.operators import knn
from shoprank.operators.prompts import blocks_of
from shoprank.sources.vectors import valid_vectors


def tile(ids, t, i, n, key="g"):
    """One packed tile as a row of arrays."""
    rows = pa.table({"group_key": [key] * len(ids), "tile": pa.array([0] * len(ids), pa.int32()), "id": pa.array(ids, pa.int64()),
                     **{c: pa.array([n] * len(ids), pa.int32()) for c in ("n", "n_i", "k")}, "alpha": [0.5] * len(ids),
                     "vt": pa.array(list(t.astype(np.float32)), pa.list_(pa.float32())), "vi": pa.array(list(i.astype(np.float32)), pa.list_(pa.float32()))})
    return knn._pack_tile(rows)


def pairs(q, corpus):
    """Rows of :func:`knn._score_batches`: a question tile with every corpus tile, one a batch."""
    for number, c in enumerate(corpus):
        cols = {"group_key": q["group_key"], **{"q_" + f: q[f] for f in q.column_names[1:]}, **{"c_" + f: c[f] for f in c.column_names[1:]}}
        cols["c_tile"] = pa.chunked_array([pa.array([number], pa.int32())])
        yield from pa.table(cols).to_batches()


def found(batches):
    t = pa.Table.from_batches(batches)
    return {(q, p): (a, b) for q, p, a, b in zip(*(t[c].to_pylist() for c in ("query_id", "product_id", "text_sim", "image_sim")))}


def test_scoring_holds_little(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(knn, "_EMIT_ROWS", 1 << 30)
    q = tile(np.arange(600), rng.normal(size=(600, 24)), rng.normal(size=(600, 32)), 20)
    corpus = [tile(np.arange(k * 8000, (k + 1) * 8000), rng.normal(size=(8000, 24)), rng.normal(size=(8000, 32)), 0) for k in range(3)]
    tracemalloc.start()
    rows = sum(b.num_rows for b in knn._score_batches(pairs(q, corpus)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 600 * 20 < rows <= 600 * 40
    assert peak < 40 << 20  # float64 similarities of 4 million pairs took 150 MB


@pytest.mark.parametrize("held", [50, 4_000_000])
def test_ties_beyond_what_is_held(monkeypatch, held):
    """Equal vectors reach every bound; blocks of questions are cut until what they hold fits, and the least ids win."""
    monkeypatch.setattr(knn, "_HELD_CELLS", held)
    monkeypatch.setattr(knn, "_STEP", 16)
    rng = np.random.default_rng(2)
    t, i = np.ones((90, 4)), rng.normal(size=(90, 4))
    t[::9] = rng.normal(size=(10, 4))
    qt, qi = np.concatenate([t[:5], np.zeros((2, 4))]), rng.normal(size=(7, 4))
    order = rng.permutation(90)
    corpus = [tile(order[at:at + 45], t[order[at:at + 45]], i[order[at:at + 45]], 0) for at in (0, 45)]
    got = found(knn._score_batches(pairs(tile(np.arange(7), qt, qi, 6), corpus)))

    def best(v, m):
        m, v = m.astype(np.float32).astype(float), v.astype(np.float32).astype(float)
        den = np.sqrt((m * m).sum(1) * (v * v).sum())
        return set(np.lexsort((np.arange(90), -np.round(np.divide(m @ v, den, out=np.zeros(90), where=den != 0), 12)))[:6].tolist())

    for x in range(7):
        assert {p for a, p in got if a == x} == best(qt[x], t) | best(qi[x], i)


def test_rank_keep_is_the_sorted_rank():
    rng = np.random.default_rng(3)
    for _ in range(30):
        rows, ids = rng.integers(0, 7, 200), rng.integers(0, 60, 200)
        score = np.where(rng.random(200) < 0.1, -np.inf, rng.integers(0, 9, 200) / 8)
        n = np.array([0, 1, 3, 10, 25, 60, 300])
        order = np.lexsort((ids, -score, rows))
        r = rows[order]
        rank = np.arange(200) - np.searchsorted(r, r)
        want = sorted(zip(r[rank < n[r]], ids[order][rank < n[r]], score[order][rank < n[r]]))
        keep = knn._rank_keep(rows, ids, score, n)
        assert sorted(zip(rows[keep], ids[keep], score[keep])) == want


def test_few_survive_the_codes(spark):
    """24 dimensions in 8 pieces: one level of codes left a sixth of all pairs to rescore; they are counted without being written."""
    from pyspark.sql import functions as F

    from shoprank.operators.product_codes import build_codes, survivor_counts, survivors

    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 24)).astype(np.float32)
    v = "vec array<float>"
    corpus = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], f"product_id long, {v}").repartition(4)
    asked = spark.createDataFrame([(i, r.tolist(), 10) for i, r in enumerate(x[:50])], f"query_id long, {v}, n int")
    coded = build_codes(corpus)
    count = {r.query_id: r.n_rescored for r in survivor_counts(asked, coded).collect()}
    assert len(count) == 50 and all(r >= 10 for r in count.values()) and sum(count.values()) < 0.02 * 50 * 4000
    assert count == {r.query_id: r.n for r in survivors(asked, coded).groupBy("query_id").agg(F.count("*").alias("n")).collect()}


def test_question_texts_are_not_broadcast(spark, monkeypatch, tmp_path):
    """Texts that Spark makes of a few packed bytes a row look small to its planner; a join by question takes none of them to the driver."""
    from shoprank.plans import queries

    path = str(tmp_path / "asked")
    spark.range(50_000).selectExpr("id AS query_id").write.parquet(path)
    texts = spark.read.parquet(path).selectExpr("query_id", "repeat('long text ', 20) AS query", "'None' AS constraints", "'word' AS keywords")
    blocks = spark.range(3_000_000).selectExpr("id AS query_id", "1 AS rank", "CAST(id AS STRING) AS block")
    monkeypatch.setattr(queries, "blocks_of", lambda found, catalog: blocks)
    found = spark.createDataFrame([(1, 1, 1)], "query_id long, rank int, product_id long")
    plan = queries.rag_requests(texts, lambda asked: found, found)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_equal_vectors_are_scored_once(monkeypatch):
    """A space with few different vectors (store names) ties for most of the corpus: the rows that tie are neither scored nor held one by one."""
    rng = np.random.default_rng(8)
    stores, order = np.eye(5), rng.permutation(6000)
    t, i = rng.normal(size=(6000, 4)), stores[rng.integers(0, 5, 6000)]
    qt, qi = rng.normal(size=(50, 4)), stores[rng.integers(0, 5, 50)]
    pairs_scored, exact = [], knn._cosines
    monkeypatch.setattr(knn, "_cosines", lambda q, c, r, j: pairs_scored.append(r.size) or exact(q, c, r, j))
    corpus = [tile(order[at:at + 3000], t[order[at:at + 3000]], i[order[at:at + 3000]], 0) for at in (0, 3000)]
    got = found(knn._score_batches(pairs(tile(np.arange(50), qt, qi, 20), corpus)))
    assert sum(pairs_scored) < 50 * 2 * 2 * 60  # with 1,200 rows of each store: above 100,000
    t, qt = t.astype(np.float32).astype(float), qt.astype(np.float32).astype(float)
    for x in range(50):
        by_text = np.lexsort((np.arange(6000), -(t @ qt[x]) / np.sqrt((t * t).sum(1))))[:20]
        by_store = np.lexsort((np.arange(6000), -(i @ qi[x])))[:20]
        assert {p for a, p in got if a == x} == set(by_text.tolist()) | set(by_store.tolist())


def test_a_tile_is_merged_a_few_times_not_once_a_corpus_tile(monkeypatch):
    """What is held for a block of questions was sorted again with every corpus tile, however little the tile added."""
    rng = np.random.default_rng(4)
    q = tile(np.arange(100), rng.normal(size=(100, 6)), rng.normal(size=(100, 5)), 30)
    t, i = rng.normal(size=(8000, 6)), rng.normal(size=(8000, 5))
    corpus = [tile(np.arange(a, a + 200), t[a:a + 200], i[a:a + 200], 0) for a in range(0, 8000, 200)]
    ranked, exact = [], knn._nth_best
    monkeypatch.setattr(knn, "_nth_best", lambda rows, score, n: ranked.append(rows.size) or exact(rows, score, n))
    got = found(knn._score_batches(pairs(q, corpus)))
    assert sum(n > 100 * 30 for n in ranked) < 60  # two scores, merged and bounded with each of 40 tiles: above 160
    for x in range(100):
        want = set()
        for m, v in ((t, q["mat_t"][0].as_py()), (i, q["mat_i"][0].as_py())):
            m = m.astype(np.float32).astype(float)
            v = np.frombuffer(v, "<f4").reshape(100, -1)[x].astype(float)
            want |= set(np.argsort(-(m @ v) / np.sqrt((m * m).sum(1)))[:30].tolist())
        assert {p for a, p in got if a == x} == want


def test_copies_of_tiles_are_handed_on_one_by_one(spark):
    """The replicate pairing copied a tile by explode, which made all copies (217 of up to 32 MB at 615,384 vectors) before the first left the task."""
    v = "array(cast(id AS float), 1.0F)"
    asked = spark.range(200).selectExpr("'g' AS group_key", "id AS query_id", "3 AS n_text", "3 AS n_image", "1 AS k", "0.5D AS alpha", f"{v} AS qt", f"{v} AS qi")
    corpus = spark.range(300).selectExpr("'g' AS group_key", "id AS product_id", f"{v} AS tv", f"{v} AS iv")
    made, mode = knn.tile_pairs(asked, corpus, knn.TileConfig(corpus_tile_bytes=2000, query_tile_rows=20, broadcast_bytes=0),
                                knn.SideStats(200, 2, 2), knn.SideStats(300, 2, 2))
    assert mode == "replicate" and "Generate" not in made._jdf.queryExecution().executedPlan().toString()
    met = made.select("q_tile", "c_tile", "side").collect()
    tiles = {x.c_tile for x in met if x.side == 1}
    assert len([x for x in met if x.side == 1]) == len({(x.q_tile, x.c_tile) for x in met if x.side == 1}) == len(tiles) * len({x.q_tile for x in met if x.side == 0})


def test_the_corpus_is_copied_no_more_than_cores_and_memory_need():
    """A question tile is scored in one partition once there are two a core: further tiles would only copy the corpus (217 times at 615,384 vectors)."""
    cfg, q, c = knn.TileConfig(), 615_384, 615_384 * 248
    assert knn._replicate_plan(q, c, c, 5, 62, 600, cfg, 12)[0] == 62
    assert knn._replicate_plan(q, c, c, 5, 1, 600, cfg, 12)[0] == 24
    # few questions: a corpus of many tiles is divided among the cores, not copied
    assert knn._replicate_plan(1000, 248_000, 1 << 40, 32_768, 1, 600, cfg, 12)[0] == 1


def shuffles_only(df):
    """The plan, which must not send a whole table to the driver."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan, plan


def test_text_vectors_are_not_broadcast(spark, tmp_path):
    """Texts that repeat are a small file, whose size the planner takes for that of all their buckets."""
    path = str(tmp_path / "texts")
    rows = [(1, "red shoe"), (2, ""), (3, "red red"), (None, "lost"), (3, "shoe"), (4, None)]
    spark.createDataFrame(rows, "id long, text string").write.parquet(path)
    texts = spark.read.parquet(path)
    df = dense_counts(token_buckets(texts, "id", "text", 16), "id", 16, texts)
    shuffles_only(df)
    got = sorted((r.id or 0, int(sum(r.vec))) for r in df.collect())
    assert got == [(0, 0), (1, 2), (2, 0), (3, 3), (3, 3), (4, 0)]


def test_found_rows_are_not_broadcast(spark, tmp_path):
    """Rows found for many questions are packed well too; a product's block is still made once and reaches all of them."""
    found, catalog = str(tmp_path / "found"), str(tmp_path / "catalog")
    spark.range(3000).selectExpr("id DIV 3 AS query_id", "CAST(id % 3 + 1 AS int) AS rank", "id % 3 AS product_id").write.parquet(found)
    spark.range(50).selectExpr("id AS product_id", "concat('t', id) AS title", "CAST(1 AS float) AS price").write.parquet(catalog)
    df = blocks_of(spark.read.parquet(found), spark.read.parquet(catalog))
    shuffles_only(df)
    assert df.count() == 3000 and {r.block.split("\n")[0] for r in df.select("block").distinct().collect()} == {"Title: t0", "Title: t1", "Title: t2"}


def test_product_ids_are_not_broadcast(spark, tmp_path):
    """Every part's id, packed to next to nothing, only says which vectors have a product."""
    spark.range(40).selectExpr("id + 5 AS p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    vec = "transform(sequence(1, 64), x -> CAST(x AS float))"
    spark.range(10).selectExpr("nullif(id, 9) AS vec_id", f"{vec} AS embedding", "1 AS label").write.parquet(str(tmp_path / "embeddings.parquet"))
    df = valid_vectors(spark, str(tmp_path))
    shuffles_only(df)
    assert sorted(r.vec_id for r in df.collect()) == [5, 6, 7, 8]
