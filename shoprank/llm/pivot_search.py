"""Exact top-k inner-product search by a pivot-distance index.

Vectors become integers (floor of 1024 times each component). A largest inner product is a smallest Euclidean
distance once a vector x gets one more component sqrt(M - |x|^2), M being the largest squared norm, and a query gets
0 there: |q - x|^2 = |q|^2 + M - 2 q.x. Each vector is keyed by its nearest pivot and its distance to it; a pivot's
vectors sorted by distance are cut into annuli, and an annulus into tiles of a bounded number of rows.

A query first searches the annuli whose triangle bound max(0, d - outer, inner - d) is smallest, d being its distance
to their pivot, until they hold k vectors. Its k-th best score so far then gives a radius; all annuli whose bound is
within the radius are searched next, and no others: by the triangle inequality none of them can hold a better or an
equally good vector. Bounds are taken with slack for rounding, so results are exact; scores are integers throughout.

Distribution: pivots are taken from a seeded, bounded sample of rows (``PIVOT_SAMPLE``), annulus edges from a bounded
sketch per pivot; every row is indexed. Tiles are written once under the checkpoint folder. Queries meet annuli in
blocks (``QUERY_BLOCK`` queries to a tile of ``TILE_ROWS`` rows, one matrix product); a pivot that holds a third of
all rows has many tiles and is spread over tasks. Per pair of block and tile at most k rows a query leave the task.

Wide vectors, those with a component beyond +-2**20 after scaling, whose integer products are not exact in doubles, stay out of the
index: every query is also compared with the tiles of all wide vectors, and a wide query with all tiles, their products
being summed in two halves of a component, as integers.

Vectors that are null, hold a null or a non-finite component, have another length than the most frequent one, or a
component so large that a score might not fit into 64 bits (beyond sqrt(2**62 / dimension) after scaling) take no part. Repeated vec_ids are candidates as often as they occur, but none is a
candidate of its own id; a repeated query row is one query, different vectors of one id are a query each. Null ids take no part. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, unit_hash, written

PIVOTS = 32
PIVOT_SAMPLE = 4096
ANNULI = 16
TILE_ROWS = 4096
QUERY_BLOCK = 256
SCALE = 1024
#: Largest absolute scaled component that keeps a 4096-dimensional integer product exact in doubles.
LIMIT = 1 << 20
#: Bits of the lower half of a component of a wide vector.
HALF = 14
FIRST_ANNULI = 2


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>, sq long, wide boolean) of the rows that take part."""
    v = F.col(vec_col)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("e")).where(
        F.col("vec_id").isNotNull() & F.col("e").isNotNull()
        & ~F.exists("e", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))))
    rows = rows.where(F.size("e") > 0)
    dims = rows.groupBy(F.size("e").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = dims[0].dim if dims else 1
    most = min(math.isqrt((1 << 62) // dim), (1 << 30) - 1)
    rows = rows.where((F.size("e") == dim) & ~F.exists("e", lambda x: F.abs(x.cast("double") * SCALE) > float(most)))
    rows = rows.select("vec_id", F.transform("e", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))
    rows = rows.where(~F.exists("v", lambda x: F.abs(x) > most))
    return rows.withColumns({"sq": F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x), "wide": F.exists("v", lambda x: F.abs(x) > LIMIT)})


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products [queries, rows] of integer vectors whose products fit into 64 bits."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < float(1 << 53):
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    (qh, ql), (xh, xl) = (((y.astype(np.int64) >> HALF).astype(np.float64), (y.astype(np.int64) & ((1 << HALF) - 1)).astype(np.float64)) for y in (q, x))
    mixed = (qh @ xl.T).astype(np.int64) + (ql @ xh.T).astype(np.int64)
    return ((qh @ xh.T).astype(np.int64) << (2 * HALF)) + (mixed << HALF) + (ql @ xl.T).astype(np.int64)


def _matrix(batch: pa.RecordBatch, col: str) -> np.ndarray:
    arr = batch.column(batch.schema.get_field_index(col))
    return np.asarray(arr.flatten(), np.float64).reshape(len(arr), -1)


def _pivots(vectors: DataFrame, most: int, total: int) -> np.ndarray:
    """Pivots in the widened space: farthest-first choice from a seeded sample of ``PIVOT_SAMPLE`` rows at most."""
    h = F.xxhash64(F.lit(11), "vec_id")
    # rows are thinned out by their hash first, so that each partition sends about its share of the sample only
    some = vectors.where(unit_hash(h) < min(1.0, 2 * PIVOT_SAMPLE / total))
    rows = some.orderBy(h, "vec_id").limit(PIVOT_SAMPLE).select("v", "sq").collect()
    x = np.array([r.v for r in rows], np.float64)
    x = np.concatenate([x, np.sqrt(np.maximum(0.0, most - np.array([r.sq for r in rows], np.float64)))[:, None]], 1)
    chosen = [x[0]]
    d = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(PIVOTS, len(x)) and d.max() > 0:
        chosen.append(x[int(d.argmax())])
        d = np.minimum(d, ((x - chosen[-1]) ** 2).sum(1))
    return np.array(chosen)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x ** 2).sum(1)[:, None] + (pivots ** 2).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d, 0))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of one row of scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def top_k(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k best among all rows of ``df`` with another id."""
    spark = df.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    vectors = written(spark, integer_vectors(df, id_col, vec_col), "pivot-vectors")
    narrow, wide = vectors.where("NOT wide"), vectors.where("wide")
    stats = vectors.agg(F.max(F.when(~F.col("wide"), F.col("sq"))).alias("most"), F.max(F.size("v")).alias("dim"), F.count(F.lit(1)).alias("n"),
                        F.coalesce(F.sum(F.col("wide").cast("long")), F.lit(0)).alias("n_wide")).first()
    if not stats.n:
        return spark.createDataFrame([], result)
    most = stats.most or 0
    pivots = _pivots(narrow, most, stats.n - stats.n_wide) if stats.n > stats.n_wide else np.zeros((1, stats.dim + 1))
    wide_ring = PIVOTS * ANNULI

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, "v")
            sq = np.asarray(batch.column(2), np.float64)
            d = _distances(np.concatenate([x, np.sqrt(np.maximum(0.0, most - sq))[:, None]], 1), pivots)
            p = d.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.astype("<i4").tobytes() for r in x], pa.binary()), pa.array(p.astype(np.int32)),
                 pa.array(d[np.arange(len(p)), p])], names=["vec_id", "v", "pivot", "dist"])

    keyed = written(spark, narrow.select("vec_id", "v", "sq").mapInArrow(key, "vec_id long, v binary, pivot int, dist double"), "pivot-keys")
    # annulus edges: ANNULI - 1 quantiles of each pivot's distances (a bounded sketch per pivot)
    cuts = [i / ANNULI for i in range(1, ANNULI)]
    edges = {r.pivot: np.array(r.q) for r in keyed.groupBy("pivot").agg(F.percentile_approx("dist", cuts, 1000).alias("q")).collect()}
    flat = F.create_map(*[x for p, q in sorted({-1: [], **edges}.items()) for x in (F.lit(p), F.array(*[F.lit(float(y)) for y in q]).cast("array<double>"))])
    keyed = keyed.withColumn("annulus", F.size(F.filter(flat[F.col("pivot")], lambda e: e < F.col("dist"))))
    rings = keyed.groupBy("pivot", "annulus").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    rings = rings.collect()  # PIVOTS * ANNULI rows at most
    ring_p, ring_a, ring_n = (np.array([r[i] for r in rings], np.int64) for i in range(3))
    ring_lo, ring_hi = (np.array([r[i] for r in rings], np.float64) for i in (3, 4))
    ring_ids = np.append(ring_p * ANNULI + ring_a, wide_ring).astype(np.int32)
    tiles_of = {r.pivot * ANNULI + r.annulus: -(-r.n // TILE_ROWS) for r in rings} | {wide_ring: -(-max(1, stats.n_wide) // TILE_ROWS)}
    counts = F.create_map(*[x for i, t in sorted(tiles_of.items()) for x in (F.lit(i), F.lit(t))])
    placed = keyed.select("vec_id", "v", (F.col("pivot") * ANNULI + F.col("annulus")).alias("ring"))

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [r.astype("<i4").tobytes() for r in _matrix(batch, "v")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(np.full(len(raw), wide_ring, np.int32))], names=["vec_id", "v", "ring"])

    if stats.n_wide:
        placed = placed.unionByName(wide.select("vec_id", "v").mapInArrow(as_bytes, "vec_id long, v binary, ring int"))
    # equal ids are told apart by their vectors, so that many rows of one id are many tiles too
    tile = F.pmod(F.xxhash64("vec_id", "v"), counts[F.col("ring")].cast("long")).cast("int")
    tiles = _tiles(placed.withColumn("tile", tile))
    tiles = written(spark, tiles, "pivot-tiles")
    qs = integer_vectors(queries, id_col, vec_col).where(F.size("v") == stats.dim)
    # a repeated query row is searched once; different vectors of one id are different queries
    qs = qs.select("vec_id", "v", "sq").distinct().withColumn("key", F.monotonically_increasing_id())
    qs = written(spark, qs.select("vec_id", "v", "sq", "key"), "pivot-queries")

    def visits(second: bool):
        """Annuli to search by each query; in the second round those within its radius that it has not searched."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch, "v")
                sq = np.asarray(batch.column(2), np.float64)
                everywhere = (np.abs(x) > LIMIT).any(1)
                d = _distances(np.concatenate([x, np.zeros((len(x), 1))], 1), pivots)[:, ring_p]
                bound = np.maximum(0, np.maximum(d - ring_hi, ring_lo - d))
                order = np.lexsort((np.broadcast_to(np.arange(bound.shape[1]), bound.shape), bound), axis=1)
                held = np.cumsum(ring_n[order], 1)
                # a query's own row may be among them: one more than k
                need = np.maximum((held < k + 1).sum(1) + 1, FIRST_ANNULI)
                rank = np.empty_like(order)
                np.put_along_axis(rank, order, np.broadcast_to(np.arange(bound.shape[1]), bound.shape), 1)
                go = rank < need[:, None]
                if second:
                    kth = np.asarray(batch.column(4).fill_null(-(1 << 62)), np.float64)
                    radius = np.sqrt(np.maximum(0.0, sq + most - 2 * kth))
                    go = ~go & (bound <= (radius * (1 + 1e-9) + 1e-3)[:, None])
                go[everywhere] = not second
                go = np.concatenate([go, np.full((len(go), 1), bool(stats.n_wide) and not second)], 1)
                q, r = np.nonzero(go)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(3).take(pa.array(q)), batch.column(0).take(pa.array(q)), pa.array([y.astype("<i4").tobytes() for y in x], pa.binary()).take(pa.array(q)),
                     pa.array(ring_ids[r])], names=["key", "query_id", "v", "ring"])

        return run

    def search(plan: DataFrame) -> DataFrame:
        """The k best of each query in each tile of its annuli."""
        blocks = _query_blocks(plan)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[list] = [[], [], [], []]
                for i in range(len(batch)):
                    keys, qid, qv, ids, v = (batch.column(c)[i].as_py() for c in range(5))
                    qid, ids = np.array(qid), np.array(ids)
                    s = products(np.frombuffer(qv, "<i4").reshape(len(qid), -1), np.frombuffer(v, "<i4").reshape(len(ids), -1))
                    for j, q in enumerate(qid):
                        other = np.flatnonzero(ids != q)
                        at = other[_best(s[j][other], ids[other], k)]
                        out[0] += [keys[j]] * len(at)
                        out[1] += [q] * len(at)
                        out[2] += ids[at].tolist()
                        out[3] += s[j][at].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["key", "query_id", "vec_id", "score"])

        pairs = blocks.join(tiles, "ring").select("keys", "qids", "qv", "ids", "v")
        return pairs.mapInArrow(score, "key long, query_id long, vec_id long, score long")

    ranked = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")

    def keep(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)

    first = written(spark, keep(search(qs.mapInArrow(visits(False), "key long, query_id long, v binary, ring int"))), "pivot-first")
    kth = first.where(F.col("rank") == k).select("key", F.col("score").alias("kth"))
    second = search(qs.join(kth, "key", "left").select("vec_id", "v", "sq", "key", "kth")
                    .mapInArrow(visits(True), "key long, query_id long, v binary, ring int"))
    out = keep(first.drop("rank").unionByName(second))
    return out.select("query_id", "rank", "vec_id", "score")


def _tiles(rows: DataFrame) -> DataFrame:
    """One row per (ring, tile): ids and vectors of its rows, in id order."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("vec_id", "ascending")])
        return pa.table({"ring": t["ring"].slice(0, 1), "tile": t["tile"].slice(0, 1),
                         "ids": pa.array([t["vec_id"].to_pylist()], pa.list_(pa.int64())),
                         "v": pa.array([b"".join(t["v"].to_pylist())], pa.binary())})

    return rows.select("ring", "tile", "vec_id", "v").groupBy("ring", "tile").applyInArrow(pack, "ring int, tile int, ids array<long>, v binary")


def _query_blocks(plan: DataFrame) -> DataFrame:
    """One row per ring and block of at most about QUERY_BLOCK queries."""
    sizes = plan.groupBy("ring").count().withColumn("blocks", F.ceil(F.col("count") / QUERY_BLOCK)).select("ring", "blocks")
    dealt = plan.join(sizes, "ring").withColumn("block", F.pmod(F.xxhash64(F.lit(5), "key"), F.col("blocks")).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        return pa.table({"ring": t["ring"].slice(0, 1), "keys": pa.array([t["key"].to_pylist()], pa.list_(pa.int64())),
                         "qids": pa.array([t["query_id"].to_pylist()], pa.list_(pa.int64())),
                         "qv": pa.array([b"".join(t["v"].to_pylist())], pa.binary())})

    return dealt.select("ring", "block", "key", "query_id", "v").groupBy("ring", "block").applyInArrow(
        pack, "ring int, keys array<long>, qids array<long>, qv binary")


def op7_pivot_topk(spark, sf_dir: str) -> DataFrame:
    """The 10 best other rows of every row whose vec_id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return top_k(rows, rows.where(F.col("vec_id") % 100 == 0))
