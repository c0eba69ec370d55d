"""Approximate nearest-neighbour search by cells (an inverted file over k-means centroids).

The corpus is written once, partitioned by cell: each vector goes to the cell of its nearest centroid. A question is
compared with the vectors of its ``nprobe`` nearest cells only; these cosines are exact. The exact search
of :mod:`shoprank.operators.knn` stays the default; this one is for corpora where it is too slow.

Centroids are fitted on a bounded sample (``sample_rows`` vectors, least hash first) on the driver and are sent to all
tasks (``cells`` x dimension numbers). Every vector is indexed. How many cells must be probed for a recall is measured
by :func:`calibrated_probes` on a bounded sample of questions against the exact answer.

Unit vectors are compared, so the nearest centroid is the one of greatest cosine; zero vectors are in the cell whose
number is least, and score 0 as in the exact search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .knn import _exact_cos, _rank_keep, _seq_norms, _top_candidates

#: Rows of a cell's file part, and questions that a task compares with it at once.
CELL_ROWS = 50_000
PROBE_ROWS = 4096
#: Most bytes of packed questions that are broadcast.
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class CellIndex:
    """``path``: Parquet of packed vectors, partitioned by cell; ``centroids``: [cells, dim], unit length; ``rows``: all vectors."""

    path: str
    centroids: np.ndarray
    rows: int

    def table(self, spark: SparkSession) -> DataFrame:
        """``cell, part, pids ARRAY<BIGINT>, mat BINARY`` (float32): a row per part of a cell."""
        return spark.read.schema("part int, pids array<long>, mat binary, cell int").parquet(self.path)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def fit_centroids(vectors: np.ndarray, cells: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Spherical k-means; empty cells are put at the vectors that fit worst. Fewer distinct vectors give fewer cells."""
    x = np.unique(_unit(np.asarray(vectors, np.float64)), axis=0)
    cells = min(cells, len(x))
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), cells, replace=False)] if cells else x
    for _ in range(rounds if cells else 0):
        sims = x @ centre.T
        own = sims.argmax(1)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        sums[empty] = x[np.argsort(sims.max(1), kind="stable")[:len(empty)]]
        centre = _unit(sums)
    return centre


def build_cells(corpus: DataFrame, cells: int | None = None, sample_rows: int = 65_536, id_col: str = "product_id", vec_col: str = "vec") -> CellIndex:
    """Index of all rows of ``corpus`` (``product_id, vec``; vectors of one dimension without NULLs). ``cells``: about sqrt(rows) by default, 4096 at most."""
    spark = corpus.sparkSession
    rows = corpus.select(F.col(id_col).cast("long").alias("product_id"), F.col(vec_col).cast("array<float>").alias("vec"))
    n = rows.count()
    cells = cells or max(1, min(4096, math.isqrt(max(1, n))))
    h = F.xxhash64("product_id")
    # thinned by hash before the ordered cut, so that tasks send about their share of it
    thin = rows.where(F.pmod(h, F.lit(1 << 20)) < max(1, min(1 << 20, math.ceil((1 << 20) * 2.0 * sample_rows / max(1, n)))))
    sample = thin.orderBy(h, "product_id").limit(sample_rows).select("vec").toPandas()["vec"]
    centroids = fit_centroids(np.stack(sample.to_list()) if len(sample) else np.zeros((0, 1)), cells)
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CELL_ROWS // 8):
                part = batch.slice(at, CELL_ROWS // 8)
                cell = (_unit(_matrix(part.column(1))) @ shared.value.T).argmax(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell)], names=["product_id", "vec", "cell"])

    placed = rows.mapInArrow(assign, "product_id long, vec array<float>, cell int")
    # a cell is cut into parts of about CELL_ROWS rows, so that a crowded cell is no single file or task
    parts = max(1, math.ceil(n / max(1, len(centroids)) * 4 / CELL_ROWS))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("product_id", F.lit(3)), F.lit(parts)).cast("int"))
    path = scratch_path(spark, "cells")
    packed = placed.groupBy("cell", "part").applyInArrow(_packed_cell, "part int, pids array<long>, mat binary, cell int")
    packed.write.partitionBy("cell").parquet(path)
    return CellIndex(path, centroids, n)


def search_cells(questions: DataFrame, index: CellIndex, nprobe: int) -> DataFrame:
    """``query_id, product_id, rank, sim``: each question's ``n`` best of the ``nprobe`` cells nearest to it.

    questions: ``query_id, vec, n``. The questions of a cell, packed, meet the stored parts of the cell in an equi-join on the cell.
    Packed questions of BROADCAST_BYTES at most (count x width is checked) are broadcast, so that the index is read where it
    lies, cells that no question probes being pruned; beyond it both sides are shuffled. Every pair keeps n rows a
    question, a final window ranks them.
    """
    from pyspark.sql import Window

    spark = questions.sparkSession
    if not index.rows:
        return spark.createDataFrame([], "query_id long, product_id long, rank int, sim double")
    shared = spark.sparkContext.broadcast(index.centroids)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sims = _unit(_matrix(part.column(2))) @ shared.value.T
                k = min(nprobe, sims.shape[1])
                near = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.tile(np.arange(k), (len(sims), 1))
                take = pa.array(np.repeat(np.arange(len(sims)), k))
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in part.columns), pa.array(near.ravel().astype(np.int32))],
                                                 names=["query_id", "n", "vec", "cell"])

    rows = questions.select("query_id", F.col("n").cast("int").alias("n"), "vec")
    size = rows.agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    probes = rows.mapInArrow(probe, "query_id long, n int, vec array<float>, cell int")
    probes = probes.withColumn("tile", F.pmod(F.xxhash64("query_id"), F.lit(max(1, math.ceil(size.rows / PROBE_ROWS)))).cast("int"))
    tiles = probes.groupBy("cell", "tile").applyInArrow(_packed_questions, "cell int, tile int, ids array<long>, ns array<int>, dim int, vecs binary")
    tiles = tiles.where("cell >= 0")  # Spark prunes the other side's partitions only if this side has a filter
    small = size.rows * nprobe * (16 + 4 * (size.dim or 0)) <= BROADCAST_BYTES
    pairs = index.table(spark).join(F.broadcast(tiles) if small else tiles, "cell")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                dim = c["dim"][r].as_py()
                q = np.frombuffer(c["vecs"][r].as_py(), "<f4").reshape(-1, dim).astype(np.float64)
                m = np.frombuffer(c["mat"][r].as_py(), "<f4").reshape(-1, dim).astype(np.float64)
                ids, ns, pids = (np.asarray(c[x][r].values) for x in ("ids", "ns", "pids"))
                qn, mn = _seq_norms(q), _seq_norms(m)
                for at in range(0, len(q), max(1, 4_000_000 // len(m))):
                    z = slice(at, at + max(1, 4_000_000 // len(m)))
                    den = np.outer(qn[z], mn)
                    sims = np.divide(q[z] @ m.T, den, out=np.zeros_like(den), where=den != 0)
                    i, j = _top_candidates(sims, ns[z])
                    sim = _exact_cos(q[z][i], m[j], qn[z][i], mn[j])
                    keep = _rank_keep(i, pids[j], sim, ns[z])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[z][i[keep]]), pa.array(ns[z][i[keep]]), pa.array(pids[j[keep]]), pa.array(sim[keep])],
                                                     names=["query_id", "n", "product_id", "sim"])

    found = pairs.mapInArrow(score, "query_id long, n int, product_id long, sim double")
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "product_id")
    most = int(size.n or 1)
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).where(F.col("rank") <= F.col("n"))
    return ranked.select("query_id", "product_id", "rank", "sim")


def _packed_questions(t: pa.Table) -> pa.Table:
    m = _matrix(t.column("vec").combine_chunks())
    return pa.table({"cell": t["cell"].slice(0, 1), "tile": t["tile"].slice(0, 1), "ids": [t["query_id"].to_pylist()], "ns": [t["n"].to_pylist()],
                     "dim": pa.array([m.shape[1]], pa.int32()), "vecs": [m.astype("<f4").tobytes()]},
                    schema=pa.schema([("cell", pa.int32()), ("tile", pa.int32()), ("ids", pa.list_(pa.int64())), ("ns", pa.list_(pa.int32())),
                                      ("dim", pa.int32()), ("vecs", pa.binary())]))


def _packed_cell(t: pa.Table) -> pa.Table:
    m = _matrix(t.column("vec").combine_chunks())
    return pa.table({"part": t["part"].slice(0, 1), "pids": [t["product_id"].to_pylist()], "mat": [m.astype("<f4").tobytes()], "cell": t["cell"].slice(0, 1)},
                    schema=pa.schema([("part", pa.int32()), ("pids", pa.list_(pa.int64())), ("mat", pa.binary()), ("cell", pa.int32())]))


def calibrated_probes(questions: DataFrame, index: CellIndex, exact: DataFrame, target: float = 0.95) -> int:
    """The least number of cells (doubling, then halving the gap) with which ``questions`` (a bounded sample) find ``target`` of
    the rows of ``exact`` (``query_id, product_id``)."""
    want = exact.select("query_id", "product_id")
    total = want.count()

    def recall(nprobe: int) -> float:
        return search_cells(questions, index, nprobe).join(want, ["query_id", "product_id"], "left_semi").count() / max(1, total)

    low, high, most = 0, 1, max(1, len(index.centroids))
    while high < most and recall(high) < target:
        low, high = high, min(most, high * 2)
    while high - low > max(1, high // 8):
        mid = (low + high) // 2
        low, high = (low, mid) if recall(mid) >= target else (mid, high)
    return high
