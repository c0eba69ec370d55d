"""Stored vector sets and catalog: written once, read by every query, joined by product without a shuffle.

``vectors``: ``product_id, embedding ARRAY<FLOAT>, norm DOUBLE, space``, partitioned by ``space`` and bucketed by
``product_id``. ``catalog``: the typed catalog, bucketed likewise. A query reads the partitions of the spaces that its
questions' modes name (dynamic partition pruning); the vectors of a product, and the products that were
found, meet bucket by bucket.

Both are tables of the session's catalog over files in the shared folder (or ``path``). The dimension of a space is checked
when it is written: one vector of another length fails the write.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MODE_SPACES, SPACE_SLICES
from ..functions.vector import l2_norm
from ..session import scratch_path
from .vectors import pair_key, valid_vectors


@dataclass(frozen=True)
class Store:
    """Names of the tables, buckets and the dimension of every space."""

    vectors: str
    catalog: str | None
    buckets: int
    dims: dict[str, int] = field(default_factory=dict)
    rows: int = 0


def space_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture adapter at ingest: ``space, product_id, embedding`` of all vector sets from the supplied embeddings."""
    sets = F.array(*[F.struct(F.lit(name).alias("space"), F.slice("embedding", *at).alias("embedding")) for name, at in SPACE_SLICES.items()])
    rows = valid_vectors(spark, sf_dir).select(F.col("vec_id").alias("product_id"), F.explode(sets).alias("s"))
    return rows.select("s.space", "product_id", "s.embedding")


def write_store(vectors: DataFrame, catalog: DataFrame | None = None, buckets: int = 16, path: str | None = None) -> Store:
    """Writes ``vectors`` (``space, product_id, embedding``) and ``catalog``; rows with a NULL product, space or vector are not stored.

    ``buckets``: about one per 200,000 products is a good number; all tables that are joined share it.
    """
    spark = vectors.sparkSession
    path, suffix = path or scratch_path(spark, "store"), uuid.uuid4().hex[:12]
    rows = vectors.where("space IS NOT NULL AND product_id IS NOT NULL AND embedding IS NOT NULL").select(
        F.col("product_id").cast("long").alias("product_id"), F.col("embedding").cast("array<float>").alias("embedding"),
        l2_norm("embedding").alias("norm"), "space")
    name = f"shoprank_vectors_{suffix}"
    rows.repartition(buckets, "product_id").write.partitionBy("space").bucketBy(buckets, "product_id").sortBy("product_id") \
        .option("path", f"{path}/vectors").saveAsTable(name)
    sizes = spark.table(name).groupBy("space").agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("dim"), F.count(F.lit(1)).alias("n"))
    sizes = {r.space: r for r in sizes.collect()}  # a row a space
    uneven = sorted(s for s, r in sizes.items() if r.low != r.dim)
    if uneven:
        spark.sql(f"DROP TABLE {name}")
        raise ValueError(f"vectors of different length in the spaces {uneven}")
    listed = None
    if catalog is not None:
        listed = f"shoprank_catalog_{suffix}"
        catalog.repartition(buckets, "product_id").write.bucketBy(buckets, "product_id").sortBy("product_id").option("path", f"{path}/catalog").saveAsTable(listed)
    return Store(name, listed, buckets, {s: r.dim for s, r in sizes.items()}, max((r.n for r in sizes.values()), default=0))


def used_spaces(questions: DataFrame) -> DataFrame:
    """``space``: the vector sets that the modes of ``questions`` (``route_mode``) name; five rows at most."""
    sets = F.create_map(*[x for m, pair in MODE_SPACES.items() for x in (F.lit(m), F.array(*[F.lit(s) for s in pair if s]))])
    return questions.where(F.col("route_mode").isNotNull()).select(F.explode(F.element_at(sets, F.col("route_mode"))).alias("space")).distinct()


def stored_corpus(spark: SparkSession, store: Store, questions: DataFrame | None = None, modes: list[str] | None = None) -> DataFrame:
    """Corpus ``(group_key, product_id, tv, iv)`` of ``modes``; with ``questions`` (``route_mode``) only the spaces they use are read.

    One scan; the vectors of a product lie in one bucket, so that grouping them (one per space) moves no row.
    """
    modes = modes or list(MODE_SPACES)
    rows = spark.table(store.vectors)
    if questions is not None:
        # at most a row per space of MODE_SPACES; Spark prunes the partitions by them
        rows = rows.join(F.broadcast(used_spaces(questions)), "space", "left_semi")
    else:
        rows = rows.where(F.col("space").isin(*dict.fromkeys(s for m in modes for s in MODE_SPACES[m] if s)))
    sets = rows.groupBy("product_id").agg(F.map_from_entries(F.collect_list(F.struct("space", "embedding"))).alias("v"))

    def pair(mode: str):
        text, image = MODE_SPACES[mode]
        tv = F.try_element_at("v", F.lit(text))
        iv = F.try_element_at("v", F.lit(image)) if image else F.lit(None).cast("array<float>")
        both = tv.isNotNull() & iv.isNotNull() if image else tv.isNotNull()
        return F.when(both, F.struct(F.lit(pair_key(mode)).alias("group_key"), tv.alias("tv"), iv.alias("iv")))

    pairs = F.filter(F.array(*[pair(m) for m in modes]), lambda p: p.isNotNull())
    return sets.select("product_id", F.explode(pairs).alias("p")).select("p.group_key", "product_id", "p.tv", "p.iv")


def stored_catalog(spark: SparkSession, store: Store) -> DataFrame:
    return spark.table(store.catalog)


def store_stats(store: Store, modes: list[str] | None = None):
    """Upper bound of the corpus' rows and its dimensions, as known since the write."""
    from ..operators.knn import SideStats

    pairs = [MODE_SPACES[m] for m in modes or list(MODE_SPACES)]
    return SideStats(store.rows * len(pairs), max((store.dims.get(t, 0) for t, _ in pairs), default=0), max((store.dims.get(i, 0) for _, i in pairs if i), default=0))


def drop_store(spark: SparkSession, store: Store) -> None:
    """Forget the tables (the files stay where they were written)."""
    for name in (store.vectors, store.catalog):
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
