"""Vector tables: the product corpus in the spaces of every mode, and the question vectors.

Fixture adapter over ``embeddings(vec_id, embedding ARRAY<FLOAT>(64), label)``: ``product_id = vec_id``; each space
is its own slice of the embedding (``SPACE_SLICES``), so the spaces differ in content and dimension. Only vectors
with a catalog product are searchable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EMBEDDING_DIM, ENCODER_SLICES, MODE_SPACES, SPACE_SLICES
from ..functions.vector import is_valid_vector
from .tables import read_table


def pair_key(mode: str) -> str:
    """Name of the pair of vector sets that a mode searches (the group key of the tiled join)."""
    text, image = MODE_SPACES[mode]
    return f"{text}|{image or ''}"


def _slice(name: str, slices: dict[str, tuple[int, int]]) -> Column:
    first, length = slices[name]
    return F.slice("embedding", first, length)


def rejects_of(vectors: DataFrame, products: DataFrame, dim: int) -> DataFrame:
    """``product_id, reason`` of ``vectors`` (``vec_id, embedding``) that can't be searched: no or wrong length, NULL or non-finite
    elements, or no product (``products``: ``vec_id``); the first that applies."""
    ids = products.select("vec_id").distinct().withColumn("known", F.lit(True))
    size = F.coalesce(F.size("embedding") == dim, F.lit(False))
    reason = F.when(~size, "length").when(~is_valid_vector("embedding", dim), "element").when(F.col("known").isNull(), "no product")
    return vectors.join(ids, "vec_id", "left").select(F.col("vec_id").alias("product_id"), reason.alias("reason")).where("reason IS NOT NULL")


def vector_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`rejects_of` the supplied embeddings."""
    return rejects_of(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]),
                      read_table(spark, sf_dir, "part", ["p_partkey"]).select(F.col("p_partkey").alias("vec_id")), EMBEDDING_DIM)


def valid_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, embedding`` of the embeddings that :func:`vector_rejects` doesn't list."""
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    ids = read_table(spark, sf_dir, "part", ["p_partkey"]).select(F.col("p_partkey").alias("vec_id"))
    # ids in sequence are packed to next to nothing, so that millions of them look small to the planner: never broadcast
    return emb.where(is_valid_vector("embedding", EMBEDDING_DIM)).join(ids.hint("merge"), "vec_id", "left_semi")


def product_vectors(spark: SparkSession, sf_dir: str, modes: list[str] | None = None) -> DataFrame:
    """Searchable corpus ``(group_key, product_id, tv, iv)``, one row per product and pair of vector sets of ``modes``
    (all modes by default); ``iv`` is NULL in a text-only pair."""
    pairs = {}
    for mode in modes or list(MODE_SPACES):
        text, image = MODE_SPACES[mode]
        pairs[pair_key(mode)] = F.struct(
            F.lit(pair_key(mode)).alias("group_key"), _slice(text, SPACE_SLICES).alias("tv"),
            (_slice(image, SPACE_SLICES) if image else F.lit(None).cast("array<float>")).alias("iv"))
    rows = valid_vectors(spark, sf_dir).select("vec_id", F.explode(F.array(*pairs.values())).alias("p"))
    return rows.select("p.group_key", F.col("vec_id").alias("product_id"), "p.tv", "p.iv")


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter question table: every searchable product is also a question, with one vector per encoder."""
    return valid_vectors(spark, sf_dir).select(
        F.col("vec_id").alias("query_id"), *[_slice(e, ENCODER_SLICES).alias(e) for e in ("sbert", "blip", "clip")])


def corpus_stats(spark: SparkSession, sf_dir: str, modes: list[str] | None = None):
    """Upper bound of the corpus size without reading vectors: the row count of the embeddings table (Parquet
    footers) times the pairs, and the largest dimensions."""
    from ..operators.knn import SideStats

    modes = modes or list(MODE_SPACES)
    rows = read_table(spark, sf_dir, "embeddings").count()
    dims = [[SPACE_SLICES[s][1] for s in side if s] for side in zip(*[MODE_SPACES[m] for m in modes])]
    return SideStats(int(rows) * len({pair_key(m) for m in modes}), max(dims[0]), max(dims[1], default=0))
