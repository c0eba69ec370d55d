"""Hybrid retrieval as one logical plan: route -> tiled kNN -> pools -> fusion -> top-k -> fetch.

``retrieve`` answers a whole *table* of questions; every question row carries its own
``k``, ``alpha``, ``model_choice`` and ``multiplier``.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..config import (DEFAULT_ALPHA, DEFAULT_K, DEFAULT_MODE, DEFAULT_MULTIPLIER, FALLBACK_MODE, MODE_CHOICES, MODE_ROUTES,
                      MODE_SPACES)
from ..operators.knn import SideStats, TileConfig, hybrid_candidates
from ..operators.rank import fuse, pools, top_k
from ..sources.vectors import pair_key

ROUTE_SCHEMA = StructType([
    StructField("route_mode", StringType(), False),
    StructField("text_encoder", StringType(), False),
    StructField("image_encoder", StringType(), True),
    StructField("text_only", BooleanType(), False),
    StructField("text_space", StringType(), False),
    StructField("image_space", StringType(), True),
])
ENCODERS = ("clip", "sbert", "blip")


def route_table(spark: SparkSession) -> DataFrame:
    """The fixed mode routes (4 rows) with the vector sets that they search."""
    rows = [(m, te, ie, to, *MODE_SPACES[m]) for (m, te, ie, to) in MODE_ROUTES]
    return spark.createDataFrame(rows, ROUTE_SCHEMA)


def resolved_mode(col: str = "model_choice"):
    """Unknown model choices fall back to the first mode (NULL: the default mode, see with_defaults)."""
    return F.when(F.col(col).isin(*MODE_CHOICES), F.col(col)).otherwise(F.lit(FALLBACK_MODE))


def with_defaults(questions: DataFrame) -> DataFrame:
    """Settings that are NULL take the application's defaults."""
    return questions.withColumns({
        "k": F.coalesce(F.col("k"), F.lit(DEFAULT_K)), "alpha": F.coalesce(F.col("alpha"), F.lit(DEFAULT_ALPHA)),
        "model_choice": F.coalesce(F.col("model_choice"), F.lit(DEFAULT_MODE)),
        "multiplier": F.coalesce(F.col("multiplier"), F.lit(DEFAULT_MULTIPLIER))})


def reject_reason():
    """Why a question (with defaults) can't be run, NULL if it can: no id, ``k`` or ``multiplier`` below 1, ``alpha``
    outside [0, 1]."""
    return (F.when(F.col("query_id").isNull(), "query_id").when(F.col("k") < 1, "k").when(F.col("multiplier") < 1, "multiplier")
            .when(F.isnan(F.col("alpha").cast("double")) | (F.col("alpha") < 0.0) | (F.col("alpha") > 1.0), "alpha"))


def question_rejects(questions: DataFrame) -> DataFrame:
    """``query_id, reason`` of the questions that :func:`route_questions` leaves out."""
    return with_defaults(questions).select("query_id", reject_reason().alias("reason")).where("reason IS NOT NULL")


def largest_k(questions: DataFrame) -> int:
    """The largest k in a table of questions (reads that column only)."""
    return max(1, int(questions.agg(F.max(F.coalesce(F.col("k"), F.lit(DEFAULT_K))).alias("k")).first()["k"] or 1))


def route_case(field: int):
    """CASE over the fixed mode routes (no join: the routes are constants)."""
    mode = resolved_mode()
    expr = None
    for route in MODE_ROUTES:
        val = F.lit(route[field])
        expr = F.when(mode == route[0], val) if expr is None else expr.when(mode == route[0], val)
    return expr


def route_questions(questions: DataFrame) -> DataFrame:
    """Attach the route and the probe vectors; compute per-question pool sizes.

    questions: ``query_id, model_choice, k, alpha, multiplier`` + one vector column per
    encoder (``clip``, ``sbert``, ``blip``).
    """
    q = with_defaults(questions).filter(reject_reason().isNull()).select(
        "*", resolved_mode().alias("route_mode"), route_case(1).alias("text_encoder"),
        route_case(2).cast("string").alias("image_encoder"), route_case(3).alias("text_only"))

    def probe(enc_col: str):
        expr = F.lit(None).cast("array<float>")
        for enc in ENCODERS:
            if enc in questions.columns:
                expr = F.when(F.col(enc_col) == enc, F.col(enc)).otherwise(expr)
        return expr

    pool = (F.col("k") * F.col("multiplier")).cast("int")
    keys = F.create_map(*[x for m in MODE_SPACES for x in (F.lit(m), F.lit(pair_key(m)))])
    return q.select(
        "query_id", "route_mode", F.col("k").cast("int").alias("k"), F.col("alpha").cast("double").alias("alpha"),
        "text_only", F.element_at(keys, F.col("route_mode")).alias("group_key"),
        F.when(F.col("text_only"), F.col("k")).otherwise(pool).cast("int").alias("n_text"),
        F.when(F.col("text_only"), F.lit(0)).otherwise(pool).cast("int").alias("n_image"),
        probe("text_encoder").alias("qt"),
        F.when(F.col("text_only"), F.lit(None).cast("array<float>")).otherwise(probe("image_encoder")).alias("qi"),
    )


def question_stats(routed: DataFrame) -> tuple[SideStats, int, int]:
    """Count and dimensions, the largest ``k`` and the mean candidate pool, in one small aggregate."""
    row = routed.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("qt")).alias("dt"),
                     F.max(F.size("qi")).alias("di"), F.max("k").alias("k"),
                     F.ceil(F.avg(F.col("n_text") + F.col("n_image"))).alias("pool")).first()
    stats = SideStats(int(row["rows"] or 0), max(int(row["dt"] or 0), 0), max(int(row["di"] or 0), 0))
    return stats, max(int(row["k"] or 1), 1), max(int(row["pool"] or 1), 1)


def candidate_pools(routed: DataFrame, corpus: DataFrame, cfg: TileConfig | None = None,
                    qstats: SideStats | None = None, cstats: SideStats | None = None) -> DataFrame:
    """Union of both pools per question with both exact similarities."""
    return pools(hybrid_candidates(routed, corpus, cfg, qstats=qstats, cstats=cstats))


def retrieve(questions: DataFrame, corpus: DataFrame, catalog: DataFrame | None = None,
             cfg: TileConfig | None = None, keep: tuple[str, ...] = (),
             cstats: SideStats | None = None) -> DataFrame:
    """Whole hybrid retrieval (R1-R11 + S4) for a table of questions.

    The questions' number, largest k and largest pool are measured by one small aggregate over them; ``cstats`` (upper
    bound of the corpus rows, dimensions) may be given when known. ``corpus``: vectors, or their packed tiles.
    Returns ``query_id, rank, product_id, text_sim, image_sim, score`` (+ ``keep`` columns
    of the pool) and the catalog columns when ``catalog`` is given.
    """
    routed = route_questions(questions)
    qstats, k_max, pool_rows = question_stats(routed)
    pool = candidate_pools(routed, corpus, replace(cfg or TileConfig(), pool_hint=pool_rows), qstats, cstats)
    ranked = top_k(fuse(pool), k_max).select(
        "query_id", "rank", "product_id", "text_sim", "image_sim", "score", *keep)
    if catalog is not None:
        ranked = ranked.join(catalog, "product_id", "inner")
    return ranked
