"""Global pools, candidate union, fused score and per-question top-k.

All steps partition by ``query_id`` only, so after the single exchange that follows the
tile stage the pool windows, the fusion and the top-k window run without another shuffle.
Per-question sizes (``n = k * multiplier``, ``k``) vary by row; the top-k window is
filtered by a literal bound first so Catalyst can use ``WindowGroupLimit``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pools(cands: DataFrame) -> DataFrame:
    """Union of the global top-``n_text`` by text and top-``n_image`` by image per question.

    cands: ``query_id, product_id, text_sim, image_sim, n_text, n_image, k, alpha``.
    Adds ``text_rank`` / ``image_rank`` (NULL = not in that pool). Each (question, product)
    pair occurs once in the input, so the union needs no de-duplication.
    """
    wt = Window.partitionBy("query_id").orderBy(F.col("text_sim").desc(), F.col("product_id").asc())
    wi = Window.partitionBy("query_id").orderBy(F.col("image_sim").desc_nulls_last(), F.col("product_id").asc())
    r = cands.withColumn("text_rank", F.row_number().over(wt)).withColumn("image_rank", F.row_number().over(wi))
    in_t = F.col("text_rank") <= F.col("n_text")
    in_i = F.col("image_sim").isNotNull() & (F.col("image_rank") <= F.col("n_image"))
    return r.filter(in_t | in_i).select(
        "query_id", "product_id", "text_sim", "image_sim", "n_text", "n_image", "k", "alpha",
        F.when(in_t, F.col("text_rank")).alias("text_rank"),
        F.when(in_i, F.col("image_rank")).alias("image_rank"),
    )


def fuse(pool: DataFrame) -> DataFrame:
    """``score = alpha * text_sim + (1 - alpha) * image_sim``; text-only questions
    (``n_image = 0``) score by ``text_sim``."""
    score = F.when(F.col("n_image") == 0, F.col("text_sim")).otherwise(
        F.col("alpha") * F.col("text_sim") + (F.lit(1.0) - F.col("alpha")) * F.col("image_sim"))
    return pool.withColumn("score", score.cast("double"))


def ranked(scored: DataFrame, by: str = "score", partition: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Add ``rank``: by ``by`` desc, ``product_id`` asc."""
    w = Window.partitionBy(*partition).orderBy(F.col(by).desc(), F.col("product_id").asc())
    return scored.withColumn("rank", F.row_number().over(w))


def top_k(scored: DataFrame, k_max: int | None = None, by: str = "score", k_col: str = "k",
          partition: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Keep ``rank <= k`` of the question. ``k_max``: the largest k in the data, an optimiser bound that lets Catalyst
    cut each partition before the exchange; a question with a larger k fails the job instead of losing rows."""
    out = ranked(scored, by, partition)
    if k_max is not None:
        fits = F.when(F.col(k_col) > k_max, F.raise_error(F.lit(f"k is larger than k_max={k_max}")).cast("int")).otherwise(F.col(k_col))
        out = out.filter(F.col("rank") <= F.lit(k_max)).withColumn(k_col, fits)
    return out.filter(F.col("rank") <= F.col(k_col))
