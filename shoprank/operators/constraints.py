"""Constraint post-filter, recommendation cut and recommendation guard (one join each)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MAX_RECOMMENDATIONS
from .slicing import satisfied


def post_filter(ranked: DataFrame, constraints: DataFrame) -> DataFrame:
    """Keep ranked products that violate none of their question's constraints.

    Applied *after* relevance ranking (never a pre-filter on the corpus): a question may
    keep fewer than k rows, and nothing is refilled from outside its top-k.
    ranked: ``query_id, product_id, price, average_rating, ...``;
    constraints: ``query_id, field, op, value``.
    """
    # a question has the few constraints that its text names, so one row can hold them
    per = constraints.groupBy("query_id").agg(F.collect_list(F.struct("field", "op", "value")).alias("_constraints"))
    held = ranked.join(per, "query_id", "left")
    all_met = F.forall("_constraints", lambda c: satisfied(c["field"], c["op"], c["value"]))
    return held.filter(F.col("_constraints").isNull() | all_met).drop("_constraints")


def recommend(survivors: DataFrame, limit: int = MAX_RECOMMENDATIONS) -> DataFrame:
    """At most ``limit`` products per question, in retrieval rank order (``rec_rank``)."""
    w = Window.partitionBy("query_id").orderBy(F.col("rank").asc(), F.col("product_id").asc())
    return (survivors.withColumn("rec_rank", F.row_number().over(w))
            .filter(F.col("rec_rank") <= F.lit(limit)))


def guard(proposed: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Label proposals: ``allowed`` = the product is in that question's retrieved list (one left join)."""
    keys = retrieved.select("query_id", "product_id").distinct().withColumn("_in", F.lit(True))
    return (proposed.join(keys, ["query_id", "product_id"], "left")
            .withColumn("allowed", F.coalesce("_in", F.lit(False))).drop("_in"))
