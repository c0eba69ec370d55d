"""True fused top k, certified from the two ranked pools.

The application fuses only what its two pools hold. A row outside both pools of a question scores at most
``alpha * t + (1 - alpha) * i``, t and i being the least similarities of the pools (the threshold algorithm's bound, for
pools that are not the whole corpus). If the k-th fused score of the pool is greater than that, the pool's top k is the true one. The
other questions, and only these, are searched again by the fused score itself, which is one product of vectors that hold both
spaces: k rows a question are kept, whatever pools would have been needed to certify it.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.knn import SideStats, TileConfig, hybrid_candidates, packed_stats, side_stats
from ..operators.rank import fuse, ranked, top_k
from ..session import scratch_table
from .retrieval import candidate_pools, question_stats, route_questions

#: What rounding of similarities may add to a bound.
SLACK = 1e-9


def bounded(pool: DataFrame) -> DataFrame:
    """``pool`` (of :func:`candidate_pools`) with ``score``, ``rank`` and ``unseen``: the most that a row outside can score.

    A pool with fewer rows than asked for holds the whole corpus: nothing is unseen (NULL).
    """
    from pyspark.sql import Window

    q = Window.partitionBy("query_id")
    least_t = F.min(F.when(F.col("text_rank").isNotNull(), F.col("text_sim"))).over(q)
    least_i = F.min(F.when(F.col("image_rank").isNotNull(), F.col("image_sim"))).over(q)
    whole = (F.count("text_rank").over(q) < F.col("n_text")) | ((F.col("n_image") > 0) & (F.count("image_rank").over(q) < F.col("n_image")))
    unseen = F.when(F.col("n_image") == 0, least_t).otherwise(F.col("alpha") * least_t + (F.lit(1.0) - F.col("alpha")) * least_i)
    return ranked(fuse(pool)).withColumn("unseen", F.when(~whole, unseen))


def _certain(top: DataFrame) -> DataFrame:
    """(query_id, certain): whether the k-th score of each question is beyond what a row outside can reach.

    Text-only questions take their k best by the one similarity that counts, which is the true top k.
    """
    per = top.groupBy("query_id").agg(F.min("score").alias("kth"), F.max("unseen").alias("unseen"), F.count(F.lit(1)).alias("n"), F.max("k").alias("k"),
                                      F.max("n_image").alias("n_image"))
    sure = F.col("unseen").isNull() | (F.col("n_image") == 0) | ((F.col("n") >= F.col("k")) & (F.col("kth") > F.col("unseen") + SLACK))
    return per.select("query_id", sure.alias("certain"))


def certified_topk(questions: DataFrame, corpus: DataFrame, cfg: TileConfig | None = None, growth: int = 4, cstats: SideStats | None = None) -> DataFrame:
    """``query_id, rank, product_id, text_sim, image_sim, score, rounds, pool_is_exact`` of the true fused top k.

    rounds: searches that the question took, two at most. pool_is_exact: whether the first pools (k * multiplier) had given the same rows.
    Both rounds are written, so that a lost executor repeats no search. growth: not used any more, as pools are not enlarged.
    """
    spark = questions.sparkSession
    cfg = cfg or TileConfig()
    routed = scratch_table(spark, route_questions(questions), "certified-routed")
    cstats = cstats or (packed_stats(corpus) if "mat_t" in corpus.columns else side_stats(corpus, "tv", "iv"))
    columns = ["query_id", "rank", "product_id", "text_sim", "image_sim", "score"]
    first = done = None
    qstats, _, pool_rows = question_stats(routed)
    if qstats.rows:
        pool = candidate_pools(routed, corpus, replace(cfg, pool_hint=pool_rows), qstats, cstats)
        first = scratch_table(spark, bounded(pool).where(F.col("rank") <= F.col("k")).select(*columns, "unseen", "k", "n_image"), "certified-pools")
        sure = scratch_table(spark, _certain(first), "certain")
        done = first.join(sure.where("certain"), "query_id", "left_semi").select(*columns, F.lit(1).alias("rounds"))
        # questions without any row (an empty corpus) are not searched again
        left = scratch_table(spark, routed.join(sure.where("NOT certain"), "query_id", "left_semi").withColumn("n_text", F.col("k")), "certified-left")
        qstats, k_max, _ = question_stats(left)
        if qstats.rows:
            # one score a question: no more than k rows of it leave a task
            found = hybrid_candidates(left, corpus, replace(cfg, pool_hint=k_max), qstats, cstats, fused=True)
            second = scratch_table(spark, top_k(fuse(found), k_max).select(*columns), "certified-fused")
            done = done.unionByName(second.withColumn("rounds", F.lit(2)))
    if done is None:
        return spark.createDataFrame([], "query_id long, rank int, product_id long, text_sim double, image_sim double, score double, rounds int, pool_is_exact boolean")
    old = first.select("query_id", "rank", F.col("product_id").alias("was"))
    same = done.join(old, ["query_id", "rank"], "left").groupBy("query_id").agg(
        F.bool_and(F.coalesce(F.col("was") == F.col("product_id"), F.lit(False))).alias("pool_is_exact"))
    return done.join(same, "query_id").select("query_id", "rank", "product_id", "text_sim", "image_sim", "score", "rounds", "pool_is_exact")
