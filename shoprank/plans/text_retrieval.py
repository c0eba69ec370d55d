"""Hybrid retrieval for questions that are texts: encode and search every distinct question once.

A question is a text with its settings (mode, k, alpha, multiplier). Equal questions are reduced to one, which is
encoded by the encoders of its mode and searched in the mode's pair of vector sets; an equi-join hands the
result to all who asked. Product texts are encoded in the same way: once per distinct (encoder, text).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MODE_SPACES
from ..functions.encoders import Encoder, encode_distinct
from ..session import scratch_table
from ..sources.vectors import pair_key
from .retrieval import ENCODERS, reject_reason, resolved_mode, retrieve, route_case, with_defaults

#: What makes two questions one search.
SETTINGS = ["text", "model_choice", "k", "alpha", "multiplier"]


def text_corpus(products: DataFrame, spaces: Mapping[str, tuple[str, list[str]]], encoders: Mapping[str, Encoder],
                modes: list[str] | None = None) -> DataFrame:
    """Corpus ``(group_key, product_id, tv, iv)`` of the modes' vector sets from product texts.

    ``spaces``: the encoder and the text columns (joined by blanks) of every vector set.
    """
    spark = products.sparkSession
    modes = modes or list(MODE_SPACES)
    used = list(dict.fromkeys(s for m in modes for s in MODE_SPACES[m] if s))
    texts = F.array(*[F.struct(F.lit(s).alias("space"), F.lit(spaces[s][0]).alias("encoder"), F.concat_ws(" ", *spaces[s][1]).alias("text"))
                      for s in used])
    long = products.select("product_id", F.explode(texts).alias("t")).select("product_id", "t.*")
    vectors = encode_distinct(long, encoders.values())
    sets = long.join(vectors, ["encoder", "text"]).groupBy("product_id").agg(F.map_from_entries(F.collect_list(F.struct("space", "vec"))).alias("v"))
    pairs = [F.struct(F.lit(pair_key(m)).alias("group_key"), F.element_at("v", F.lit(MODE_SPACES[m][0])).alias("tv"),
                      (F.element_at("v", F.lit(MODE_SPACES[m][1])) if MODE_SPACES[m][1] else F.lit(None).cast("array<float>")).alias("iv"))
             for m in modes]
    out = sets.select("product_id", F.explode(F.array(*pairs)).alias("p")).select("p.group_key", "product_id", "p.tv", "p.iv")
    return scratch_table(spark, out, "text-corpus")


def distinct_questions(questions: DataFrame) -> DataFrame:
    """``rep`` (least query_id) and SETTINGS of every distinct question that can be run.

    Left out: what :func:`shoprank.plans.retrieval.question_rejects` lists, and NULL or empty texts.
    """
    q = with_defaults(questions).where(reject_reason().isNull() & (F.length("text") > 0))
    q = q.withColumns({"model_choice": resolved_mode(), "k": F.col("k").cast("int"), "alpha": F.col("alpha").cast("double"),
                       "multiplier": F.col("multiplier").cast("int")})
    return q.groupBy(*SETTINGS).agg(F.min("query_id").alias("rep"))


def encoded_questions(distinct: DataFrame, encoders: Mapping[str, Encoder]) -> DataFrame:
    """Distinct questions as :func:`shoprank.plans.retrieval.retrieve` takes them, with a vector per encoder of their mode."""
    mine = F.array_distinct(F.array(route_case(1), F.coalesce(route_case(2).cast("string"), route_case(1))))
    pairs = distinct.select("text", F.explode(mine).alias("encoder"))
    # an encoder each: three vectors a text at most
    vectors = encode_distinct(pairs, encoders.values()).groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("encoder", "vec"))).alias("v"))
    return distinct.join(vectors, "text").select(
        F.col("rep").alias("query_id"), "model_choice", "k", "alpha", "multiplier",
        *[F.try_element_at("v", F.lit(e)).alias(e) for e in ENCODERS])


def search_texts(questions: DataFrame, corpus: DataFrame, encoders: Mapping[str, Encoder], catalog: DataFrame | None = None) -> DataFrame:
    """``query_id, rank, product_id, text_sim, image_sim, score`` (and the catalog columns) of every text question.

    questions: ``query_id, text`` and, as columns or by their defaults, ``model_choice, k, alpha, multiplier``.
    """
    spark = questions.sparkSession
    for name, kind in (("model_choice", "string"), ("k", "int"), ("alpha", "double"), ("multiplier", "int")):
        if name not in questions.columns:
            questions = questions.withColumn(name, F.lit(None).cast(kind))
    asked = questions.select("query_id", *SETTINGS)
    distinct = scratch_table(spark, distinct_questions(asked), "text-questions")
    ready = scratch_table(spark, encoded_questions(distinct, encoders), "text-encoded")
    found = retrieve(ready, corpus).withColumnRenamed("query_id", "rep")
    same = with_defaults(asked).withColumns({"model_choice": resolved_mode(), "alpha": F.col("alpha").cast("double")})
    who = same.where(reject_reason().isNull()).join(distinct, SETTINGS).select("query_id", "rep")
    out = who.join(found, "rep").drop("rep")
    return out.join(catalog, "product_id") if catalog is not None else out
