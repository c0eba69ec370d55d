"""Question, response and proposal tables derived by Spark from the supplied tables.

Nothing here is made up row by row: every table is a deterministic projection of
``part``/``embeddings``/``lineitem``, so its size grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PARITY_ALPHA, PARITY_K, PARITY_MULTIPLIER
from ..sources.tables import read_table
from ..sources.vectors import question_vectors


def parity_questions(spark: SparkSession, sf_dir: str, model_choice: str = "Clip-STrans",
                     k: int = PARITY_K, alpha: float = PARITY_ALPHA,
                     multiplier: int = PARITY_MULTIPLIER) -> DataFrame:
    """Every searchable product is a question ("more like this one") with fixed settings."""
    return question_vectors(spark, sf_dir).select(
        "query_id",
        F.lit(model_choice).alias("model_choice"),
        F.lit(k).cast("int").alias("k"),
        F.lit(alpha).cast("double").alias("alpha"),
        F.lit(multiplier).cast("int").alias("multiplier"),
        "clip", "sbert", "blip",
    )


# Modes cycled over the questions by id for the dispatch query (the last one is unknown and
# must fall back to the first mode).
MIXED_MODES = ["Clip-Clip", "Clip-STrans", "Clip-Blip", "Blip-Text", "Blip-Blip", None]
MIXED_K = [5, 10, 20, None]
MIXED_MULTIPLIER = [20, 50, None]
MIXED_ALPHA = [0.15, 0.5, 1.0, 0.0, None]
DISPATCH_MODES = ["Clip-Clip", "Clip-STrans", "Clip-Blip", "Blip-Text", "Blip-Blip"]


def mixed_mode_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same questions, each with a mode picked by ``query_id % 5`` (all rows kept)."""
    modes = F.array(*[F.lit(m) for m in DISPATCH_MODES])
    q = parity_questions(spark, sf_dir)
    idx = F.pmod(F.col("query_id"), F.lit(len(DISPATCH_MODES))).cast("int")
    return q.withColumn("model_choice", F.element_at(modes, idx + 1))


def mixed_parameter_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product question with its own settings: k 5, 10, 20 or NULL, multiplier 20, 50 or NULL, alpha 0 to 1 or
    NULL, every mode, an unknown one and NULL."""
    q = question_vectors(spark, sf_dir)

    def pick(values: list, kind: str):
        i = F.pmod(F.col("query_id"), F.lit(len(values))).cast("int") + 1
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), i)

    return q.select("query_id", pick(MIXED_MODES, "string").alias("model_choice"), pick(MIXED_K, "int").alias("k"),
                    pick(MIXED_ALPHA, "double").alias("alpha"), pick(MIXED_MULTIPLIER, "int").alias("multiplier"),
                    "clip", "sbert", "blip")


def faulty_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed questions, some with settings that can't be run."""
    q = mixed_parameter_questions(spark, sf_dir)
    i = F.col("query_id")
    return q.withColumns({
        "alpha": F.when(i % 11 == 0, F.lit(1.2)).when(i % 19 == 0, F.lit(float("nan"))).otherwise(F.col("alpha")),
        "k": F.when(i % 13 == 0, F.lit(0)).otherwise(F.col("k")),
        "multiplier": F.when(i % 17 == 0, F.lit(-1)).otherwise(F.col("multiplier")),
        "query_id": F.when(i % 23 != 0, i)})


def faulty_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplied embeddings, some of them NULL, too short, with a NULL, NaN or infinite element, or of no product."""
    i, e = F.col("vec_id"), F.col("embedding")

    def with_first(value):
        return F.concat(F.array(F.lit(value).cast("float")), F.slice(e, 2, 63))

    bad = (F.when(i % 11 == 0, F.lit(None).cast("array<float>")).when(i % 13 == 0, F.slice(e, 1, 63)).when(i % 17 == 0, with_first(None))
           .when(i % 19 == 0, with_first(float("nan"))).when(i % 23 == 0, with_first(float("-inf"))).otherwise(e))
    return read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]).select(
        F.when(i % 7 == 0, -i - 1).otherwise(i).alias("vec_id"), bad.alias("embedding"))


def question_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shopping question text per product question: ``query_id, query, constraint_text, keywords_text``.

    The constraint phrase is chosen by ``p_size % 4`` and the keyword list repeats the
    first name word so keyword clean-up has duplicates to remove.
    """
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_type", "p_size"])
    words = F.split(F.col("p_name"), " ")
    c = F.pmod(F.col("p_size"), F.lit(4))
    constraint = (
        F.when(c == 0, F.concat(F.lit("price under "), (F.lit(900) + F.col("p_size")).cast("string")))
        .when(c == 1, F.concat(F.lit("stars above 2."), F.pmod(F.col("p_size"), F.lit(10)).cast("string")))
        .when(c == 2, F.concat(F.lit("price at most $"), (F.lit(920) + F.pmod(F.col("p_size"), F.lit(30))).cast("string"),
                               F.lit(".50 and rating at least 2."), F.pmod(F.col("p_size"), F.lit(7)).cast("string")))
        .otherwise(F.lit("None"))
    )
    keywords = F.concat_ws(", ", F.element_at(words, -1), F.element_at(words, 1),
                           F.lower(F.col("p_type")), F.upper(F.element_at(words, -1)))
    query = F.concat(F.lit("I want a "), F.col("p_name"), F.lit(" ("), F.lower(F.col("p_type")), F.lit(")"),
                     F.when(c != 3, F.concat(F.lit(", "), constraint)).otherwise(F.lit("")))
    return part.select(F.col("p_partkey").alias("query_id"), query.alias("query"),
                       constraint.alias("constraint_text"), keywords.alias("keywords_text"))


def prose_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, constraints``: a constraint text per product question, its form chosen by ``p_size % 8``: ranges, suffixes, negations,
    units, none."""
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_size"])
    n = F.col("p_size")
    low, high, stars = (x.cast("string") for x in (n + 900, n + 930, F.pmod(n, F.lit(3)) + 2))
    forms = [
        F.concat(F.lit("between "), low, F.lit(" and "), high, F.lit(" dollars")),
        F.concat(stars, F.lit("+ stars")),
        F.concat(F.lit("no more than $"), high, F.lit(".50, please")),
        F.concat(F.lit("Rating not under 2."), stars),
        F.concat(stars, F.lit(" stars or more, price "), low, F.lit(" to "), high),
        F.concat(F.lit("not between "), low, F.lit(" and "), high, F.lit(" dollars")),
        F.concat(F.lit("price above "), low, F.lit(" and below "), high),
        F.lit("None"),
    ]
    text = F.element_at(F.array(*forms), F.pmod(n, F.lit(len(forms))).cast("int") + 1)
    return part.select(F.col("p_partkey").alias("query_id"), text.alias("constraints"))


def slicing_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses to the slicing prompt, one per question: ``query_id, ok, body``.

    Layout variant by ``query_id % 7``: 0 normal, 1 capitalised second label, 2 missing
    first line, 3 label in mid-line after a blank line and Unicode spaces, 4 two lines per label, 5 CRLF line
    ends, 6 failed call (``ok = false``, body is the error text).
    """
    t = question_texts(spark, sf_dir)
    v = F.pmod(F.col("query_id"), F.lit(7))
    c, k = F.col("constraint_text"), F.col("keywords_text")
    nl, crlf = F.lit("\n"), F.lit("\r\n")
    body = (
        F.when(v == 0, F.concat(F.lit("output_1: "), c, nl, F.lit("output_2: "), k))
        .when(v == 1, F.concat(F.lit("output_1: "), c, nl, F.lit("Output_2: "), k))
        .when(v == 2, F.concat(F.lit("output_2: "), k, nl))
        .when(v == 3, F.concat(F.lit("Sure. output_1: "), c, nl, nl, F.lit("  output_2:\u00a0\u3000 "), k, F.lit(" \u2003\u00a0")))
        .when(v == 4, F.concat(F.lit("output_1: "), c, nl, F.lit("output_1: None"), nl,
                               F.lit("output_2: "), k, nl, F.lit("output_2: extra")))
        .when(v == 5, F.concat(F.lit("\toutput_1: "), c, crlf, F.lit("output_2: "), k, crlf))
        .otherwise(F.concat(F.lit("Error calling model: request "), F.col("query_id").cast("string"), F.lit(" timed out")))
    )
    return t.select("query_id", "query", (v != 6).alias("ok"), body.alias("body"))
