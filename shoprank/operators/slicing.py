"""Question slicing: parse model responses into (constraints, keywords); keyword clean-up;
constraint grammar -> typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONSTRAINTS_LABEL, KEYWORDS_LABEL
from ..functions.text import first_labelled_value, normalize_keywords

# Constraint grammar (our rule set for the prose constraints the slicer returns).
# Fields: price; rating with its synonyms star(s), rating(s), review(s).
# Operators: above|over|more than -> '>', at least -> '>=', under|below|less than -> '<',
# at most|up to -> '<='. Optional '$', decimal value.
CONSTRAINT_PATTERN = (
    r"(price|stars?|ratings?|reviews?)\s+"
    r"(above|over|more than|at least|under|below|less than|at most|up to)\s+"
    r"\$?(\d+(?:\.\d+)?)"
)
OP_MAP = {
    "above": ">", "over": ">", "more than": ">", "at least": ">=",
    "under": "<", "below": "<", "less than": "<", "at most": "<=", "up to": "<=",
}


def parse_slices(responses: DataFrame, body: str = "body", ok: str = "ok", parity: bool = True) -> DataFrame:
    """Add ``constraints`` and ``keywords``; failed calls (``ok = false``) stay NULL.

    parity=True keeps the original's quirk that a capitalised label is not removed.
    """
    good = F.coalesce(F.col(ok), F.lit(False))
    return responses.select(
        "*",
        F.when(good, first_labelled_value(body, CONSTRAINTS_LABEL, parity)).alias("constraints"),
        F.when(good, first_labelled_value(body, KEYWORDS_LABEL, parity)).alias("keywords"),
    )


def clean_keywords(df: DataFrame, col: str = "keywords", out: str = "keywords_norm") -> DataFrame:
    """Lower-case, comma-separated, de-duplicated keywords (first occurrence kept)."""
    return df.withColumn(out, normalize_keywords(col))


def _field(name):
    return F.when(name == "price", F.lit("price")).otherwise(F.lit("rating"))


def _op(name):
    expr = None
    for word, sym in OP_MAP.items():
        expr = F.when(name == word, F.lit(sym)) if expr is None else expr.when(name == word, F.lit(sym))
    return expr


def extract_constraints(df: DataFrame, key: str = "query_id", col: str = "constraints") -> DataFrame:
    """One row per constraint found: ``key, pos, field, op, value DOUBLE`` (pos 1-based)."""
    text = F.lower(F.coalesce(F.col(col), F.lit("")))
    pat = F.lit(CONSTRAINT_PATTERN)
    z = df.select(
        key,
        F.arrays_zip(
            F.regexp_extract_all(text, pat, 1).alias("f"),
            F.regexp_extract_all(text, pat, 2).alias("o"),
            F.regexp_extract_all(text, pat, 3).alias("v"),
        ).alias("z"),
    )
    e = z.select(key, F.posexplode("z").alias("pos0", "c"))
    return e.select(
        key, (F.col("pos0") + 1).cast("int").alias("pos"), _field(F.col("c.f")).alias("field"),
        _op(F.col("c.o")).alias("op"), F.col("c.v").cast("double").alias("value"))


def satisfied(field, op, value, price="price", rating="average_rating"):
    """TRUE when the product meets the constraint; a NULL or NaN price/rating never meets one."""
    x = F.when(field == "price", F.col(price).cast("double")).otherwise(F.col(rating).cast("double"))
    ok = (F.when(op == ">", x > value).when(op == ">=", x >= value)
          .when(op == "<", x < value).when(op == "<=", x <= value))
    return F.coalesce(ok & ~F.isnan(x), F.lit(False))
