"""Product blocks, context strings, chat message JSON and result cards."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (AGENT_ANSWER_USER_PARTS, AGENT_RECOMMENDATION_SYSTEM_MSG, AGENT_SLICING_SYSTEM_MSG, ANSWER_USER_PARTS, BLOCK_SEPARATOR, CARD_PRICE_PATTERN, CARD_RATING_PATTERN,
                      MISSING_TEXT, QUERY_SLICING_SYSTEM_MSG, RECOMMENDATION_SYSTEM_MSG,
                      SLICING_USER_PREFIX, SLICING_USER_SUFFIX)
from ..functions.text import fixed_decimals, float_repr


def _sql_escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")


def _text(df: DataFrame, name: str) -> Column:
    """A text column, '' when the column is absent or NULL."""
    if name in df.columns:
        return F.coalesce(F.col(name).cast("string"), F.lit(MISSING_TEXT))
    return F.lit(MISSING_TEXT)


def product_block(df: DataFrame) -> Column:
    """Eight-line block: Title, Description, Store, Features, Details, Price, Rating, Image.

    Numbers print as Python prints the float (the FLOAT value widened to double);
    a missing number prints 'N/A'.
    """
    price = float_repr(F.col("price")) if "price" in df.columns else F.lit("N/A")
    rating = float_repr(F.col("average_rating")) if "average_rating" in df.columns else F.lit("N/A")
    return F.concat(
        F.lit("Title: "), _text(df, "title"),
        F.lit("\nDescription: "), _text(df, "description"),
        F.lit("\nStore: "), _text(df, "store"),
        F.lit("\nFeatures: "), _text(df, "features"),
        F.lit("\nDetails: "), _text(df, "details"),
        F.lit("\nPrice: "), price,
        F.lit("\nRating: "), rating,
        F.lit("\nImage: "), _text(df, "image"),
    )


def with_blocks(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("block", product_block(ranked))


def blocks_of(ranked: DataFrame, catalog: DataFrame) -> DataFrame:
    """``ranked`` rows (``product_id``) with the ``block`` of their product, which is made once a product that occurs.

    Ranked rows in a file are packed so well that tens of millions look small to the planner: never broadcast.
    """
    wanted = catalog.join(ranked.select("product_id").distinct().hint("merge"), "product_id", "left_semi")
    return ranked.hint("merge").join(with_blocks(wanted).select("product_id", "block"), "product_id")


def assemble_context(blocks: DataFrame) -> DataFrame:
    """Per question, blocks joined in rank order with a blank line between them.

    The group is one question's top-k (k rows), so it is small by construction.
    """
    return blocks.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_products"),
        F.expr(f"listagg(block, '{_sql_escape(BLOCK_SEPARATOR)}') WITHIN GROUP (ORDER BY rank)").alias("context"),
    )


def _messages(system: str, user: Column) -> Column:
    return F.to_json(F.array(
        F.named_struct(F.lit("role"), F.lit("system"), F.lit("content"), F.lit(system)),
        F.named_struct(F.lit("role"), F.lit("user"), F.lit("content"), user),
    ))


def slicing_messages(query: Column) -> Column:
    """JSON of [system slicing message, 'Query:\\n"<question>"']."""
    return _messages(QUERY_SLICING_SYSTEM_MSG,
                     F.concat(F.lit(SLICING_USER_PREFIX), F.coalesce(query, F.lit("")), F.lit(SLICING_USER_SUFFIX)))


def answer_messages(query: Column, constraints: Column, context: Column) -> Column:
    """JSON of [system recommendation message, user message with question, filters, products]."""
    a, b, c, d = ANSWER_USER_PARTS
    user = F.concat(F.lit(a), F.coalesce(query, F.lit("")), F.lit(b), F.coalesce(constraints, F.lit("")),
                    F.lit(c), F.coalesce(context, F.lit("")), F.lit(d))
    return _messages(RECOMMENDATION_SYSTEM_MSG, user)


def _dumped(s: Column) -> Column:
    """A string as Python's ``json.dumps`` writes it: what isn't printable ASCII as \\uXXXX in lower case."""
    framed = F.to_json(F.named_struct(F.lit("x"), s))
    plain = F.substring(framed, F.lit(6), F.length(framed) - 6)  # {"x":"..."} without its frame, quotes kept

    def one(c: Column) -> Column:
        code = F.lower(F.hex(F.encode(c, "UTF-16BE")))
        esc = F.concat(F.lit("\\u"), F.substring(code, 1, 4))
        out = F.when(F.length(code) > 4, F.concat(esc, F.lit("\\u"), F.substring(code, 5, 4))).otherwise(esc)
        out = F.when(c.rlike("^[ -~]$"), c).otherwise(out)
        for sign, text in (('"', '\\"'), ("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
            out = F.when(c == sign, F.lit(text)).otherwise(out)
        return out

    spelt = F.concat(F.lit('"'), F.array_join(F.transform(F.split(s, ""), one), ""), F.lit('"'))
    return F.when(s.rlike(r"[^ -~\n\r\t]"), spelt).otherwise(plain)


def _dumped_messages(system: str, user: Column) -> Column:
    return F.concat(F.lit('[{"role": "system", "content": ' + json.dumps(system) + '}, {"role": "user", "content": '), _dumped(user),
                    F.lit("}]"))


def agent_slicing_request(query: Column) -> Column:
    """The agent's slicing messages as ``json.dumps`` text."""
    return _dumped_messages(AGENT_SLICING_SYSTEM_MSG,
                            F.concat(F.lit(SLICING_USER_PREFIX), F.coalesce(query, F.lit("")), F.lit(SLICING_USER_SUFFIX)))


def agent_answer_request(query: Column, constraints: Column, context: Column) -> Column:
    """The agent's answer messages as ``json.dumps`` text."""
    a, b, c, d = AGENT_ANSWER_USER_PARTS
    user = F.concat(F.lit(a), F.coalesce(query, F.lit("")), F.lit(b), F.coalesce(constraints, F.lit("")),
                    F.lit(c), F.coalesce(context, F.lit("")), F.lit(d))
    return _dumped_messages(AGENT_RECOMMENDATION_SYSTEM_MSG, user)


def result_card(df: DataFrame) -> Column:
    """'**title**  \\nStore: s  \\nPrice: $x.xx  \\nRating: y.y/5' (Python %.2f / %.1f)."""
    return F.concat(
        F.lit("**"), _text(df, "title"), F.lit("**  \nStore: "), _text(df, "store"),
        F.lit("  \nPrice: $"), fixed_decimals(F.col("price"), CARD_PRICE_PATTERN),
        F.lit("  \nRating: "), fixed_decimals(F.col("average_rating"), CARD_RATING_PATTERN), F.lit("/5"),
    )
