"""Price and rating constraints from prose by a finite-state transducer over token classes.

The text is cut into numbers, words and signs; each token has a class (a map literal), and one ``aggregate`` runs the
transducer over a text's tokens in the JVM. Beyond the regular expression of :mod:`shoprank.operators.slicing` it reads

- ranges: ``between 20 and 50 dollars``, ``price 20 to 50``, ``from $20 to $50``: ``>=`` and ``<=``;
- suffixes: ``4+ stars``, ``4 stars or more``, ``50 dollars or less``, ``4 and up``;
- negation: ``no more than 50``, ``not under 3 stars``, ``never above``: the opposite comparison;
- fields by unit, after the number: ``at least 4 stars``, ``under $50``, ``below 50 usd``; and a field that holds on:
  ``price above 20 and below 50``;
- comparison signs: ``rating >= 4``.

A number without a comparison or without a field is no constraint; a negated range isn't one either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENS = r"(\$?\d+(?:\.\d+)?\+?|[a-z']+|>=|<=|[<>\-])"

#: Class of every word and sign that matters.
CLASSES = {
    **dict.fromkeys(["price", "prices", "priced", "cost", "costs", "costing"], "price"),
    **dict.fromkeys(["rating", "ratings", "rated", "star", "stars", "review", "reviews"], "rating"),
    **dict.fromkeys(["dollar", "dollars", "usd", "bucks"], "money"),
    **dict.fromkeys(["above", "over", "more", "greater", "higher", "exceeding", "beyond", ">"], ">"),
    **dict.fromkeys(["least", "minimum", "min", "starting", ">="], ">="),
    **dict.fromkeys(["under", "below", "less", "lower", "cheaper", "fewer", "<"], "<"),
    **dict.fromkeys(["most", "maximum", "max", "within", "<="], "<="),
    **dict.fromkeys(["not", "no", "never", "without", "isn't", "aren't", "don't", "shouldn't"], "not"),
    "between": "between", "and": "and", "to": "to", "-": "to", "or": "or", "up": "up",
}
OPPOSITE = {">": "<=", ">=": "<", "<": ">=", "<=": ">"}

_FOUND = "array<struct<field:string,op:string,value:double>>"


def _map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def _closed(a: Column) -> Column:
    """What has been found, with the number at hand if it has a field and a comparison."""
    def one(op: Column, value: Column) -> Column:
        return F.struct(a["number_field"].alias("field"), op.alias("op"), value.alias("value"))

    ready = a["number"].isNotNull() & a["number_field"].isNotNull() & a["number_op"].isNotNull()
    single = F.array(one(a["number_op"], a["number"]))
    both = F.array(one(F.lit(">="), a["low"]), one(F.lit("<="), a["number"]))
    new = F.when(a["number_op"] == "range", F.when(~a["range_not"], both).otherwise(F.array().cast(_FOUND))).otherwise(single)
    return F.concat(a["found"], F.when(ready, new.cast(_FOUND)).otherwise(F.array().cast(_FOUND)))


def _step(a: Column, t: Column) -> Column:
    """The state after a token ``t`` (class, number, money, plus)."""
    c = t["class"]
    null_text, null_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    has = a["number"].isNotNull()
    is_field, is_op = c.isin("price", "rating"), c.isin(">", ">=", "<", "<=")
    joins = a["last"].isin("or", "and")
    suffix = has & a["number_op"].isNull() & (a["range"] == 0) & (((a["last"] == "or") & is_op) | (joins & (c == "up")))
    first_of_range = has & (a["number_op"].isNull()) & (((a["range"] == 1) & c.isin("and", "to")) | ((a["range"] == 0) & (c == "to")))
    up_to = (c == "to") & (a["last"] == "up") & ~first_of_range
    compares = (is_op & ~suffix) | up_to
    names_unit = is_field & has & ~a["number_fresh"]
    number = c == "number"
    second = number & (a["range"] == 2)
    # a number is closed by a comparison, a negation, a range, another number or a field that isn't its unit
    closes = compares | (c == "not") | (c == "between") | (number & ~second) | (is_field & ~names_unit)
    op = F.when(up_to, F.lit("<=")).otherwise(c)
    op = F.when(a["negated"], _map(OPPOSITE)[op]).otherwise(op)
    unit = F.when(names_unit, c).when((c == "money") & has & ~a["number_fresh"], F.lit("price"))
    kept = ~closes & ~first_of_range
    return F.struct(
        F.when(is_field, c).otherwise(a["field"]).alias("field"),
        F.when(is_field, ~names_unit).when(number, F.lit(False)).otherwise(a["fresh"]).alias("fresh"),
        F.when(compares, op).when(number | (c == "between"), null_text).otherwise(a["op"]).alias("op"),
        F.when(c == "not", F.lit(True)).when(compares | (c == "between") | number, F.lit(False)).otherwise(a["negated"]).alias("negated"),
        F.when(c == "between", F.lit(1)).when(first_of_range, F.lit(2)).when(second | compares | (c == "not"), F.lit(0)).otherwise(a["range"]).alias("range"),
        F.when(c == "between", a["negated"]).when(first_of_range & (a["range"] == 0), F.lit(False)).otherwise(a["range_not"]).alias("range_not"),
        F.when(first_of_range, a["number"]).otherwise(a["low"]).alias("low"),
        F.when(number, t["number"]).when(kept, a["number"]).otherwise(null_number).alias("number"),
        F.when(number, F.when(t["money"] | (second & (a["low_money"])), F.lit("price")).otherwise(a["field"])).when(kept, F.coalesce(unit, a["number_field"])).otherwise(null_text).alias("number_field"),
        F.when(number, t["money"] | a["fresh"] | (second & a["low_fresh"])).when(unit.isNotNull(), F.lit(True)).when(kept, a["number_fresh"]).otherwise(F.lit(False)).alias("number_fresh"),
        F.when(number, F.when(second, F.lit("range")).when(a["range"] == 1, null_text).when(a["op"].isNotNull(), a["op"]).when(t["plus"], F.lit(">=")))
        .when(suffix, F.when(c.isin("<", "<="), F.lit("<=")).otherwise(F.lit(">="))).when(kept, a["number_op"]).otherwise(null_text).alias("number_op"),
        F.when(first_of_range, a["number_fresh"]).otherwise(a["low_fresh"]).alias("low_fresh"),
        F.when(first_of_range, a["number_field"].eqNullSafe("price") & a["number_fresh"]).otherwise(a["low_money"]).alias("low_money"),
        c.alias("last"),
        F.when(closes, _closed(a)).otherwise(a["found"]).alias("found"))


def _start() -> Column:
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    return F.struct(
        text.alias("field"), F.lit(False).alias("fresh"), text.alias("op"), F.lit(False).alias("negated"), F.lit(0).alias("range"), F.lit(False).alias("range_not"),
        number.alias("low"), number.alias("number"), text.alias("number_field"), F.lit(False).alias("number_fresh"), text.alias("number_op"),
        F.lit(False).alias("low_fresh"), F.lit(False).alias("low_money"), F.lit("").alias("last"), F.array().cast(_FOUND).alias("found"))


def parsed_constraints(text: Column) -> Column:
    """``ARRAY<STRUCT<field, op, value>>`` of a text's constraints, in their order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKENS), F.lit(1))

    def token(w: Column) -> Column:
        is_number = w.rlike(r"^\$?\d")
        return F.struct(
            F.when(is_number, F.lit("number")).otherwise(F.coalesce(_map(CLASSES)[w], F.lit(""))).alias("class"),
            F.when(is_number, F.regexp_replace(w, r"[$+]", "").try_cast("double")).alias("number"),
            w.startswith("$").alias("money"), (is_number & w.endswith("+")).alias("plus"))

    # words that mean nothing here are left out, so that "at least", "or even more" and "up to" need no states of their own
    tokens = F.filter(F.transform(words, token), lambda t: t["class"] != "")
    return F.aggregate(tokens, _start(), _step, _closed)


def grammar_constraints(df: DataFrame, key: str = "query_id", col: str = "constraints") -> DataFrame:
    """One row per constraint: ``key, pos, field, op, value`` (pos 1-based), as the post-filter takes them."""
    found = df.select(key, F.posexplode(parsed_constraints(F.col(col))).alias("pos0", "c"))
    return found.select(key, (F.col("pos0") + 1).cast("int").alias("pos"), "c.field", "c.op", "c.value")
