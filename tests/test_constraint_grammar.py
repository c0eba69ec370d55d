"""The constraint transducer: forms, negation, units, and agreement with the regular expression on its own forms."""

import pytest

from shoprank.operators.constraint_grammar import grammar_constraints
from shoprank.operators.slicing import extract_constraints

P, R = "price", "rating"
FORMS = {
    "price under 50": [(P, "<", 50)],
    "stars above 4 and price at most $19.99": [(R, ">", 4), (P, "<=", 19.99)],
    "price over 30 and price below 20": [(P, ">", 30), (P, "<", 20)],
    "rating at least 4.5, reviews more than 3": [(R, ">=", 4.5), (R, ">", 3)],
    "price up to 20": [(P, "<=", 20)],
    "between 20 and 50 dollars": [(P, ">=", 20), (P, "<=", 50)],
    "price between $20 and $50, at least 4 stars": [(P, ">=", 20), (P, "<=", 50), (R, ">=", 4)],
    "price 20 to 50": [(P, ">=", 20), (P, "<=", 50)],
    "from $20-$50": [(P, ">=", 20), (P, "<=", 50)],
    "rating between 3 and 4": [(R, ">=", 3), (R, "<=", 4)],
    "4+ stars": [(R, ">=", 4)],
    "$30+": [(P, ">=", 30)],
    "4 stars or more": [(R, ">=", 4)],
    "50 dollars or less and 4 stars and up": [(P, "<=", 50), (R, ">=", 4)],
    "rated 4 or higher": [(R, ">=", 4)],
    "no more than 50 dollars": [(P, "<=", 50)],
    "price not above 50": [(P, "<=", 50)],
    "not under 3 stars": [(R, ">=", 3)],
    "never less than 4 stars": [(R, ">=", 4)],
    "not at least 4 stars": [(R, "<", 4)],
    "not up to 4 stars": [(R, ">", 4)],
    "under $50": [(P, "<", 50)],
    "below 50 usd": [(P, "<", 50)],
    "cheaper than 25 bucks": [(P, "<", 25)],
    "price above 20 and below 50": [(P, ">", 20), (P, "<", 50)],
    "rating above 4 and under 50 dollars": [(R, ">", 4), (P, "<", 50)],
    "Stars >= 4, price < 30": [(R, ">=", 4), (P, "<", 30)],
    "at least 4 stars under $30": [(R, ">=", 4), (P, "<", 30)],
    "minimum rating 4": [(R, ">=", 4)],
    "not between 20 and 50 dollars": [],
    "None": [], "": [], None: [], "weight under 3 kg": [], "price 50": [], "stars": [], "between 20": [], "above": [],
    "price under 10 or rating over 4": [(P, "<", 10), (R, ">", 4)],
    "PRICE UNDER 99.5": [(P, "<", 99.5)],
}


@pytest.fixture(scope="module")
def got(spark):
    rows = [(i, t) for i, t in enumerate(FORMS)]
    out = {t: [] for t in FORMS}
    texts = dict(rows)
    for r in sorted(grammar_constraints(spark.createDataFrame(rows, "query_id long, constraints string")).collect(), key=lambda r: (r.query_id, r.pos)):
        out[texts[r.query_id]].append((r.field, r.op, r.value))
    return out


@pytest.mark.parametrize("text", list(FORMS), ids=str)
def test_forms(got, text):
    assert got[text] == FORMS[text]


def test_same_as_the_expression_on_its_forms(spark):
    rows = [(i, f"{f} {o} {'$' if i % 2 else ''}{i}.5 and {g} {p} {i + 1}") for i, (f, o, g, p) in enumerate(
        (f, o, g, p) for f in ("price", "stars", "rating") for o in ("above", "over", "more than", "at least", "under", "below", "less than", "at most", "up to")
        for g in ("price", "reviews") for p in ("over", "at most"))]
    df = spark.createDataFrame(rows, "query_id long, constraints string")
    want = sorted(map(tuple, extract_constraints(df).collect()))
    # a money sign names the field of its number
    want = [(q, n, "price" if n == 1 and q % 2 else f, o, v) for q, n, f, o, v in want]
    assert sorted(map(tuple, grammar_constraints(df).select("query_id", "pos", "field", "op", "value").collect())) == want


def test_runs_in_the_jvm(spark):
    plan = grammar_constraints(spark.createDataFrame([(1, "x")], "query_id long, constraints string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
