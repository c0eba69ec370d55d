"""Every registered query against its DuckDB oracle on the smallest scale (whole tables)."""

import pytest

import __spark_entry__ as entry
from shoprank.plans.parity import compare, duckdb_views
from shoprank.plans.queries import QUERIES

from .conftest import SF_SMALL

#: Approximate or measuring queries, which their own tests compare with brute force.
MEASURED = {"cell_topk", "cell_recall", "coded_search_report"}
NAMES = sorted(set(QUERIES) - MEASURED)


@pytest.fixture(scope="module")
def con():
    return duckdb_views(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(entry.queries()) and set(NAMES) <= set(entry.oracle_sql()) and MEASURED <= set(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    ok, detail = compare(df, con, entry.oracle_sql()[name])
    assert ok, detail


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["query_id", "rank", "product_id", "title", "store", "price",
                          "average_rating", "image", "score"]
    # self-query ranks first: every product is its own nearest neighbour in both spaces
    firsts = [r for r in rows if r.rank == 1]
    assert all(r.query_id == r.product_id for r in firsts)
