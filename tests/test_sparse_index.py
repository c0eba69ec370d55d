"""Sparse top-n over the inverted index against plain dot products."""

import random
import re
from collections import Counter
from math import sqrt

import numpy as np
import pytest

from shoprank.operators import sparse_index, tile_join
from shoprank.operators.sparse_index import build_index, search_index


def counts(text):
    return Counter(x for x in re.split(r"[^\w]+|_", text.lower()) if x)


def plain(text, products, n):
    q = counts(text)
    nq = sqrt(sum(v * v for v in q.values()))
    out = []
    for i, t in products:
        c = counts(t or "")
        d = sum(v * c[k] for k, v in q.items())
        if d:
            out.append((-d / (nq * sqrt(sum(v * v for v in c.values()))), i))
    return [i for _, i in sorted(out)[:n]]


def some(rnd, words, most):
    return " ".join(rnd.choice(words) for _ in range(rnd.randint(0, most)))


@pytest.mark.parametrize("block, postings, broadcast", [(2, 60, 1 << 26), (128, 400_000, 1 << 26), (3, 40, 0)])
def test_same_as_plain(spark, monkeypatch, block, postings, broadcast):
    monkeypatch.setattr(sparse_index, "BLOCK", block)
    monkeypatch.setattr(sparse_index, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(tile_join, "BROADCAST_BYTES", broadcast)
    rnd = random.Random(block)
    words = ["the"] * 12 + ["Red", "mug", "é", "x1", "lamp", "blue-green", "shirt", "of", "wool"] + [f"w{i}" for i in range(40)]
    products = [(i, "the " + some(rnd, words, 12)) for i in range(150)] + [(200, None), (201, ""), (202, "!!!")]
    asked = [(i, some(rnd, words, 6), rnd.choice([1, 4, 300])) for i in range(60)] + [(100, "", 3), (101, None, 3), (102, "unknownword", 3), (None, "the", 3)]
    asked += [(103, "the the mug", 5), (104, "the the mug", 5)]
    index = build_index(spark.createDataFrame(products, "product_id long, text string").repartition(4))
    got = {}
    for r in search_index(spark.createDataFrame(asked, "query_id long, text string, n int").repartition(3), index, question_rows=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.product_id, r.score))
    for i, text, n in asked:
        if i is not None:
            assert [p for _, p, _ in sorted(got.get(i, []))] == plain(text or "", products, n)
    assert None not in got


def test_bounds_skip_postings():
    """A frequent token's blocks are not read for documents that can't reach the threshold."""
    import pyarrow as pa

    rows = [(i, "the", 1) for i in range(5000)] + [(i, f"rare{i}", 3) for i in range(5000)]
    t = pa.table({"product_id": [r[0] for r in rows], "token": [r[1] for r in rows], "tf": pa.array([r[2] for r in rows], pa.int32()), "tile": pa.array([0] * len(rows), pa.int32())})
    shard = sparse_index.Shard(tile_join.from_blob(sparse_index._shard(t).column("blob")[0].as_py()))
    doc, dot, read = shard.best(["the", "rare7"], [1, 1], 1, 0.0)
    assert read == 5001 and len(doc) == 5000
    doc, dot, read = shard.best(["the", "rare7"], [1, 1], 1, 0.9)
    assert doc.tolist() == [7] and dot.tolist() == [4] and read <= 1 + sparse_index.BLOCK
    assert shard.best(["the"], [1], 1, 0.9)[0].tolist() == [] and shard.best(["no"], [1], 1, 0.0)[2] == 0
    assert np.allclose(shard.norm, sqrt(10))


def test_empty(spark):
    schema = "product_id long, text string"
    asked = spark.createDataFrame([(1, "a", 2)], "query_id long, text string, n int")
    assert search_index(asked, build_index(spark.createDataFrame([], schema))).collect() == []
    assert search_index(asked.limit(0), build_index(spark.createDataFrame([(1, "a")], schema))).collect() == []
