"""Scale probe (dev tool, not a registered query): hybrid retrieval of every product question
against the product corpus enlarged by jittered copies, timed into the ``noop`` sink.

usage: python tools/scale_probe.py [sf_dir] [copies]
The enlarged corpus is written once under the shared checkpoint folder, then read back, so the
timing covers retrieval only. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from shoprank.operators.knn import SideStats  # noqa: E402
from shoprank.plans.fixtures import parity_questions  # noqa: E402
from shoprank.plans.retrieval import retrieve  # noqa: E402
from shoprank.session import drop_scratch, get_spark, scratch_path  # noqa: E402
from shoprank.sources.vectors import product_vectors  # noqa: E402


def jitter(col: str, copy):
    """Deterministic small perturbation of every element (copy 0 is the original)."""
    return F.transform(F.col(col), lambda x, i: (x + F.lit(0.02) * F.sin(copy * F.lit(7.0) + i.cast("double"))
                                                 * F.when(copy == 0, F.lit(0.0)).otherwise(F.lit(1.0))).cast("float"))


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    copies = int(sys.argv[2]) if len(sys.argv) > 2 else 100
    spark = get_spark("shoprank-scale")
    corpus = product_vectors(spark, sf_dir, ["Clip-STrans"])
    n_base = corpus.count()
    copy = F.col("copy")
    big = (corpus.select("*", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
           .select("group_key", (F.col("copy").cast("bigint") * F.lit(10_000_000) + F.col("product_id")).alias("product_id"),
                   jitter("tv", copy).alias("tv"), jitter("iv", copy).alias("iv")))
    path = scratch_path(spark, "scale-corpus")
    big.write.parquet(path)
    big = spark.read.parquet(path)
    stats_c = SideStats(n_base * copies, 24, 32)
    questions = parity_questions(spark, sf_dir)
    out = {"sf_dir": sf_dir, "questions": n_base, "corpus": n_base * copies}
    for rep in range(2):
        t0 = time.perf_counter()
        retrieve(questions, big, cstats=stats_c).write.format("noop").mode("overwrite").save()
        out[f"sec_run{rep}"] = round(time.perf_counter() - t0, 2)
    out["pairs_per_sec_run1"] = round(out["questions"] * out["corpus"] / out["sec_run1"])
    # correctness spot check: copy 0 is the question's own vector in both spaces, so it
    # must rank first for every question
    ranked = retrieve(questions, big, cstats=stats_c)
    firsts = ranked.filter(F.col("rank") == 1).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("product_id") == F.col("query_id")).cast("int")).alias("self"))
    row = firsts.first()
    out["rank1_is_self"] = f"{row['self']}/{row['n']}"
    drop_scratch(spark)
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
