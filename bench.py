"""Benchmark the headline queries; prints ONE JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_QUERIES (comma list, default the headline set below).
Each query is planned and fully executed into Spark's ``noop`` sink (no driver collect).
A warm-up run of the flagship on sf0.001 starts the JVM and Python workers first.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shoprank.plans.queries import QUERIES  # noqa: E402
from shoprank.session import drop_scratch, get_spark  # noqa: E402

HEADLINE = [
    "hybrid_topk_fetch",
    "mode_dispatch",
    "mixed_parameter_topk",
    "alpha_sweep",
    "text_only_topk",
    "recommend_top3",
    "rag_prompt_end_to_end",
    "keyword_rag_prompt",
    "text_mode_topk",
    "hashed_text_search",
    "text_encode_hashed",
    "catalog_csv_ingest",
    "stream_retrieval",
]


def run(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    sf = float(m.group(1)) if m else None

    spark = get_spark("shoprank-bench", cpus=cpus)
    warm = run(spark, "hybrid_topk_fetch", "/root/testdata/sf0.001") if os.path.isdir("/root/testdata/sf0.001") else 0.0
    times = {}
    for name in names:
        times[name] = round(run(spark, name, sf_dir), 3)
    drop_scratch(spark)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf,
        "cpus": int(cpus),
        "warmup_sec": round(warm, 3),
    }))


if __name__ == "__main__":
    main()
