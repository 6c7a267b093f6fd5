"""Headline checks timed at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from driftgate.plans.catalog import QUERIES  # noqa: E402
from driftgate.session import local_session  # noqa: E402

HEADLINES = [
    "agg9_shadow_tallies",  # source against target by key
    "agg11_chunk_compare",  # checksums per key range on both sides
    "agg12_merkle_diff",  # hash trees, from above to the leaves
    "set1_compare_results",  # result sets
    "agg8_review_aggregates",
    "prj1_parse_envelope",  # change stream: parse, first delivery, apply
    "win2_first_delivery",
    "joi5_apply_changes",
    "win1_fence",  # running maximum over a whole log
    "win11_running_cost",
    "prj5_hmac",  # keyed hashes of whole texts
    "joi2_fk_orphans",
    "src4_table_profile",
    "sim2_evaluate_risk",
    "joi6_price_in_force",  # as-of join, distributed form
    "prj16_route_writes",  # as-of join, lookup form
    "gat10_alert_starts",
    "agg20_resilience_score",
    "ml2_score",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINES
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    # a first small query, so that starting the JVM is not counted
    spark.read.parquet(f"{folder}/nation.parquet").groupBy("n_regionkey").count().collect()
    seconds = {}
    for name in wanted:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline checks", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": round(lines / 6_000_000, 4), "lineitem_rows": lines, "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
