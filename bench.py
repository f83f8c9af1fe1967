"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from palimpsest.plans.registry import all_queries  # noqa: E402
from palimpsest.session import local_session  # noqa: E402

HEADLINE = (
    "a8_table_hash_lineitem",
    "a9_group_hash",
    "v1_diff",
    "v3_merge3",
    "h1_log",
    "h4_merge_base",
    "h5_resolve_revisions",
    "t1_segment",
    "t2_canonical_groups",
    "d1_check_pk",
    "d4_check_fk",
    "a1_ordered_list",
    "w1_densify",
    "j1_join_parents",
    "a3_orders_with_lines",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    queries, seconds = all_queries(), {}
    queries["d1_check_pk_clean"](spark, sf).collect()  # starts the session's threads and code
    for name in HEADLINE:
        begun = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begun, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
