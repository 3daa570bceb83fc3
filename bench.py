"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data (default sf0.1), ``BENCH_CPUS`` the local cores (default 8).
Every query is run to the end by writing to the no-op sink, after one warm-up of the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from streetgrove.plans import catalog  # noqa: E402
from streetgrove.session import local_session  # noqa: E402

HEADLINE = (
    "audit_summary", "plantable_mask", "quota_limits", "structure_cluster", "greedy_select", "validate_spacing", "term_canopy", "term_dust",
    "planting_value", "classification_report", "line_rasterize", "edit_journal_apply", "law_quote_check", "species_hard_filter",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus) if cpus.isdigit() else 8), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 2)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 2), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
