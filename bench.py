"""Benchmark the headline queries; prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is run to completion with the ``noop`` sink (full computation, no
driver collect).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from maskweave.session import get_spark  # noqa: E402
from maskweave.plans import registry  # noqa: E402

HEADLINE = [
    "anonymize_documents",
    "rewrite",
    "restore",
    "allocate_tokens",
    "scan_secrets",
    "scan_regex",
    "scan_iac_terraform",
    "scan_entropy",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    qs = registry.queries()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        spark.catalog.clearCache()
        t0 = time.time()
        qs[name](spark, sf_dir).write.mode("overwrite").format("noop").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
