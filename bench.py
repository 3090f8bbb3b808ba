"""Headline-query benchmark: prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is executed in full with the ``noop`` sink (no collect to the
driver); the time is wall-clock seconds per query after session start.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mailrisk.plans.catalog import REGISTRY  # noqa: E402
from mailrisk.session import get_session  # noqa: E402

HEADLINE = ["training_table", "analyze_emails", "vocabulary", "model_scores", "signal_reasons",
            "domain_breakdown", "history_list"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = get_session("mailrisk-bench")
    # JVM/codegen warm-up on the smallest tables, outside the timings
    REGISTRY["domain_breakdown_labels"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        fn = REGISTRY[name][0]
        t0 = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else None}))


if __name__ == "__main__":
    main()
