"""Headline queries, timed; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import Observation  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from quakeloom.plans.queries import QUERIES  # noqa: E402
from quakeloom.session import local_session  # noqa: E402

WARM_UP = "/root/testdata/sf0.001"
HEADLINE = (
    "fingerprints",
    "fingerprints_all_populations",
    "duplicate_groups",
    "declustered_catalogue",
    "nearest_states_fixed",
    "walk_forward_scores",
    "replay_baselines",
    "model_metrics",
    "region_assignment",
    "magnitude_homogenisation",
    "density_grid",
    "fdsn_text",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds, rows = {}, {}
    # Once untimed, so that the first query does not pay for compiling.
    QUERIES[HEADLINE[0]](spark, WARM_UP).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        # Every column of every row is made; a count would let the planner drop them.
        seen = Observation()
        began = time.perf_counter()
        frame = QUERIES[name](spark, folder).observe(seen, F.count(F.lit(1)).alias("n"))
        frame.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        rows[name] = seen.get["n"]
    print(
        json.dumps(
            {
                "metric": "total_headline_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows": rows,
                "fingerprints_per_second": round(
                    rows["fingerprints"] / seconds["fingerprints"], 1
                ),
                "sf": folder.rsplit("sf", 1)[-1].strip("/"),
            }
        )
    )


if __name__ == "__main__":
    main()
