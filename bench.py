"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   folder with the Parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names instead of the default list
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.people import people  # noqa: E402
from checks.queries import QUERIES  # noqa: E402
from veilframe.session import local_session  # noqa: E402

HEADLINE = (
    "clean_people_table",
    "numeric_projection",
    "mask_noise",
    "mask_generalize",
    "mask_laplace",
    "mask_perturb",
    "mask_swap_exact",
    "mask_hybrid",
    "mask_many_settings",
    "profile_moments",
    "correlation_long",
    "drift_ks",
    "drift_all_measures",
    "k_anonymity_generalized",
    "privacy_score",
    "matrix_preservation",
    "information_loss",
    "mutual_information",
    "roc_auc_rank",
    "sweep_privacy",
    "sweep_fidelity",
    "sweep_ranked",
    "train_logistic",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = local_session(cpus=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="veilframe-bench")
    spark.sparkContext.setLogLevel("ERROR")
    rows = people(spark, sf_dir).count()  # writes the derived person table once, outside the timings
    timings = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "people_rows": rows,
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
