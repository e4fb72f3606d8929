"""Headline-query bench: runs registered queries at $BENCH_SF_DIR (default
/root/testdata/sf0.1) on local[$BENCH_CPUS] and prints one JSON line.

Each query is executed in full into Spark's ``noop`` sink (no collect to
the driver); the figure is wall-clock seconds per query, and ``value`` is
their sum.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from omics_spark.catalog import QUERIES  # noqa: E402
from omics_spark.session import local_session  # noqa: E402

HEADLINE = [
    "variant_overlaps_per_contig",
    "filter_variants",
    "intersect_intervals",
    "merge_intervals",
    "subtract_intervals",
    "restrict_to_intervals",
    "depth_segments",
    "flagstat",
    "bin_coverage",
    "sort_alignments",
    "kmer_seed_counts",
    "pileup_counts",
    "somatic_calls",
    "bh_qvalues",
    "column_conservation",
    "neighbours_3d",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")),
                          app="omics_spark_bench")
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    spark.stop()
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": cpus}))


if __name__ == "__main__":
    main()
