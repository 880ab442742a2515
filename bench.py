"""Headline queries on local cores; prints one JSON line.

BENCH_SF_DIR: data folder (default /root/testdata/sf0.1); BENCH_CPUS: cores (default 8).
Every query is run whole into a sink that writes nothing; plans are built inside
the measured time, a warm-up query outside of it.  The merges are timed first; queries
on the merged table (``on_merged`` in the output) read what they have kept, so their
times do not hold a merge.
"""

from __future__ import annotations

import json
import os
import sys
import time

from vacantia.plans import queries, runs
from vacantia.plans.postings import postings
from vacantia.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "f06_passes_region", "x01_html_text", "x12_stack", "x14_signal_counts", "r_score", "r_rules", "t00_best_postings",
    "s01_greenhouse", "s05_linkedin", "m03_field_merge", "m13_rescore_all", "t01_top_by_score", "f11_text_search",
    "a02_region_counts", "f13_constraints",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS, "bench", os.environ.get("BENCH_MEMORY", "16g"))
    run(queries.QUERIES["r_score"](spark, FOLDER))
    rows = postings(spark, FOLDER).count()

    times: dict[str, float] = {}

    def timed(name, work) -> None:
        start = time.perf_counter()
        work()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)

    for n in runs.RUNS:
        timed(f"merge_run{n}", lambda n=n: run(queries.merged(spark, FOLDER, n)[0].jobs))
    for name in HEADLINE:
        timed(name, lambda name=name: run(queries.QUERIES[name](spark, FOLDER)))

    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": FOLDER.rstrip("/").split("sf")[-1],
                "cpus": int(CPUS),
                "postings": rows,
                "on_merged": ["m03_field_merge", "m13_rescore_all", "t01_top_by_score", "f11_text_search", "a02_region_counts", "f13_constraints"],
                "scored_per_sec": round(rows / times["r_score"], 1),
            }
        )
    )


if __name__ == "__main__":
    main()
