"""Times the benchmark's queries and prints one JSON line.

The star's tables are computed and stored first, as a benchmark's tables are
loaded before it runs; that time is ``load`` and not part of the value.

BENCH_SF_DIR: tables (default /root/testdata/sf0.1); BENCH_CPUS: cores (8);
BENCH_COPIES: each row of the fact table so many times, to see throughput (1);
BENCH_REPS: timed repetitions after one that is dropped (3); BENCH_TABLE=1 prints
a table of min/median milliseconds to stderr as well.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from statistics import median

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from asterism.queries import CODED
from asterism.sources.saved import save_star
from asterism.sources.starviews import FACT_COLUMNS, Star


class Copies(Star):
    """A star whose fact table holds each row so many times."""

    times = int(os.environ.get("BENCH_COPIES", "1"))

    def lineorder(self, columns=FACT_COLUMNS):
        rows = super().lineorder(columns)
        return rows if self.times == 1 else rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(self.times)))).drop("copy")


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    with tempfile.TemporaryDirectory(prefix="bench-") as own:
        run(spark, directory, own, reps)
    spark.stop()


def run(spark: SparkSession, directory: str, own: str, reps: int) -> None:
    began = time.perf_counter()
    star = save_star(Copies(spark, directory), own)
    load = time.perf_counter() - began
    times: dict[str, list[float]] = {}
    for name, query in CODED.items():
        query(star).collect()
        for _ in range(reps):
            began = time.perf_counter()
            query(star).collect()
            times.setdefault(name, []).append(time.perf_counter() - began)
    if os.environ.get("BENCH_TABLE"):
        print("exec ms, min/median: " + "; ".join(f"{k} {min(v) * 1e3:.1f}/{median(v) * 1e3:.1f}" for k, v in times.items()), file=sys.stderr)
    seconds = {k: round(median(v), 4) for k, v in times.items()}
    scale = re.search(r"sf([\d.]+)", directory)
    print(json.dumps({"metric": "ssb_total_seconds", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": float(scale[1]) if scale else None, "load": round(load, 3), "reps": reps, "copies": Copies.times}))


if __name__ == "__main__":
    main()
