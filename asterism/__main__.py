"""python -m asterism run NAME|FILE.sql [--data DIR] [--form int32|coded|strings] [--out DIR] [--parts] [--repeat N] [--explain]

Runs a registered query or a file of SQL over the star views; prints the rows, or
writes them as a result file (--parts: by the executors, in parts), or times repetitions in milliseconds.  With --form the
data are the benchmark's own files: int32 columns, or .tbl text with codes or strings.
"""

from __future__ import annotations

import argparse
import time
from pathlib import Path

from pyspark.sql import SparkSession

from .registry import queries, run_files, run_sql
from .sources.sink import print_result, save_distributed, save_result


def main() -> None:
    parser = argparse.ArgumentParser(prog="asterism", description=__doc__)
    parser.add_argument("command", choices=["run", "list"])
    parser.add_argument("query", nargs="?", default="ssb_default")
    parser.add_argument("--data", default="/root/testdata/sf0.01")
    parser.add_argument("--form", choices=["int32", "coded", "strings"])
    parser.add_argument("--out")
    parser.add_argument("--parts", action="store_true")
    parser.add_argument("--repeat", type=int, default=0)
    parser.add_argument("--explain", action="store_true")
    args = parser.parse_args()
    if args.command == "list":
        print("\n".join(queries()))
        return
    spark = SparkSession.builder.appName("asterism").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    name = Path(args.query).stem

    def frame():
        if args.query.endswith(".sql"):
            return run_sql(spark, args.data, Path(args.query).read_text().rstrip().rstrip(";"), args.form)
        if args.form:
            return run_files(spark, args.data, args.form, args.query)
        return queries()[args.query](spark, args.data)

    if args.explain:
        frame().explain("formatted")
    elif args.repeat:
        for _ in range(args.repeat):
            began = time.perf_counter()
            frame().collect()
            print(f"{(time.perf_counter() - began) * 1e3:.3f}")
    elif args.out and args.parts:
        save_distributed(frame(), f"{args.out}/{name}")
    elif args.out:
        print(save_result(frame(), args.out, name))
    else:
        print_result(frame())


if __name__ == "__main__":
    main()
