"""python -m loamgrid list | run NAME FOLDER [--to PATH] | explain NAME FOLDER: the registered queries from a shell."""

from __future__ import annotations

import argparse
import importlib.util
import pathlib


def main() -> None:
    ask = argparse.ArgumentParser(prog="loamgrid")
    sub = ask.add_subparsers(dest="do", required=True)
    sub.add_parser("list")
    for name in ("run", "explain"):
        p = sub.add_parser(name)
        p.add_argument("name")
        p.add_argument("folder")
        p.add_argument("--to")
    args = ask.parse_args()
    spec = importlib.util.spec_from_file_location("entry", pathlib.Path(__file__).parent.parent / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    if args.do == "list":
        print(*sorted(entry.queries()), sep="\n")
        return
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("loamgrid").getOrCreate()
    df = entry.queries()[args.name](spark, args.folder)
    if args.do == "explain":
        df.explain("formatted")
    elif args.to:
        df.write.mode("error").parquet(args.to)
    else:
        df.show(50, truncate=False)


if __name__ == "__main__":
    main()
