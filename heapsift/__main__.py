"""python -m heapsift DUMP: a report on a heap dump."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans.heap import Heap
from .plans.report import SECTIONS, UsageError, View, as_json, as_text
from .sources import hprof


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="heapsift", description="Where the memory of a heap dump is.")
    p.add_argument("file")
    p.add_argument("--top", type=int, default=20)
    p.add_argument("--suspect", type=float, default=10.0, help="percent of the live bytes")
    p.add_argument("--sort", default="retained", choices=["retained", "shallow", "instances", "name"])
    p.add_argument("--only", action="append", default=[], help=f"of {', '.join(SECTIONS)}")
    p.add_argument("--skip", action="append", default=[])
    p.add_argument("--exclude", action="append", default=[], metavar="CLASS")
    p.add_argument("--include-soft", action="store_true")
    p.add_argument("--include-weak", action="store_true")
    p.add_argument("--sizes", default="auto", choices=["auto", "mat", "compressed", "full"])
    p.add_argument("--json", action="store_true")
    args = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        view = View(args.top, args.suspect, args.sort, tuple(args.only), tuple(args.skip), tuple(args.exclude))
        view.sections()
        heap = Heap(hprof.heap(spark, args.file, args.sizes, args.include_soft, args.include_weak).cut())
        print(as_json(heap, view) if args.json else as_text(heap, view))
    except (UsageError, OSError) as e:
        print(f"heapsift: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
