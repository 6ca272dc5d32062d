"""Command line: list or run the registered queries.

    python -m wavepanel list
    python -m wavepanel run frequency_all_questions --sf /root/testdata/sf0.01 --show 20
    python -m wavepanel run missing_table --sf <dir> --out <shared>/missing --format csv
    python -m wavepanel explain panel_rows --sf <dir>
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="wavepanel")
    sub = parser.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list the registered queries")
    for name in ("run", "explain"):
        p = sub.add_parser(name)
        p.add_argument("query")
        p.add_argument("--sf", default="/root/testdata/sf0.01", help="folder with the input tables")
        p.add_argument("--master", default=None, help="e.g. local[8]; default: the cluster's")
        if name == "run":
            p.add_argument("--show", type=int, default=20, help="rows to print (display only)")
            p.add_argument("--out", default=None, help="write the whole result here instead")
            p.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    args = parser.parse_args(argv)

    from .plans.catalog import DESCRIPTIONS, QUERIES

    if args.cmd == "list":
        for name in QUERIES:
            print(f"{name:32s} {DESCRIPTIONS.get(name, '')}")
        return 0
    if args.query not in QUERIES:
        print(f"unknown query {args.query!r}; see `python -m wavepanel list`", file=sys.stderr)
        return 2
    from .session import get_session

    spark = get_session(args.master)
    df = QUERIES[args.query](spark, args.sf)
    if args.cmd == "explain":
        df.explain("formatted")
    elif args.out:
        writer = df.write.mode("overwrite")
        (writer.option("header", True).csv(args.out) if args.format == "csv" else writer.parquet(args.out))
    else:
        df.show(args.show, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
