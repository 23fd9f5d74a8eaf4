"""python -m tracewell list | sql NAME | run NAME --data DIR [--rows N]"""

from __future__ import annotations

import argparse

from .plans import registry


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tracewell", description="Lists, shows and runs the library's queries.")
    sub = p.add_subparsers(dest="do", required=True)
    sub.add_parser("list")
    for name in ("sql", "run"):
        s = sub.add_parser(name)
        s.add_argument("query", choices=sorted(registry.QUERIES), metavar="QUERY")
        if name == "run":
            s.add_argument("--data", required=True, help="folder of the tables")
            s.add_argument("--rows", type=int, default=20, help="rows to show")
    a = p.parse_args(args)
    if a.do == "list":
        print("\n".join(f"{n}{'' if n in registry.SQL else '  (no SQL)'}" for n in sorted(registry.QUERIES)))
    elif a.do == "sql":
        print(registry.SQL.get(a.query, "-- no SQL expresses this query"))
    else:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        registry.QUERIES[a.query](spark, a.data).show(a.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
