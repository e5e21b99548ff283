"""python -m vecshift list | run NAME DIR [--out PATH] [--format show|json|csv|markdown] | sql NAME | explain NAME DIR"""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="vecshift", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all queries")
    for name in ("run", "explain"):
        r = sub.add_parser(name)
        r.add_argument("query")
        r.add_argument("dir")
        if name == "run":
            r.add_argument("--out")
            r.add_argument("--format", choices=["show", "json", "csv", "markdown"], default="show")
    sub.add_parser("sql").add_argument("query")
    a = p.parse_args(argv)
    from vecshift.plans import catalog

    if a.command == "list":
        for n, f in catalog.QUERIES.items():
            print(n, "-", (f.__doc__ or "").strip().split("\n")[0] or ("with SQL" if n in catalog.ORACLES else "rows only"))
        return 0
    if a.query not in catalog.QUERIES:
        print(f"no query {a.query}")
        return 2
    if a.command == "sql":
        print(catalog.ORACLES.get(a.query, "-- not expressible"))
        return 0
    from pyspark.sql import SparkSession

    from vecshift.sources import readers

    df = catalog.QUERIES[a.query](SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), a.dir)
    if a.command == "explain":
        df.explain("formatted")
    elif a.format == "markdown":
        print(readers.markdown(df))
    elif a.format == "show":
        df.show(50, truncate=False)
    else:
        readers.write_report(df, a.out or f"{a.query}.{a.format}", a.format)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
