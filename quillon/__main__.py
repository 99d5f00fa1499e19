"""Lists and runs queries: ``python -m quillon list`` and ``python -m quillon run NAME FOLDER [--out PATH]``."""

from __future__ import annotations

import argparse

from quillon.plans import core


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillon")
    sub = parser.add_subparsers(dest="what", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("name", choices=sorted(core.QUERIES))
    run.add_argument("folder")
    run.add_argument("--out")
    given = parser.parse_args(args)
    if given.what == "list":
        print("\n".join(sorted(core.QUERIES)))
        return 0
    from pyspark.sql import SparkSession

    rows = core.QUERIES[given.name](SparkSession.builder.getOrCreate(), given.folder)
    if given.out:
        rows.write.mode("overwrite").parquet(given.out)
    else:
        rows.show(20, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
