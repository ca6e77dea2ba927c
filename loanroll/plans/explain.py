"""Condensed physical plans of registered queries.

    python -m loanroll.plans.explain [--sf-dir DIR] [--formatted] key [key ...]

Prints, per query, the operator tree of the initial adaptive plan with only
the nodes that matter for scale (scans with their pushed filters and read
schema, exchanges, aggregates, joins, windows, sorts); ``--formatted``
prints Spark's full ``explain("formatted")`` instead.
"""

from __future__ import annotations

import argparse
import re

from pyspark.sql import DataFrame

_KEEP = ("Exchange", "HashAggregate", "SortAggregate", "ObjectHashAggregate", "Join", "Window",
         "FileScan", "Scan ", "Sort ", "Generate", "Union")


def condensed_plan(df: DataFrame) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    out = []
    for line in plan.splitlines():
        if not any(k in line for k in _KEEP):
            continue
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r", \[plan_id=\d+\]", "", line)
        line = re.sub(r"Location: InMemoryFileIndex\(\d+ paths\)\[[^\]]*/([^/\]]+)\]", r"table: \1", line)
        line = re.sub(r"functions=\[(.{0,90})[^\]]*\]", r"functions=[\1...]", line)
        out.append(line[:220])
    return "\n".join(out)


def main(argv: list[str] | None = None) -> None:
    from loanroll.plans.registry import queries
    from loanroll.session import get_session

    ap = argparse.ArgumentParser(description="condensed physical plans")
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("--formatted", action="store_true")
    ap.add_argument("keys", nargs="+")
    args = ap.parse_args(argv)
    spark = get_session()
    spark.conf.set("spark.sql.maxMetadataStringLength", "400")
    qs = queries()
    for key in args.keys:
        df = qs[key](spark, args.sf_dir)
        print(f"### {key}\n")
        if args.formatted:
            df.explain("formatted")
        else:
            print("```\n" + condensed_plan(df) + "\n```\n")


if __name__ == "__main__":
    main()
