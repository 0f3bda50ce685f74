"""Print a condensed physical plan (operator tree + scan details) for registered queries.

usage: python tools/show_plans.py [--sf DIR] [--conf key=value] name [name ...]
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def condensed(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    keep = []
    for line in plan.splitlines():
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r"\[plan_id=\d+\]", "", line)
        if len(line) > 160:
            line = line[:157] + "..."
        keep.append(line)
    return "\n".join(keep)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--conf", action="append", default=[], help="extra Spark conf key=value")
    ap.add_argument("names", nargs="+")
    a = ap.parse_args()
    from vicinity.plans import QUERIES
    from vicinity.session import get_spark
    spark = get_spark("local[8]", shuffle_partitions=8)
    for kv in a.conf:
        k, v = kv.split("=", 1)
        spark.conf.set(k, v)
    for n in a.names:
        print(f"### {n}\n```")
        print(condensed(QUERIES[n](spark, a.sf)))
        print("```\n")


if __name__ == "__main__":
    main()
