"""Summarise the physical plans of the headline queries (markdown on stdout).

    python tests/plan_report.py [sf_dir] > PLANS.md

For each query: shuffles (Exchange), join strategies, aggregate operators,
windows, scans with their read schema and pushed filters. Scalar
subqueries are listed separately. This is the plan review we iterate on.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402


def summarise(plan: str) -> dict:
    ops = re.findall(r"^\(\d+\) ([A-Za-z]+(?: [A-Za-z]+)*)", plan, flags=re.M)
    count = lambda name: sum(1 for o in ops if o.startswith(name))
    scans = re.findall(r"\(\d+\) Scan parquet[^\n]*\n(?:[^\n]*\n)*?ReadSchema: ([^\n]+)", plan)
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", plan)
    joins = sorted({o for o in ops if "Join" in o})
    return {
        "exchanges": count("Exchange"), "broadcasts": count("BroadcastExchange"),
        "joins": ", ".join(joins) or "-",
        "aggregates": ", ".join(sorted({o for o in ops if "Aggregate" in o})) or "-",
        "windows": count("Window"), "subqueries": plan.count("Subquery subquery"),
        "python": "yes" if ("ArrowEvalPython" in plan or "BatchEvalPython" in plan) else "no",
        "cartesian": "yes" if ("CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan) else "no",
        "scans": [s.strip() for s in scans], "pushed": [p for p in pushed if p],
    }


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    from plotwise.plans import registry
    from plotwise.session import get_spark
    registry.load_all()
    spark = get_spark("local[8]", 16)
    print(f"# Plan review ({os.path.basename(sf_dir)}, initial adaptive plans)\n")
    print("| query | exchanges | broadcast | joins | aggregates | windows | scalar subqueries | Python | cartesian |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    details = []
    for name in HEADLINE:
        df = registry.QUERIES[name](spark, sf_dir)
        plan = df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        text = df._jdf.queryExecution().explainString(plan)
        s = summarise(text)
        print(f"| `{name}` | {s['exchanges']} | {s['broadcasts']} | {s['joins']} | {s['aggregates']} | "
              f"{s['windows']} | {s['subqueries']} | {s['python']} | {s['cartesian']} |")
        details.append((name, s))
    print("\n## Scans (read schema; pushed filters)\n")
    for name, s in details:
        scans = "; ".join(sorted(set(s["scans"])))
        pushed = "; ".join(sorted(set(s["pushed"]))) or "-"
        print(f"* `{name}`: {scans} — pushed: {pushed}")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
