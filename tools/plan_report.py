"""Summarises the physical plan of every registered query: exchanges, join
strategies, Python stages, what the scans read and which filters reach them.

    python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def report(spark, sf_dir: str, queries: dict) -> None:
    print("| Query | Scans | Exchanges | Reused | Broadcast joins | Sort-merge joins | Python stages | "
          "Windows | Columns read | Filters pushed to the scan |")
    print("|---|---|---|---|---|---|---|---|---|---|")
    for name, fn in sorted(queries.items()):
        df = fn(spark, sf_dir)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        reads = sorted(set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)))
        cols = "; ".join(",".join(f.split(":")[0] for f in r.split(",")) for r in reads) or "(checkpoint)"
        pushed = sorted({p for p in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) if p})
        py = sum(plan.count(k) for k in ("MapInPandas", "ArrowEvalPython", "FlatMapGroupsInPandas"))
        scans = plan.count("FileScan") + plan.count("Scan ExistingRDD")
        print(f"| `{name}` | {scans} | {plan.count('Exchange ') - plan.count('ReusedExchange')} | "
              f"{plan.count('ReusedExchange')} | {plan.count('BroadcastHashJoin')} | "
              f"{plan.count('SortMergeJoin')} | {py} | {plan.count('Window [')} | {cols} | "
              f"{'; '.join(pushed)[:120] or '-'} |")


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from vigil.plans import load_all
    from vigil.plans.registry import QUERIES
    from vigil.session import build_session, ensure_checkpoint_dir

    load_all()
    spark = build_session()
    ensure_checkpoint_dir(spark)
    print("# Physical plans\n")
    print(f"Generated by `tools/plan_report.py` at `{os.path.basename(sf_dir)}`: each query is run, then "
          "its final adaptive plan is read (checkpointed inputs show as scans of the checkpoint; a stage "
          "that AQE reuses is counted under Reused, not again under Exchanges). The second table has "
          "broadcasts by measured size off, as for sides that are large on a cluster; what stays broadcast "
          "there has a hint and a proven bound.\n")
    for off in (False, True):
        if off:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
        print("## Broadcasts by size off\n" if off else "## Default settings\n")
        report(spark, sf_dir, QUERIES)
        print()
    spark.stop()


if __name__ == "__main__":
    main()
