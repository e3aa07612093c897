"""Write PLANS.md: the physical plan shape of every registered query.

Usage: python tools/plan_report.py [sf_dir]
Counts per query (after execution, so adaptive plans are final): shuffles,
broadcasts, joins, windows, Python nodes, and whether filters reached the scan.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tagloom.plans import catalog  # noqa: E402
from tagloom.session import local_session  # noqa: E402

PATTERNS = {
    "shuffle": r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)",
    "broadcast": r"BroadcastExchange",
    "smj": r"SortMergeJoin",
    "bhj": r"BroadcastHashJoin",
    "nested_loop": r"BroadcastNestedLoopJoin|CartesianProduct",
    "window": r"\bWindow \[",
    "group_limit": r"WindowGroupLimit",
    "partial_agg": r"Aggregate\(keys?=\[[^\]]*\], functions=\[partial_",
    "sort_agg": r"SortAggregate",
    "top_k": r"TakeOrderedAndProject",
    "python": r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas|FlatMapGroupsInArrow",
}


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    rows = []
    for name, fn in catalog.QUERIES.items():
        if name.startswith("stream_") or name in ("csv_roundtrip", "history_table_query"):
            continue
        df = fn(spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        counts = {k: len(re.findall(v, plan)) for k, v in PATTERNS.items()}
        pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", plan)
        counts["pushed_filters"] = "yes" if any(p.strip() for p in pushed) else "-"
        rows.append((name, counts))
    cols = list(PATTERNS) + ["pushed_filters"]
    out = ["# Plan shapes of the registered queries", "", f"Generated by `tools/plan_report.py` on `{sf}` (local[8], AQE on, final adaptive plans).", ""]
    out.append("Streaming keys, `csv_roundtrip` and `history_table_query` write files and are not listed.")
    out.append("`shuffle` counts exchanges of any size: chunk tables, partial aggregates and group-limited heads/tails shuffle only small row sets.")
    out.append("")
    out.append("| query | " + " | ".join(cols) + " |")
    out.append("| --- | " + " | ".join("---" for _ in cols) + " |")
    for name, c in rows:
        out.append(f"| {name} | " + " | ".join(str(c[k]) for k in cols) + " |")
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out) + "\n")
    print(f"wrote {path}: {len(rows)} queries")


if __name__ == "__main__":
    main()
