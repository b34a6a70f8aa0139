"""List the parts of each registered query's plan that would not scale:
cartesian and nested-loop joins, and exchanges into one partition."""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

MARKS = ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition", "BatchEvalPython")


def marks(df) -> dict[str, int]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {m: len(re.findall(m, plan)) for m in MARKS if m in plan}


if __name__ == "__main__":
    from __spark_entry__ import queries
    from millrace.session import local_session

    spark = local_session("8", "plans")
    for name, build in queries().items():
        if len(sys.argv) > 2 and not name.startswith(tuple(sys.argv[2:])):
            continue
        found = marks(build(spark, sys.argv[1]))
        if found:
            print(name, found, flush=True)
