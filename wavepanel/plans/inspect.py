"""Plan checks used by the tests (read the physical plan text only)."""

from __future__ import annotations

from pyspark.sql import DataFrame

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")
PAIR_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin")
# aggregates whose buffer holds a whole group (or all its distinct values)
GATHERING = ("collect_list(", "collect_set(", "array_agg(", " percentile(", "(percentile(", "median(")


def physical_plan(df: DataFrame) -> str:
    """The physical plan of a fresh copy (an executed adaptive plan would also
    print its initial plan)."""
    return df.select("*")._jdf.queryExecution().executedPlan().toString()


def problems(df: DataFrame) -> list[str]:
    """Python evaluation, all-pairs joins, or a local scan of a Python list
    shuffled into a join (a dictionary that lost its broadcast)."""
    plan = physical_plan(df)
    out = [n for n in PYTHON_NODES + PAIR_NODES if n in plan]
    out += [g.strip(" (") for g in GATHERING if g in plan]
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Scan ExistingRDD" in line and i > 0 and "Exchange hashpartitioning" in lines[i - 1]:
            out.append("shuffled dictionary")
    return out


AGGREGATES = ("HashAggregateExec", "ObjectHashAggregateExec", "SortAggregateExec")
SCANS = ("FileSourceScanExec", "BatchScanExec", "RowDataSourceScanExec")


def _children(node):
    kids = node.children()
    return [kids.apply(i) for i in range(kids.size())]


def _subplans(node):
    """Children plus the plans of subquery expressions (scalar subqueries)."""
    out = _children(node)
    subs = node.subqueries()
    out += [subs.apply(i) for i in range(subs.size())]
    return out


def single_partition_over_raw_rows(df: DataFrame) -> list[str]:
    """Single-partition exchanges with a path down to a file scan that meets
    no aggregate first (i.e. raw rows gathered into one task)."""
    root = df.select("*")._jdf.queryExecution().executedPlan()
    found = []

    def unreduced(node) -> bool:
        name = node.getClass().getSimpleName()
        if name in AGGREGATES:
            return False
        if name in SCANS:
            return True
        return any(unreduced(c) for c in _subplans(node))

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec" and "SinglePartition" in node.outputPartitioning().toString():
            if any(unreduced(c) for c in _children(node)):
                found.append(node.simpleString(200))
        if name == "AdaptiveSparkPlanExec":
            walk(node.initialPlan())
            return
        for c in _subplans(node):
            walk(c)

    walk(root)
    return found
