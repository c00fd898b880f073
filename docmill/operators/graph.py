"""Walks over edges of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from docmill.session import cut_lineage


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node): all nodes that edges (source, target) lead to from ``roots`` (node), the roots among them.

    Breadth first: each step follows the edges of the nodes found last and keeps what is new. Every step is written, so
    the plan stays short; the driver only learns whether there was anything new.
    """
    edges = cut_lineage(edges.select("source", "target").distinct())
    found = last = cut_lineage(roots.select("node").distinct())
    while not last.isEmpty():
        step = last.join(edges, last["node"] == edges["source"]).select(edges["target"].alias("node")).distinct()
        last = cut_lineage(step.join(found, "node", "left_anti"))
        found = cut_lineage(found.unionByName(last))
    return found
