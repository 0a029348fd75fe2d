"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of numbered nodes to (node, component), the smallest node that is reachable.

    Each round every node takes the smallest component of itself and its neighbours and then that
    component's own; rounds end when nothing changes. Every round is a written table. Nodes without
    links are not listed; no links give no rows.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    edges = stored(both.distinct(), "edges")
    state = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), "components")
    while True:
        seen = edges.join(state, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        lower = state.join(seen, F.col("node") == F.col("a")).select(
            "node", F.col("component").alias("before"), F.least("component", "near").alias("component")
        )
        jump = state.select(F.col("node").alias("via"), F.col("component").alias("beyond"))
        jumped = lower.join(jump, F.col("component") == F.col("via")).select(
            "node", F.least("component", "beyond").alias("component"), "before"
        )
        state = stored(jumped, "components")
        if state.filter("component <> before").isEmpty():
            return state.select("node", "component")
        state = state.select("node", "component")
