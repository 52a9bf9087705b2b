"""Connected components of an edge table by hooking and shortcutting, all in joins.

Every vertex holds a parent no larger than itself. A round lets it take the smallest
grandparent seen at its neighbours, passes that on to its own parent (hooking), and jumps to
its grandparent (shortcutting), so the rounds grow with the logarithm of a component's
diameter. A parent with many children meets them by broadcast (``keyed_join``), so that no task
gets all of a large component. No edge list, label or component reaches the driver: only a count of changes does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_join, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)``; component is the smallest node reachable.

    Repeated edges, loops and an empty table are fine; nodes without an edge do not appear,
    and edges with a null end are ignored.
    """
    pairs = edges.where("a is not null and b is not null")
    both = materialize(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    parent = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("p")), "parents")
    while True:
        up = parent.select(F.col("node").alias("p"), F.col("p").alias("gp"))
        jumped = keyed_join(parent, up, "p").select("node", "p", "gp")
        seen = (
            both.join(jumped.select(F.col("node").alias("b"), "gp"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("gp").alias("m"))
        )
        step = materialize(jumped.join(seen, "node").select("node", "p", F.least("gp", "m").alias("q"), F.lit(False).alias("x")), "step")
        hooks = step.groupBy(F.col("p").alias("node")).agg(F.min("q").alias("h"))
        parent = materialize(
            step.join(hooks, "node", "left").select("node", F.least("q", "h").alias("p"), (F.least("q", "h") < F.col("p")).alias("moved")),
            "parents",
        )
        if parent.where("moved").limit(1).count() == 0:
            return parent.select("node", F.col("p").alias("component"))
        parent = parent.select("node", "p")
