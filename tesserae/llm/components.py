"""Connected components of a link table by hooking and contraction.

Every round each node hooks to its smallest neighbour, chains of hooks are shortened by pointer
jumping, and the links are rewritten between the roots; links inside one root go.  Nothing but row
counts reaches the driver, and each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import Workspace


def roots(ws: Workspace, parent: DataFrame) -> DataFrame:
    """Follows ``node -> parent`` (parent < node, or a node without a row) to the end."""
    while True:
        up = parent.select(F.col("node").alias("p_node"), F.col("parent").alias("p_parent"))
        nxt = parent.join(up, F.col("parent") == F.col("p_node"), "left")
        nxt = ws.put(nxt.select("node", F.coalesce("p_parent", "parent").alias("parent"), F.col("p_parent").isNotNull().alias("moved")), "jump")
        moved = nxt.where("moved").limit(1).count()
        ws.drop(parent)
        parent = nxt
        if not moved:
            return parent


def components(ws: Workspace, links: DataFrame) -> DataFrame:
    """``node, label`` for every node with a link, where label is the smallest node reachable.  ``links`` has a, b."""
    links = ws.put(links.select("a", "b").where("a <> b"), "links")
    labels: DataFrame | None = None
    while links.limit(1).count():
        both = links.select(F.col("a").alias("node"), "b").unionAll(links.select(F.col("b").alias("node"), F.col("a").alias("b")))
        hook = both.groupBy("node").agg(F.min("b").alias("parent")).where("parent < node")
        up = roots(ws, ws.put(hook, "hook"))
        up = up.select("node", "parent")
        ua, ub = (up.select(F.col("node").alias(f"n{x}"), F.col("parent").alias(f"p{x}")) for x in "ab")
        moved = links.join(ua, F.col("a") == F.col("na"), "left").join(ub, F.col("b") == F.col("nb"), "left")
        moved = moved.select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b")).where("a <> b")
        moved = moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        nodes = both.select("node")
        if labels is None:
            new = nodes.distinct().join(ua, F.col("node") == F.col("na"), "left").select("node", F.coalesce("pa", "node").alias("label"))
        else:
            new = labels.join(ua, F.col("label") == F.col("na"), "left").select("node", F.coalesce("pa", "label").alias("label"))
        new = ws.put(new, "labels")
        nxt = ws.put(moved, "links")
        ws.drop(links, *([labels] if labels is not None else []))
        links, labels = nxt, new
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("label"))
