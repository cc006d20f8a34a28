"""Depth-first order of what many roots reach, without walking it one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import written

#: Rounds of one job, and how many roots are dealt by root: fewer are dealt by root and node, so that none fills a task.
ROUNDS, MANY = 6, 4096


def depth_first(roots: DataFrame, edges: DataFrame, most: int | None = None, rounds: int = ROUNDS, many: int = MANY) -> DataFrame:
    """root, node, at: where a depth-first walk from each root (root) first comes to a node, as the path of places that leads there.

    edges: node, other, place. A walk takes each node once, along the edge that comes first; nodes at `most` steps or fewer are gone on
    from. So a node's path is the smallest of its predecessors' paths with the edge's place behind. Paths are taken anew
    from the last ones, a round at a time, until none changes; the smallest ones settle first, so rounds end. One row is held for each
    node of a root, whatever the number of ways to it. A job runs `rounds` of them on rows that stay where their root is; the next one
    takes only roots of which a path changed in the last round. What a root itself leads to is looked up once and
    kept in its row (_own), so later rounds ask only edges of nodes that are led to.
    """
    links = written(edges.filter("other IS NOT NULL").groupBy("node", "other").agg(F.min(F.col("place").cast("int")).alias("place")))
    begin = roots.select("root").distinct()
    found = begin.select("root", F.col("root").alias("node"), F.array().cast("array<int>").alias("at"))
    near = begin.join(links, F.col("root") == F.col("node")).filter("other <> root")
    open_ = written(near.select("root", F.col("other").alias("node"), F.array("place").alias("at"), F.col("place").alias("_own")))
    # beside the edges of what is led to, one without a place that keeps the node itself
    inner = links.join(links.select(F.col("other").alias("node")).distinct(), "node", "left_semi")
    keep = inner.select("node").distinct().select("node", F.col("node").alias("other"), F.lit(None).cast("int").alias("place"))
    onward = written(inner.unionByName(keep)).withColumnRenamed("node", "_n")
    by = ["root"] if begin.limit(many).count() == many else ["root", "node"]
    kept = F.col("place").isNull()
    led = ~kept & (F.col("other") != F.col("root"))
    if most is not None:
        led &= F.size("at") <= most
    at = F.when(~kept, F.concat("at", F.array("place"))).when(F.col("_own").isNotNull(), F.array("_own"))
    # a fixed number of tasks: paths are many times what a root begins with
    parts = int(roots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        held = open_.repartition(parts, *by)
        for k in range(rounds):
            last = k == rounds - 1
            step = held.join(onward, F.col("node") == F.col("_n"), "left").filter(led | (kept if last else kept & F.col("_own").isNotNull()))
            step = step.select("root", F.coalesce("other", "node").alias("node"), at.alias("at"), F.when(kept, F.col("_own")).alias("_own"), F.when(kept, F.col("at")).alias("_was"))
            held = step.groupBy("root", "node").agg(F.min("at").alias("at"), F.max("_own").alias("_own"), *([F.max("_was").alias("_was")] if last else []))
        new = written(held)
        moved = written(new.filter(~F.col("at").eqNullSafe(F.col("_was"))).select("root").distinct())
        if moved.isEmpty():
            return found.unionByName(new.select("root", "node", "at"))
        found = found.unionByName(new.select("root", "node", "at").join(moved, "root", "left_anti"))
        open_ = new.filter("at IS NOT NULL").drop("_was").join(moved, "root", "left_semi")
