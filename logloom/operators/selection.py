"""Which tests a change can reach: callers, importers, and the union of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as fn
from .graph import written, reach


def prefix_matched(imports: DataFrame, targets: DataFrame, imported: str = "imported", target: str = "target") -> DataFrame:
    """Pairs where the target is what is imported or lies below it at a dot.

    Every dotted prefix of a target is a key of an equi-join: pkg.api matches pkg.api.client, not pkg.apiclient.
    """
    keys = targets.select("*", F.explode(fn.dotted_prefixes(F.col(target))).alias("_key"))
    return imports.join(keys, F.col(imported) == F.col("_key")).drop("_key")


def is_test(name: Column, path: Column, root: str = "tests") -> Column:
    """Whether a function is a test: its name says so and a folder above its file is the tests' root."""
    return F.startswith(name, F.lit("test_")) & F.array_contains(F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), root)


def node_id(path: Column, class_name: Column, name: Column) -> Column:
    return F.concat_ws("::", path, F.nullif(class_name, F.lit("")), name)


def by_callers(contacts: DataFrame, calls: DataFrame, most: int = 4) -> DataFrame:
    """fid, depth, origin of functions that call a contact point (fid) in at most `most` steps; contact points excluded."""
    back = calls.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = reach(contacts.select(F.col("fid").alias("id")), back, most, origin=True)
    return found.filter("depth > 0").select(F.col("id").alias("fid"), "depth", "origin")


def by_imports(modules: DataFrame, imports: DataFrame, most: int = 10) -> DataFrame:
    """module, depth, origins of files that import one of `modules` (module), directly or through other files.

    imports: file_path, module (of the file), imported. A file is reached once. Its origins are those of the frontier
    modules that its first matching import, by name, matches.
    """
    seen = modules.select("module").distinct().select("module", F.lit(0).alias("depth"), F.array("module").alias("origins"))
    frontier = seen
    for depth in range(1, most + 1):
        hits = prefix_matched(imports.select("file_path", F.col("module").alias("importer"), "imported"), frontier.select(F.col("module").alias("target"), "origins"))
        open_ = hits.join(seen.select(F.col("module").alias("importer")), "importer", "left_anti")
        first = open_.withColumn("_first", F.min("imported").over(Window.partitionBy("importer"))).filter("imported = _first")
        new = first.groupBy(F.col("importer").alias("module")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("origins")))).alias("origins")).select("module", F.lit(depth).alias("depth"), "origins")
        frontier = written(new)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")


def union(callers: DataFrame, importers: DataFrame, most: int) -> DataFrame:
    """fid, origins, strategy, truncated: both selections (fid, origin), once each, the first `most` by fid.

    The strategy is the one that found more (callers if even), manual if neither found anything.
    """
    both = callers.select("fid", "origin", F.lit(1).alias("c")).unionByName(importers.select("fid", "origin", F.lit(0).alias("c")))
    sizes = both.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("nc"), F.coalesce(F.sum(1 - F.col("c")), F.lit(0)).alias("ni"), F.count_distinct("fid").alias("all"))
    chosen = both.groupBy("fid").agg(F.array_sort(F.collect_set("origin")).alias("origins")).orderBy("fid").limit(max(0, most))
    strategy = F.when((F.col("nc") == 0) & (F.col("ni") == 0), "manual").when(F.col("nc") >= F.col("ni"), "callers").otherwise("imports")
    return chosen.crossJoin(F.broadcast(sizes.select(strategy.alias("strategy"), (F.col("all") > max(0, most)).alias("truncated"))))
