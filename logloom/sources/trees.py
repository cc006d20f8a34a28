"""Source trees: whole files under a folder, pruned folders left out, and methods that an index has missed."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Folders and endings of a source tree, what begins a method, and lengths of its source.
PRUNED = ["web-app", "target", "build", ".gradle", "node_modules", "test"]
ENDINGS = ["groovy", "java"]
METHOD = (
    r"^[ \t]*(?:(?:public|private|protected|static|final|synchronized|abstract)\s+)*"
    r"(?:def|void|boolean|int|long|String|Map|List|Set|Object|Boolean|Integer|Long|Double|Float|[A-Z]\w*(?:<[^>]+>)?)\s+([a-z]\w*)\s*\("
)
SHORTEST, LONGEST = 20, 5000


def read_tree(spark: SparkSession, top: str, endings: list[str] = ENDINGS, pruned: list[str] = PRUNED) -> DataFrame:
    """path, text of whole files below `top` with one of the endings and in no pruned folder (at any depth below it).

    Folders are left out by the file's path, before a file is opened. Files are read by tasks, one row each.
    """
    glob = "*." + (endings[0] if len(endings) == 1 else "{" + ",".join(endings) + "}")
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(top, wholetext=True)
    path = F.col("_metadata.file_path")
    inside = re.sub(r"^[a-z]+:/*", "", top.rstrip("/"))
    below = F.element_at(F.split(path, re.escape(inside)), -1)
    if pruned:
        files = files.filter(~below.rlike("/(?:" + "|".join(map(re.escape, pruned)) + ")/"))
    return files.select(path.alias("path"), F.col("value").alias("text"))


def methods(files: DataFrame, pattern: str = METHOD) -> DataFrame:
    """path, start_line (from 1), name, source of the methods in files (path, text), by a line that begins one.

    A source goes from its line to the brace that closes the first one opened from there on; it has LONGEST characters
    where that is never closed, and none where none is opened. Braces are numbered by running sums over each file's braces,
    and closed ones are met by equal depth.
    """
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("n", "l"))
    order = Window.partitionBy("path").orderBy("n")
    placed = lines.withColumn("at", F.coalesce(F.sum(F.length("l") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    defs = placed.filter(F.col("l").rlike(pattern)).select("path", "n", "at", F.regexp_extract("l", pattern, 1).alias("name"))
    braces = placed.select("path", "at", F.posexplode(F.split("l", "")).alias("i", "c")).filter("c IN ('{', '}')").select("path", (F.col("at") + F.col("i")).alias("at"), F.when(F.col("c") == "{", 1).otherwise(-1).alias("d"))
    deep = braces.withColumn("depth", F.sum("d").over(Window.partitionBy("path").orderBy("at")))
    # an opening brace is closed by the next one that brings the depth back to what it was before
    level = F.when(F.col("d") == 1, F.col("depth") - 1).otherwise(F.col("depth"))
    later = Window.partitionBy("path", "level").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    blocks = deep.withColumn("level", level).withColumn("end", F.min(F.when(F.col("d") == -1, F.col("at"))).over(later)).filter("d = 1").select("path", "at", "end")
    both = blocks.select("path", "at", F.struct("at", "end").alias("block"), F.lit(1).alias("k")).unionByName(defs.select("path", "at", F.lit(0).alias("k"), "n", "name"), allowMissingColumns=True)
    ahead = Window.partitionBy("path").orderBy("at", "k").rowsBetween(1, Window.unboundedFollowing)
    met = both.withColumn("next", F.first("block", ignorenulls=True).over(ahead)).filter("k = 0")
    whole = met.join(files.select("path", "text"), "path")
    size = F.when(F.col("next").isNull(), 0).when(F.col("next.end").isNull(), LONGEST).otherwise(F.col("next.end") - F.col("at") + 1)
    return whole.select("path", (F.col("n") + 1).alias("start_line"), "name", F.call_function("substring", F.col("text"), (F.col("at") + 1).cast("int"), size.cast("int")).alias("source"))


def missing_methods(files: DataFrame, functions: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """path, name, start_line, source of methods that `functions` (path, name) don't have: the first of a name in a file, of those long enough."""
    found = methods(files).filter(F.length("source") >= shortest)
    lost = found.join(functions.select("path", "name").distinct(), ["path", "name"], "left_anti")
    return lost.groupBy("path", "name").agg(F.min(F.struct("start_line", "source")).alias("m")).select("path", "name", "m.start_line", "m.source")
