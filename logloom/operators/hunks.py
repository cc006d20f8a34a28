"""Patches whose hunk headers are set to where their lines stand in the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import written

# How the lines of a patch begin.
HUNK, FILE, BREAKS = r"^@@", r"^\+\+\+ (?:b/)?(\S+)", r"^(?:diff --git |--- |\+\+\+ |[^ +\-\\])"
# How the lines of a file end, and what is cut from a line's end before it is compared.
ENDS, BLANKS = r"\r?\n", " \t\n\x0b\f\r"


def _trimmed(line: Column, blanks: str) -> Column:
    return F.rtrim(line, F.lit(blanks))


def hunks(patches: DataFrame, key: str, diff: str = "diff", blanks: str = BLANKS) -> DataFrame:
    """key, hunk (from 1), n (line of its header, from 0), path, old (lines that it expects, ends trimmed), new_count.

    A hunk's body ends at the next hunk or file, or at a line that belongs to no hunk; the file is the last one named above.
    """
    lines = patches.select(key, F.posexplode(F.split(diff, "\n")).alias("n", "l"))
    order = Window.partitionBy(key).orderBy("n")
    head = F.col("l").rlike(HUNK)
    marked = lines.withColumn("hunk", F.sum(head.cast("int")).over(order)).withColumn("_break", F.max((F.col("l").rlike(BREAKS) & ~head).cast("int")).over(Window.partitionBy(key, "hunk").orderBy("n")))
    # a file is named outside of hunks: what looks so in a body ends it
    named = marked.withColumn("path", F.last(F.when(F.col("l").rlike(FILE), F.regexp_extract("l", FILE, 1)), ignorenulls=True).over(order))
    own = named.filter("hunk > 0 AND _break = 0")
    first = F.substring("l", 1, 1)
    body = ~F.col("l").rlike(HUNK)
    old = F.transform(F.array_sort(F.collect_list(F.when(body & first.isin(" ", "-"), F.struct("n", _trimmed(F.expr("substring(l, 2)"), blanks).alias("l"))))), lambda s: s["l"])
    return own.groupBy(key, "hunk").agg(F.min("n").alias("n"), F.min_by("path", "n").alias("path"), old.alias("old"), F.count_if(body & first.isin(" ", "+")).cast("int").alias("new_count"))


def found(wanted: DataFrame, sources: DataFrame, keys: list[str], ends: str = ENDS, blanks: str = BLANKS) -> DataFrame:
    """keys, start (from 1) of hunks (keys, path, old) whose old lines stand in their file (sources: path, text) in one place only.

    A hunk meets the lines of its file that equal its rarest one there, and what stands around each of them is compared:
    a join on lines, not on places. Lines are compared without white space at their ends, which are cut once for each file: its lines are written.
    """
    lines = F.transform(F.split(F.regexp_replace("text", rf"{ends}\z", ""), ends), lambda l: _trimmed(l, blanks))
    held = written(sources.select("path", lines.alias("_lines")).filter(F.size("_lines") > 0))
    every = held.select("path", F.posexplode("_lines").alias("at", "line"))
    counts = every.groupBy("path", "line").agg(F.count("*").alias("_n"))
    asked = wanted.filter(F.size("old") > 0).select(*keys, "path", "old")
    rare = asked.select(*keys, "path", "old", F.posexplode("old").alias("i", "line")).join(counts, ["path", "line"], "left")
    rare = rare.groupBy(*keys, "path", "old").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("c"), "i", "line")).alias("r")).filter("r.c > 0")
    places = rare.select(*keys, "path", "old", F.col("r.i").alias("i"), F.col("r.line").alias("line")).join(every, ["path", "line"]).withColumn("start", F.col("at") - F.col("i")).filter("start >= 0")
    met = places.join(held, "path").filter(F.slice("_lines", F.col("start") + 1, F.size("old")) == F.col("old"))
    return met.groupBy(*keys).agg(F.count("*").alias("c"), F.min("start").alias("s")).filter("c = 1").select(*keys, (F.col("s") + 1).alias("start"))


def anchored(patches: DataFrame, sources: DataFrame, key: str = "id", diff: str = "diff", ends: str = ENDS, blanks: str = BLANKS) -> DataFrame:
    """patches with the headers of their hunks rewritten as `@@ -start,old +start,new @@`, and `moved`, how many were.

    sources: path (as after `+++ b/`), text. A hunk without old lines, whose file isn't known, or whose lines are absent or stand there more
    than once keeps its header, so that the patch fails where it is applied instead of changing another place. An
    empty patch stays as it is, a null one null. Patches differ in `key`, sources in path.
    """
    parts = written(hunks(patches, key, diff, blanks))
    starts = found(parts.filter("path IS NOT NULL"), sources, [key, "hunk"], ends, blanks)
    header = F.concat(F.lit("@@ -"), F.col("start").cast("string"), F.lit(","), F.size("old").cast("string"), F.lit(" +"), F.col("start").cast("string"), F.lit(","), F.col("new_count").cast("string"), F.lit(" @@"))
    new = parts.join(starts, [key, "hunk"]).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("n", header.alias("h")))).alias("_new"))
    out = patches.join(new, key, "left")
    lines = F.transform(F.split(diff, "\n"), lambda l, n: F.coalesce(F.try_element_at("_new", n), l))
    return out.withColumn(diff, F.when(F.col("_new").isNull(), F.col(diff)).otherwise(F.array_join(lines, "\n"))).withColumn("moved", F.coalesce(F.size("_new"), F.lit(0))).withColumn("moved", F.greatest("moved", F.lit(0))).drop("_new")
