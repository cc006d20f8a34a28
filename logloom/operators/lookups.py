"""Look-ups in the code graph that the tools ask for, each for many functions, files or classes at once."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import graph


def relative(path: Column, repo: str) -> Column:
    """A path behind the last segment that is the repository's name; without one the path as it is."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    own = f"^(?:.*/)?{re.escape(repo)}(?:/|$)"
    return F.when(plain.rlike(own), F.regexp_replace(plain, own, "")).otherwise(path)


def source_slice(functions: DataFrame, most: int = 1000, offset: int = 0, source: str = "source") -> DataFrame:
    """fid, info, chunk: `most` characters of each source from `offset`, and a line that tells file, id and size."""
    text = F.coalesce(F.nullif(F.col(source), F.lit("")), F.lit("No source available"))
    total = F.length(text)
    shown = F.when(F.lit(offset > 0) | (total > offset + most), F.concat(F.lit(f" | Showing: {offset}-"), F.least(total, F.lit(offset + most)).cast("string"))).otherwise("")
    info = F.concat(F.lit("File: "), F.coalesce("path", F.lit("")), F.lit(" | fid="), F.col("fid").cast("string"), F.lit(" | Total: "), total.cast("string"), F.lit(" chars"), shown)
    return functions.select("fid", info.alias("info"), F.substring(text, offset + 1, most).alias("chunk"))


def import_edges(imports: DataFrame, repo: str) -> DataFrame:
    """file_path (relative), imported: of the files (path, imported) of a repository."""
    return imports.filter(graph.in_repo(F.col("path"), repo)).select(relative(F.col("path"), repo).alias("file_path"), F.coalesce("imported", F.lit("")).alias("imported"))


def functions_in(functions: DataFrame, file_path: str, repo: str) -> DataFrame:
    """fid, name, file_path (relative), class_name, start_line, end_line of the functions whose path holds `file_path`."""
    found = functions.filter(graph.in_repo(F.col("path"), repo) & F.contains("path", F.lit(file_path)))
    return found.select("fid", "name", relative(F.col("path"), repo).alias("file_path"), "class_name", "start_line", "end_line")


def contact_points(functions: DataFrame, symbol: str, repo: str, most: int = 15) -> DataFrame:
    """symbol, fid, name, file_path: at most `most` functions of a repository that name or mention a symbol, names first."""
    hits = graph.mentions(functions.filter(graph.in_repo(F.col("path"), repo)), symbol, most)
    return hits.select(F.lit(symbol).alias("symbol"), "fid", "name", relative(F.col("path"), repo).alias("file_path"))


def inheritance(classes: DataFrame, inherits: DataFrame) -> DataFrame:
    """class_name, parents, children (sorted, each once; empty where there are none) from edges child, parent."""
    edges = inherits.select("child", "parent").distinct()
    up = edges.groupBy(F.col("child").alias("class_name")).agg(F.array_sort(F.collect_list("parent")).alias("parents"))
    down = edges.groupBy(F.col("parent").alias("class_name")).agg(F.array_sort(F.collect_list("child")).alias("children"))
    none = F.array().cast("array<string>")
    joined = classes.select("class_name").distinct().join(up, "class_name", "left").join(down, "class_name", "left")
    return joined.select("class_name", F.coalesce("parents", none).alias("parents"), F.coalesce("children", none).alias("children"))


def tables_touched(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """fid, reads, writes (sorted names of tables) from edges fid, kind (READS or WRITES), table."""
    names = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("table"))))
    own = edges.select("fid", "kind", "table").distinct().groupBy("fid").agg(names("READS").alias("reads"), names("WRITES").alias("writes"))
    none = F.array().cast("array<string>")
    return functions.select("fid").join(own, "fid", "left").select("fid", F.coalesce("reads", none).alias("reads"), F.coalesce("writes", none).alias("writes"))


def class_info(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """class_name, methods, uses: how many functions a class has and how many other classes they call."""
    owner = functions.select("fid", "class_name")
    pairs = calls.join(owner.withColumnRenamed("fid", "src"), "src").join(owner.select(F.col("fid").alias("dst"), F.col("class_name").alias("other")), "dst")
    uses = pairs.filter("other <> class_name").groupBy("class_name").agg(F.count_distinct("other").alias("uses"))
    return functions.groupBy("class_name").agg(F.count("*").alias("methods")).join(uses, "class_name", "left").fillna(0, ["uses"])


def templates_of(templates: DataFrame, functions: DataFrame) -> DataFrame:
    """fid, name, text, level, line of the templates that the given functions emit."""
    return templates.select("fid", "text", "level", "line").join(functions.select("fid", "name").distinct(), "fid")


def trie_templates(templates: DataFrame, functions: DataFrame, qualified: bool = True) -> DataFrame:
    """fid, frags, fname, line: templates as the matcher takes them; `qualified` names hold the class, others are bare."""
    name = F.concat_ws(".", "class_name", "name") if qualified else F.col("name")
    told = templates.filter(F.length(F.get("frags", F.lit(0))) > 0).select("fid", "frags", F.coalesce("line", F.lit(0)).alias("line"))
    return told.join(functions.select("fid", name.alias("fname")), "fid")


def flows_of(functions: DataFrame, flows: DataFrame) -> DataFrame:
    """fid, flow_fid, flow: a function's own flow, else that of the smallest fid with its name."""
    own = flows.select("fid", "flow")
    named = flows.filter(F.col("flow").isNotNull()).groupBy("name").agg(F.min(F.struct("fid", "flow")).alias("_n"))
    both = functions.select("fid", "name").join(own, "fid", "left").join(named, "name", "left")
    return both.select("fid", F.when(F.col("flow").isNotNull(), F.col("fid")).otherwise(F.col("_n.fid")).alias("flow_fid"), F.coalesce("flow", "_n.flow").alias("flow"))


def class_histogram(classified: DataFrame) -> DataFrame:
    """node_class, n."""
    return classified.groupBy("node_class").agg(F.count("*").alias("n"))


def supplemented(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """src, dst, reason of the synthetic calls by property, inner class and token, a pair once for each reason."""
    parts = [graph.property_calls(functions, calls), graph.inner_calls(functions, calls), graph.token_calls(functions, calls)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("src", "dst", "reason")


def called(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """Call nodes of flows with the targets that CALLS edges tell; calls that no node shows become nodes behind the others.

    nodes: fid, node_id, type, call_target, call_target_id. calls: src, dst, name. Of several edges to one name the smallest counts.
    """
    told = calls.groupBy(F.col("src").alias("fid"), "name").agg(F.min("dst").alias("_dst"))
    is_call = F.col("type") == "call"
    target = F.when(is_call, F.substring_index("call_target", ".", -1))
    filled = nodes.withColumn("name", target).join(told, ["fid", "name"], "left").withColumn("call_target_id", F.coalesce("call_target_id", "_dst")).drop("_dst")
    shown = filled.filter(is_call).select("fid", "name").distinct()
    last = nodes.groupBy("fid").agg(F.max("node_id").alias("_last"))
    lost = told.join(shown, ["fid", "name"], "left_anti").join(last, "fid", "left")
    place = F.row_number().over(Window.partitionBy("fid").orderBy("name"))
    added = lost.select("fid", (F.coalesce("_last", F.lit(-1)) + place).alias("node_id"), F.lit("call").alias("type"), F.col("name").alias("call_target"), F.col("_dst").alias("call_target_id"))
    return filled.select("fid", "node_id", "type", "call_target", "call_target_id").unionByName(added)
