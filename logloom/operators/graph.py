"""The code graph: look-ups, repairs and bounded traversals over label and edge tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as fn


def in_repo(path: Column, repo: str) -> Column:
    """Whether a path lies in a repository: its name is a whole segment."""
    return F.contains(F.concat(F.lit("/"), path, F.lit("/")), F.lit(f"/{repo}/"))


def resolve(functions: DataFrame, name: str, class_hint: str = "") -> DataFrame:
    """Functions of a name, those of the hinted class alone if there are any."""
    found = functions.filter(F.col("name") == name).withColumn("_p", F.when(F.lit(class_hint != "") & F.contains("path", F.lit(class_hint)), 0).otherwise(1))
    return found.withColumn("_best", F.min("_p").over(Window.partitionBy("name"))).filter("_p = _best").drop("_p", "_best")


def neighbours(calls: DataFrame, functions: DataFrame, of: DataFrame, direction: str = "callers") -> DataFrame:
    """fid (of `of`), other, name, class_name: distinct callers or callees with the class that owns them."""
    here, there = ("dst", "src") if direction == "callers" else ("src", "dst")
    pairs = calls.select(F.col(here).alias("fid"), F.col(there).alias("other")).distinct().join(of.select("fid").distinct(), "fid", "left_semi")
    return pairs.join(functions.select(F.col("fid").alias("other"), "name", "class_name"), "other")


def mentions(functions: DataFrame, pattern: str, most: int, short: str = "") -> DataFrame:
    """Functions by name first, then by source, once each; at most `most` in order of hit and fid."""
    named = functions.filter(F.contains("name", F.lit(short or pattern))).withColumn("prio", F.lit(0))
    sourced = functions.filter(F.contains("source", F.lit(pattern))).withColumn("prio", F.lit(1))
    best = named.unionByName(sourced).groupBy("fid").agg(F.min("prio").alias("prio"))
    return best.join(functions, "fid").orderBy("prio", "fid").limit(most)


def degrees(calls: DataFrame) -> DataFrame:
    """fid, in_degree, out_degree over distinct edges."""
    edges = calls.select("src", "dst").distinct()
    out = edges.groupBy(F.col("src").alias("fid")).agg(F.count("*").alias("out_degree"), F.lit(0).cast("bigint").alias("in_degree"))
    into = edges.groupBy(F.col("dst").alias("fid")).agg(F.lit(0).cast("bigint").alias("out_degree"), F.count("*").alias("in_degree"))
    return out.unionByName(into).groupBy("fid").agg(F.sum("in_degree").alias("in_degree"), F.sum("out_degree").alias("out_degree"))


def node_class(in_degree: Column, out_degree: Column, logs: Column) -> Column:
    """entry, leaf, utility, anchor or internal: the first that fits."""
    return F.when(in_degree == 0, "entry").when(out_degree == 0, "leaf").when(in_degree >= 10, "utility").when((in_degree <= 3) & logs, "anchor").otherwise("internal")


def classified(functions: DataFrame, calls: DataFrame, logs: Column) -> DataFrame:
    """functions with in_degree, out_degree and node_class."""
    both = functions.join(degrees(calls), "fid", "left").fillna(0, ["in_degree", "out_degree"])
    return both.withColumn("node_class", node_class(F.col("in_degree"), F.col("out_degree"), logs))


def func_map(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """functions with sorted lists of distinct callers and callees."""
    edges = calls.select("src", "dst").distinct()
    callers = edges.groupBy(F.col("dst").alias("fid")).agg(F.array_sort(F.collect_list("src")).alias("callers"))
    callees = edges.groupBy(F.col("src").alias("fid")).agg(F.array_sort(F.collect_list("dst")).alias("callees"))
    return functions.join(callers, "fid", "left").join(callees, "fid", "left")


def missing_members(classes: DataFrame, functions: DataFrame, has_method: DataFrame) -> DataFrame:
    """(class_name, fid) of the same path that no HAS_METHOD edge joins yet.

    Functions are made distinct, and know their classes, before they meet the classes of their path; what they meet isn't held again.
    """
    known = has_method.groupBy("fid").agg(F.collect_set("class_name").alias("_known"))
    own = functions.select("fid", "path").groupBy("fid").agg(F.collect_set("path").alias("_paths")).join(known, "fid", "left")
    pairs = own.select("fid", "_known", F.size("_paths").alias("_n"), F.explode("_paths").alias("path")).join(classes.select("class_name", "path").distinct(), "path")
    new = pairs.filter(~F.coalesce(F.array_contains("_known", F.col("class_name")), F.lit(False)))
    # only a function of several paths can meet a class twice
    return new.filter("_n = 1").select("class_name", "fid").unionByName(new.filter("_n > 1").select("class_name", "fid").distinct())


def injected_calls(nodes: DataFrame, functions: DataFrame, injects: DataFrame) -> DataFrame:
    """CALLS edges from `field.method` call nodes of a class to the method of the class that is injected there."""
    target = nodes.filter((F.col("type") == "call") & F.contains("call_target", F.lit("."))).select("fid", F.substring_index("call_target", ".", 1).alias("field_name"), fn.method_name(F.col("call_target")).alias("method"))
    owner = functions.select("fid", "class_name")
    callee = functions.select(F.col("class_name").alias("injected"), F.col("name").alias("method"), F.col("fid").alias("dst"))
    return target.join(owner, "fid").join(injects, ["class_name", "field_name"]).join(callee, ["injected", "method"]).select(F.col("fid").alias("src"), "dst", F.lit(True).alias("synthetic"), F.lit("inject").alias("reason")).filter("src <> dst").distinct()


def _first(pairs: DataFrame, by: str, n: int) -> DataFrame:
    """Distinct pairs (src, by) with the n smallest src of each value; tasks leave the others before the shuffle."""
    ranked = pairs.withColumn("_r", F.dense_rank().over(Window.partitionBy(by).orderBy("src")))
    return ranked.filter(F.col("_r") <= n).select("src", by).distinct()


def token_calls(functions: DataFrame, calls: DataFrame, shortest: int = 6, most: int = 10, token: str = r"\.(\w+)\(") -> DataFrame:
    """Synthetic edges to functions without a caller: from sources that call `.name(`, at most `most` for each, by fid.

    Sources are cut into called names once and joined by name: no comparison of every source with every name. Of a name only the
    first `most` + 1 sources can count for any function of that name (one may be the function itself), so only these are joined.
    """
    orphans = functions.join(calls.select(F.col("dst").alias("fid")).distinct(), "fid", "left_anti").filter((F.length("name") >= shortest) & ~F.col("name").rlike("^(get|set)"))
    used = functions.select(F.col("fid").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit(token), F.lit(1)))).alias("name"))
    pairs = _first(used, "name", most + 1).join(orphans.select("name", F.col("fid").alias("dst")), "name").filter("src <> dst")
    ranked = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("dst").orderBy("src")))
    return ranked.filter(F.col("_r") <= most).select("src", "dst", F.lit(True).alias("synthetic"), F.lit("token").alias("reason"))


def property_calls(functions: DataFrame, calls: DataFrame, most: int = 20) -> DataFrame:
    """Synthetic edges to getters and setters (getX, setX) from sources that hold the property's name as a word.

    A caller that already calls a function of that name gets none; at most `most` for each accessor, by fid. Of a name only the
    first `most` + 1 callers are joined with its accessors, as none needs more.
    """
    accessor = functions.filter(F.col("name").rlike("^(get|set)[A-Z]") & (F.length("name") > 3)).select(F.col("fid").alias("dst"), F.col("name").alias("accessor"), F.concat(F.lower(F.substring("name", 4, 1)), F.expr("substring(name, 5)")).alias("property"))
    words = functions.select(F.col("fid").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit(r"\w+"), F.lit(0)))).alias("property"))
    named = calls.join(functions.select(F.col("fid").alias("dst"), F.col("name").alias("accessor")), "dst").select("src", "accessor").distinct()
    open_ = words.join(accessor.select("accessor", "property").distinct(), "property").join(named, ["src", "accessor"], "left_anti")
    pairs = _first(open_.select("src", "accessor"), "accessor", most + 1).join(accessor, "accessor").filter("src <> dst")
    ranked = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("dst").orderBy("src")))
    return ranked.filter(F.col("_r") <= most).select("src", "dst", F.lit(True).alias("synthetic"), F.lit("property").alias("reason"))


def inner_calls(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Synthetic edges from builder functions (with..., build) to functions of their file that they call by name."""
    builders = functions.filter(F.col("name").rlike("^with|^build$"))
    used = builders.select(F.col("fid").alias("src"), "path", F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit(r"\.([a-z]\w*)\("), F.lit(1)))).alias("name"))
    pairs = used.join(functions.select(F.col("fid").alias("dst"), "path", "name"), ["path", "name"]).filter("src <> dst")
    return pairs.join(calls.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select("src", "dst", F.lit(True).alias("synthetic"), F.lit("inner").alias("reason")).distinct()


def call_targets(nodes: DataFrame, functions: DataFrame) -> DataFrame:
    """nodes with call_target_id: a function whose name is unique, else the one that class.method names."""
    unique = functions.groupBy("name").agg(F.count("*").alias("_n"), F.min("fid").alias("_by_name")).filter("_n = 1").select(F.col("name").alias("_m"), "_by_name")
    full = F.concat(F.lower(F.substring("class_name", 1, 1)), F.expr("substring(class_name, 2)"), F.lit("."), "name")
    qualified = functions.groupBy(full.alias("_q")).agg(F.count("*").alias("_k"), F.min("fid").alias("_by_class")).filter("_k = 1").select("_q", "_by_class")
    out = nodes.drop("call_target_id").withColumn("_m", fn.method_name(F.col("call_target")))
    out = out.join(unique, "_m", "left").join(qualified, out["call_target"] == qualified["_q"], "left")
    return out.withColumn("call_target_id", F.coalesce("_by_name", "_by_class")).drop("_m", "_q", "_by_name", "_by_class")


def validated(names: DataFrame, functions: DataFrame) -> DataFrame:
    """name, fid, how of names that an agent gave: class.method, a unique short name, a class hint, the first of several.

    Names that fit no function are not_found, with a null fid.
    """
    told = names.select("name").distinct().withColumns({"_short": fn.method_name(F.col("name")), "_class": F.lower(F.when(F.contains("name", F.lit(".")), F.regexp_extract("name", r"(\w+)\.\w+$", 1)))})
    own = functions.select("fid", F.col("name").alias("_f"), F.lower("class_name").alias("_c"))
    hits = told.join(own, F.col("_short") == F.col("_f"), "left")
    rank = F.when(F.col("fid").isNull(), 9).when(F.col("_class") == F.col("_c"), 0).when(F.contains("_c", F.col("_class")) | F.contains("_class", F.col("_c")), 1).otherwise(2)
    best = hits.withColumn("_p", rank).groupBy("name").agg(F.min_by("fid", F.struct("_p", "fid")).alias("fid"), F.min("_p").alias("_p"), F.count_distinct("fid").alias("_n"))
    how = F.when(F.col("_p") == 9, "not_found").when(F.col("_p") == 0, "class_method").when(F.col("_n") == 1, "unique").when(F.col("_p") == 1, "class_hint").otherwise("ambiguous")
    return best.select("name", "fid", how.alias("how"))


# -- bounded traversals ------------------------------------------------------------------------------------------------


def written(df: DataFrame) -> DataFrame:
    """df as a table in the folder that the cluster names for checkpoints, read again.

    Where none is named, a local master gets a temporary folder; on a cluster nothing that all could read can be made up.
    """
    spark = df.sparkSession
    key = "spark.checkpoint.dir"
    folder = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"set {key} to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.conf.set(key, folder)
    path = f"{folder.rstrip('/')}/frontier-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reach(seeds: DataFrame, edges: DataFrame, most: int, origin: bool = False) -> DataFrame:
    """id, depth (and origin) of what is reached from `seeds` (id) along `edges` (src, dst) in at most `most` steps.

    Level by level: only nodes that weren't reached before go on, so cycles end. With `origin`, a node takes over the
    origin of its smallest predecessor on the level at which it is first reached. The edges are dealt by src once.
    """
    keep = ["id", "depth", "origin"] if origin else ["id", "depth"]
    seen = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    if origin:
        seen = seen.withColumn("origin", F.col("id"))
    frontier = seen
    edges = edges.select("src", "dst").distinct()
    for depth in range(1, most + 1):
        step = frontier.join(edges, frontier["id"] == edges["src"])
        best = [F.lit(depth).alias("depth")] + ([F.min_by("origin", F.col("src")).alias("origin")] if origin else [])
        new = step.groupBy(F.col("dst").alias("id")).agg(*best).join(seen.select("id"), "id", "left_anti").select(keep)
        frontier = written(new)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.select(keep)


def shortest_paths(seeds: DataFrame, edges: DataFrame, most: int = 6) -> DataFrame:
    """id, hops, path (array of ids, the smallest of the shortest ones) from seeds (id)."""
    seen = seeds.select("id").distinct().select("id", F.lit(0).alias("hops"), F.array("id").alias("path"))
    frontier = seen
    edges = edges.select("src", "dst").distinct()
    for hop in range(1, most + 1):
        step = frontier.join(edges, frontier["id"] == edges["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("path").alias("_p"))
        new = step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hops"), F.concat("_p", F.array("id")).alias("path"))
        frontier = written(new)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def pair_hops(pairs: DataFrame, edges: DataFrame, most: int = 6) -> DataFrame:
    """src, dst, hops of the given pairs that a path of at most `most` calls joins; searches start at the pairs' sources."""
    edges = edges.select("src", "dst").distinct()
    wanted = pairs.select("src", "dst").distinct()
    seen = wanted.select("src").distinct().select(F.col("src").alias("s"), F.col("src").alias("id"), F.lit(0).alias("hops"))
    frontier = seen
    for hop in range(1, most + 1):
        step = frontier.join(edges, frontier["id"] == edges["src"]).select("s", F.col("dst").alias("id")).distinct()
        new = step.join(seen.select("s", "id"), ["s", "id"], "left_anti").withColumn("hops", F.lit(hop))
        frontier = written(new)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return wanted.join(seen.select(F.col("s").alias("src"), F.col("id").alias("dst"), "hops"), ["src", "dst"])


def hops_between(sources: DataFrame, targets: DataFrame, edges: DataFrame, most: int = 6) -> DataFrame:
    """src, dst, hops of each source (id) and each target (id) that a path of 1 to `most` calls leads to; no pair is made before a path is."""
    edges = edges.select("src", "dst").distinct()
    seen = sources.select(F.col("id").alias("s")).filter("s IS NOT NULL").distinct().select("s", F.col("s").alias("id"), F.lit(0).alias("hops"))
    frontier = seen
    for hop in range(1, most + 1):
        step = frontier.join(edges, frontier["id"] == edges["src"]).select("s", F.col("dst").alias("id")).distinct()
        frontier = written(step.join(seen.select("s", "id"), ["s", "id"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.filter("hops > 0").join(targets.select("id").distinct(), "id", "left_semi").select(F.col("s").alias("src"), F.col("id").alias("dst"), "hops")


def domains(functions: DataFrame, calls: DataFrame, hops: int = 5, least: int = 5) -> DataFrame:
    """entry, members (how many functions its tree holds): of entry points that call something and reach `least` or more."""
    edges = calls.select("src", "dst").distinct()
    entries = degrees(calls).filter("in_degree = 0 AND out_degree > 0").select("fid").join(functions.select("fid"), "fid", "left_semi")
    seen = entries.select(F.col("fid").alias("s"), F.col("fid").alias("id"))
    frontier = seen
    for _ in range(hops):
        new = frontier.join(edges, frontier["id"] == edges["src"]).select("s", F.col("dst").alias("id")).distinct().join(seen, ["s", "id"], "left_anti")
        frontier = written(new)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.groupBy(F.col("s").alias("entry")).agg(F.count("*").alias("members")).filter(F.col("members") >= least)


def reach_each(seeds: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """s, id of what is reached for each search (s) from its seeds (s, id) in at most `most` steps, seeds included.

    A row for each search and node: meant for a stated few searches, each of which may start at many nodes at once.
    """
    edges = edges.select("src", "dst").distinct()
    seen = frontier = seeds.select("s", "id").distinct()
    for _ in range(most):
        step = frontier.join(edges, frontier["id"] == edges["src"]).select("s", F.col("dst").alias("id")).distinct()
        frontier = written(step.join(seen, ["s", "id"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def wide(functions: DataFrame, calls: DataFrame, hops: int = 5, least: int = 5) -> DataFrame:
    """fid of functions from which `least` or more functions, itself included, are reached in at most `hops` calls.

    No pair of a function and what it reaches is made: every function carries the `least` smallest ids of its tree, which
    it takes over from the functions it calls, one hop a round. A function with so many is done and isn't asked again, as
    a tree only grows with the hops. So a round has at most `least` rows a call, however large the trees are. Functions are as
    many as rows, so none of these joins sends them through the driver, however small Spark takes their columns to be.
    """
    own = functions.select("fid").filter("fid IS NOT NULL").distinct().hint("merge")
    state = own.select("fid", F.array("fid").alias("some"))
    edges = written(calls.select("src", "dst").filter("src <> dst").distinct().join(own.select(F.col("fid").alias("src")), "src", "left_semi").join(own.select(F.col("fid").alias("dst")), "dst", "left_semi"))
    first = Window.partitionBy("fid").orderBy("id")
    for _ in range(hops):
        few = state.filter(F.size("some") < least)
        asked = edges.join(few.select(F.col("fid").alias("src")).hint("merge"), "src", "left_semi")
        told = asked.join(state.hint("merge"), asked["dst"] == state["fid"]).select(F.col("src").alias("fid"), F.explode("some").alias("id"))
        each = told.unionByName(few.select("fid", F.col("fid").alias("id"))).distinct()
        grown = each.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= least).groupBy("fid").agg(F.collect_list("id").alias("some"))
        state = written(state.filter(F.size("some") >= least).unionByName(grown))
    return state.filter(F.size("some") >= least).select("fid")


def domain_index(functions: DataFrame, calls: DataFrame, summaries: DataFrame, hops: int = 5, least: int = 5) -> DataFrame:
    """entry, label, text of every domain: an entry point (not called, calling) that reaches `least` or more functions.

    `functions` has fid, name, path; `summaries` fid, summary. The label is the name and, in brackets, the file without the
    endings .groovy and .java; the text to be embedded is the name, the file, the names of the first five callees by id and
    200 characters of the summary, with a blank between them even where one is empty. Calls from or to other functions
    don't count. Members of a domain aren't listed: `domain_members` finds those of the domains that a search is routed to.
    """
    own = functions.select("fid", "name", "path").dropDuplicates(["fid"]).hint("merge")
    known = own.select("fid").hint("merge")
    edges = written(calls.select("src", "dst").distinct().join(known.withColumnRenamed("fid", "src"), "src", "left_semi").join(known.withColumnRenamed("fid", "dst"), "dst", "left_semi"))
    called = edges.select(F.col("dst").alias("fid")).distinct().hint("merge")
    entries = written(edges.select(F.col("src").alias("fid")).distinct().join(called, "fid", "left_anti").join(wide(own, edges, hops, least).hint("merge"), "fid", "left_semi"))
    near = edges.join(entries.select(F.col("fid").alias("src")).hint("merge"), "src", "left_semi").withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).filter("_r <= 5")
    named = near.join(own.select(F.col("fid").alias("dst"), F.col("name").alias("_callee")), "dst").groupBy(F.col("src").alias("fid")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dst", "_callee"))), lambda x: x["_callee"]), " ").alias("_callees"))
    told = summaries.groupBy("fid").agg(F.min("summary").alias("_summary"))
    file = F.replace(F.replace(F.substring_index("path", "/", -1), F.lit(".groovy"), F.lit("")), F.lit(".java"), F.lit(""))
    out = entries.join(own, "fid").join(named.hint("merge"), "fid").join(told.hint("merge"), "fid", "left").withColumn("_file", file)
    text = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("_file", F.lit("")), "_callees", F.substring(F.coalesce("_summary", F.lit("")), 1, 200))
    return out.select(F.col("fid").alias("entry"), F.concat("name", F.lit(" ("), "_file", F.lit(")")).alias("label"), text.alias("text"))


def domain_members(routed: DataFrame, calls: DataFrame, hops: int = 5) -> DataFrame:
    """query_id, fid of all functions in the domains (query_id, entry) that queries are routed to; only these are walked."""
    return reach_each(routed.select(F.col("query_id").alias("s"), F.col("entry").alias("id")), calls, hops).select(F.col("s").alias("query_id"), F.col("id").alias("fid"))
