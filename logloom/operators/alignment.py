"""Entries against what their functions are expected to log, and those expectations: merged logs of callers, function and callees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as fn
from .graph import written
from .substrings import contained
from .traversal import depth_first

# Fragments and texts of so many characters or fewer tell nothing; levels of errors; characters told of a message.
SHORT, ERRORS, TOLD = 3, ["error", "fatal"], 60


def _first_hits(open_: DataFrame, needles: DataFrame, by: list[str]) -> DataFrame:
    """by, message, ord, label: the first of the needles (by, ord, label, needle; an empty needle fits all) that a message holds."""
    texts = open_.select(*by, "message").distinct()
    pins = needles.filter(F.length("needle") > 0)
    found = contained(texts, pins, "message", "needle", by).drop("at").join(pins, [*by, "needle"]).select(*by, "message", "ord", "label")
    always = needles.filter("needle = ''").groupBy(*by).agg(F.min(F.struct("ord", "label")).alias("s")).select(*by, "s.ord", "s.label")
    every = found.unionByName(texts.join(always, by).select(*by, "message", "ord", "label"))
    return every.groupBy(*by, "message").agg(F.min(F.struct("ord", "label")).alias("s")).select(*by, "message", "s.ord", "s.label")


def compared(entries: DataFrame, templates: DataFrame, merged: DataFrame, runtime: DataFrame) -> DataFrame:
    """Adds rung (1, 2, 3, null), ord, label and divergence to entries with a function.

    entries: fid, function, message, level, anchor (the function that its cluster begins with). An entry matches

    1. a template of its own function (templates: fid, fname, ord, frags): the first one without fragments, or whose first fragment of
       more than SHORT characters stands in the message; label `fname[ord]`;
    2. else a text of more than SHORT characters in its function's merged logs (merged: fid, ord, text), the first in
       their order; label `merged[ord]`;
    3. else a log of its own method in what its anchor runs through (runtime: anchor, ord, func, text), if it says nothing or stands in
       the message; label `anchor[ord]`.

    What is left is `error_unmapped` or `unexpected_entry`. Texts are searched for by their rarest three characters among distinct
    messages of a function, so a function with many templates and many messages is no product. Null messages match as empty ones.
    """
    own = entries.filter(F.coalesce("function", F.lit("")) != "").withColumns({"message": F.coalesce("message", F.lit("")), "method": fn.method_name(F.col("function"))})
    trimmed = F.transform("frags", lambda f: F.trim(f))
    said = F.get(F.filter(trimmed, lambda f: F.length(f) > SHORT), F.lit(0))
    needle = F.when(F.size("frags") == 0, "").otherwise(said)
    one = _first_hits(own.filter("fid > 0"), templates.filter("fid > 0").select("fid", "ord", F.concat("fname", F.lit("["), F.col("ord").cast("string"), F.lit("]")).alias("label"), needle.alias("needle")).filter("needle IS NOT NULL"), ["fid"])
    named = lambda df, n: df.withColumnsRenamed({"ord": f"_o{n}", "label": f"_l{n}"})
    step = written(own.join(named(one, 1), ["fid", "message"], "left"))
    texts = merged.filter((F.col("fid") > 0) & (F.length("text") > SHORT)).select("fid", "ord", F.concat(F.lit("merged["), F.col("ord").cast("string"), F.lit("]")).alias("label"), F.col("text").alias("needle"))
    two = _first_hits(step.filter("_l1 IS NULL AND fid > 0"), texts, ["fid"])
    step = written(step.join(named(two, 2), ["fid", "message"], "left"))
    ran = runtime.select("anchor", F.col("func").alias("method"), "ord", F.concat("anchor", F.lit("["), F.col("ord").cast("string"), F.lit("]")).alias("label"), F.coalesce("text", F.lit("")).alias("needle"))
    three = _first_hits(step.filter("_l1 IS NULL AND _l2 IS NULL"), ran, ["anchor", "method"])
    out = step.join(named(three, 3), ["anchor", "method", "message"], "left")
    rung = F.when(F.col("_l1").isNotNull(), 1).when(F.col("_l2").isNotNull(), 2).when(F.col("_l3").isNotNull(), 3)
    # a later rung counts only where no earlier one did
    ord_ = F.when(rung == 1, F.col("_o1")).when(rung == 2, F.col("_o2")).when(rung == 3, F.col("_o3"))
    label = F.when(rung == 1, F.col("_l1")).when(rung == 2, F.col("_l2")).when(rung == 3, F.col("_l3"))
    return out.select(*entries.columns, rung.alias("rung"), ord_.alias("ord"), label.alias("label"), F.when(rung.isNull(), F.when(F.lower("level").isin(ERRORS), "error_unmapped").otherwise("unexpected_entry")).alias("divergence"))


def coverage(found: DataFrame, thread: str = "thread_id") -> DataFrame:
    """thread, entries, matched, coverage (in hundredths) of compared entries."""
    n, hit = F.count("*"), F.count("rung")
    return found.groupBy(thread).agg(n.alias("entries"), hit.alias("matched"), (100.0 * hit / F.greatest(n, F.lit(1))).alias("coverage"))


def divergences(found: DataFrame) -> DataFrame:
    """The entries that match nothing: what was expected, and what came instead."""
    odd = found.filter("divergence IS NOT NULL")
    return odd.withColumns({"expected": F.col("function"), "actual": F.concat("function", F.lit(" ["), F.coalesce("level", F.lit("")), F.lit("] "), F.substring(F.coalesce("message", F.lit("")), 1, TOLD))})


def places(nodes: DataFrame, down: int = 4) -> DataFrame:
    """anchor, fid, at: where each function is inlined into each one with logs, as the path of places of the calls that lead to it.

    nodes: fid, node_id, type, call_target_id. Calls of functions with logs are followed depth first, each function once
    for an anchor, at the first call that comes to it; one reached below `down` calls is taken and inlined nowhere.
    """
    logged = nodes.filter("type = 'log'").select("fid").distinct()
    calls = nodes.filter("type = 'call' AND call_target_id > 0").groupBy("fid", F.col("call_target_id").alias("callee")).agg(F.min("node_id").alias("place"))
    calls = calls.join(logged.withColumnRenamed("fid", "callee"), "callee", "left_semi")
    reached = depth_first(logged.select(F.col("fid").alias("root")), calls.select(F.col("fid").alias("node"), F.col("callee").alias("other"), "place"), down)
    return reached.select(F.col("root").alias("anchor"), F.col("node").alias("fid"), "at")


def indexed_logs(nodes: DataFrame, callers: DataFrame, down: int = 4, up: int = 3) -> DataFrame:
    """anchor, seq_no (from 1), fid, line, level, text: the logs to expect around each function that has some.

    First its callers' own logs, from the farthest of at most `up` (each one the first caller, callers: fid, caller), then the function's with
    those of its callees in place (see `places`). The chain of callers ends at a function that is inlined already.
    nodes: fid, node_id, type, line, log_level, log_text, call_target_id.
    """
    nodes = written(nodes.select("fid", "node_id", "type", "line", "log_level", "log_text", "call_target_id"))
    at = written(places(nodes, down))
    logs = nodes.filter("type = 'log'").select("fid", "node_id", "line", F.col("log_level").alias("level"), F.col("log_text").alias("text"))
    first = written(callers.groupBy(F.col("fid").alias("_of")).agg(F.min("caller").alias("caller")))
    # only functions with a caller have a chain
    taken = written(at.join(first, F.col("anchor") == F.col("_of"), "left_semi").select("anchor", F.col("fid").alias("caller")))
    top = taken.filter("anchor = caller").select("anchor", F.col("caller").alias("now"))
    chain = None
    for k in range(1, up + 1):
        new = top.join(first, F.col("now") == F.col("_of")).select("anchor", "caller").join(taken, ["anchor", "caller"], "left_anti")
        new = written(new.withColumn("k", F.lit(k)))
        chain = new if chain is None else chain.unionByName(new)
        taken = taken.unionByName(new.select("anchor", "caller"))
        top = new.select("anchor", F.col("caller").alias("now"))
    above = chain.select("anchor", F.col("caller").alias("fid"), (-F.col("k")).alias("up")).join(logs, "fid").select("anchor", "fid", "up", F.array(F.col("node_id").cast("int")).alias("key"), "line", "level", "text")
    own = logs.select(F.col("fid").alias("anchor"), "fid", F.lit(0).alias("up"), F.array(F.col("node_id").cast("int")).alias("key"), "line", "level", "text")
    called = written(logs.join(nodes.filter("type = 'call'").select(F.col("call_target_id").alias("fid")).distinct(), "fid", "left_semi"))
    below = at.filter((F.size("at") > 0) & (F.size("at") <= down)).join(called, "fid").select("anchor", "fid", F.lit(0).alias("up"), F.concat("at", F.array(F.col("node_id").cast("int"))).alias("key"), "line", "level", "text")
    inner = own.unionByName(below)
    whole = above.unionByName(inner)
    return whole.withColumn("seq_no", F.row_number().over(Window.partitionBy("anchor").orderBy("up", "key"))).select("anchor", "seq_no", "fid", "line", "level", "text")
