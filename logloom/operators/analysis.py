"""From the lines of a log to functions: entries, fields, filters, traces and classes in one job, then all tiers of resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import LogProfile
from ..functions import text as fn
from . import logs, resolve
from .graph import written

#: Entries that one task numbers, and free numbers between files, so that the end of one isn't near the next one's start.
BLOCK, BETWEEN = 100_000, 10


def numbered(entries: DataFrame, idx: str = "entry_idx", file: str = "file", block: int = BLOCK) -> DataFrame:
    """Adds idx: 0, 1, … in order of file and entry_id, BETWEEN numbers left out between files.

    Rows are counted by blocks of a file, the blocks numbered in a table of their own: no task sees a whole file.
    """
    placed = entries.withColumn("_b", F.floor(F.col("entry_id") / block))
    blocks = placed.groupBy(file, "_b").agg(F.count("*").alias("_n"))
    order = Window.orderBy(file, "_b")
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + BETWEEN * (F.dense_rank().over(Window.orderBy(file)) - 1)
    offsets = blocks.select(F.col(file).alias("_f"), F.col("_b").alias("_c"), before.alias("_before"))
    inner = F.row_number().over(Window.partitionBy(file, "_b").orderBy("entry_id")) - 1
    return placed.withColumn("_i", inner).join(offsets, (F.col(file) == F.col("_f")) & (F.col("_b") == F.col("_c"))).withColumn(idx, (F.col("_before") + F.col("_i")).cast("long")).drop("_b", "_i", "_f", "_c", "_before")


def classes(loggers: DataFrame, functions: DataFrame, logger: str = "logger") -> DataFrame:
    """logger, class_name: the class that a logger is called after.

    By the last part of the logger, else (of more than two parts) by classes whose qualified_name ends with the last two.
    """
    told = loggers.select(logger).filter(F.col(logger).isNotNull()).distinct().withColumns({"_parts": F.split(logger, r"\.")}).withColumn("_last", F.element_at("_parts", -1))
    named = functions.select("class_name").distinct()
    hits = told.join(named, told["_last"] == named["class_name"], "left")
    if "qualified_name" not in functions.columns:
        return hits.filter("class_name IS NOT NULL").select(logger, "class_name")
    qualified = functions.select(F.col("class_name").alias("_c"), "qualified_name", F.element_at(F.split("qualified_name", r"\."), -1).alias("_end")).distinct()
    two = F.concat_ws(".", F.slice("_parts", -2, 2))
    open_ = hits.filter((F.col("class_name").isNull()) & (F.size("_parts") > 2)).withColumn("_two", two)
    more = open_.join(qualified, (open_["_last"] == qualified["_end"]) & F.endswith("qualified_name", F.col("_two"))).groupBy(logger).agg(F.min("_c").alias("class_name"))
    return hits.filter("class_name IS NOT NULL").select(logger, "class_name").unionByName(more)


def prepared(lines: DataFrame, profile: LogProfile, file: str = "file", deduplicate: bool = False) -> DataFrame:
    """Entries of log lines (file, line_no, line), ready to be resolved: all of their fields, frames, logger, and repeat_count.

    Lines become entries, entries get level, time, thread, message and error flag; those with an ignored pattern or a
    known error go. With `deduplicate`, entries of a file with equal signatures become their first one. `frames` are those of the
    trace itself, `trace` the ones of the application; `entry_idx` numbers what is left.
    """
    found = logs.kept(logs.parsed(logs.entries(lines, profile, file), profile), profile)
    found = found.withColumn("repeat_count", F.lit(1).cast("long"))
    if deduplicate:
        found = logs.deduplicated(found.drop("repeat_count"), "entry_id", by=[file])
    found = written(numbered(found, file=file))
    patterns = [p for p in [profile.line_pattern, *profile.alt_patterns] if p]
    found = found.withColumn("logger", resolve.logger_class(F.col("first"), patterns))
    if profile.stack is None:
        return found.withColumn("frames", F.array().cast("array<string>")).withColumn("trace", F.col("frames"))
    traced = found.filter(F.size("lines") > 1)
    frames = logs.stack_frames(traced, profile, ["entry_idx"]).filter("cause_depth = 0")
    named = frames.groupBy("entry_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", F.concat_ws(".", "class_name", "method").alias("q")))), lambda f: f["q"]).alias("frames"))
    out = found.join(named, "entry_idx", "left").withColumn("frames", F.coalesce("frames", F.array().cast("array<string>")))
    return out.withColumn("trace", F.when(F.size("frames") > 0, resolve.app_frames(F.col("frames"), [*resolve.PLATFORM, *profile.framework_markers])).otherwise(F.col("frames")))


def resolved(lines: DataFrame, profile: LogProfile, templates: DataFrame, functions: DataFrame, calls: DataFrame, file: str = "file", deduplicate: bool = False) -> DataFrame:
    """A log's lines attributed to functions: a row for each entry that is kept, with its lines, fields and resolution.

    templates: fid, frags, fname, line. functions: fid, class_name, name, source, templates, may have qualified_name. calls: src, dst.
    Columns: file, entry_id, entry_idx, line_number, line_end, level, timestamp, thread_id, static_text, is_error, repeat_count, logger,
    trace, status, tier, confidence, fid, fids, fname, line, origin_class, decision, inferred, framework. Threads of different
    files are different ones; without `group_by_thread` a file is one thread. See `resolve.attributed` for the tiers.
    """
    entries = written(prepared(lines, profile, file, deduplicate))
    owner = classes(entries, functions)
    thread = F.concat_ws("\u0001", F.col(file).cast("string"), F.col("thread_id")) if profile.group_by_thread else F.col(file).cast("string")
    ready = entries.join(owner, "logger", "left").select("entry_idx", thread.alias("_thread"), "static_text", "class_name", (F.size("frames") > 0).alias("stack"), F.get("trace", F.lit(0)).alias("frame"))
    told = resolve.attributed(ready, templates, functions, calls, thread="_thread").drop("_thread")
    out = entries.drop("lines", "raw_text", "first", "frames", "service").join(told, "entry_idx")
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    origin = F.when(F.col("status") == "hit", F.when(F.contains("fname", F.lit(".")), F.regexp_extract("fname", r"^(.*)\.[^.]*$", 1))).when(F.col("inferred"), last(F.col("logger")))
    missed = F.col("status").isin("miss", "skip") & (F.col("tier") == 4)
    return out.withColumns({"origin_class": origin, "framework": missed & fn.quoted_any(F.coalesce("logger", "static_text"), profile.framework_markers)})


def spread(told: DataFrame, entries: DataFrame, file: str = "file") -> DataFrame:
    """Gives each entry (file, entry_id, level, static_text) of a log what its first one of the same signature was told: file, entry_id, tier, fid.

    `told` is of a run with `deduplicate`; levels that are never merged meet by entry_id alone.
    """
    kept = F.lower("level").isin(logs.PRESERVED)
    key = lambda df: df.withColumns({"_own": F.when(kept, F.col("entry_id")), "_sig": F.when(~kept, fn.signature(F.col("static_text")))})
    first = key(told).select(F.col(file).alias("_f"), F.col("_own").alias("_o"), F.col("_sig").alias("_s"), "tier", "fid")
    every = key(entries)
    return every.join(first, (every[file] == first["_f"]) & every["_own"].eqNullSafe(first["_o"]) & every["_sig"].eqNullSafe(first["_s"])).select(file, "entry_id", "tier", "fid")
