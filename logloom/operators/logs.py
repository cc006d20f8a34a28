"""From lines to entries: sessionisation, fields, stack traces, error flags, filters and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import LogProfile, group_names, java
from ..functions import text as fn
from ..sources.logs import json_fields

#: Levels whose entries are never merged.
PRESERVED = ["error", "fatal", "severe", "warn"]
#: Lines of a file are put into blocks of so many, so that a long file isn't one task.
BLOCK_LINES = 200_000


def starts_entry(line: Column, profile: LogProfile) -> Column:
    """Whether a line looks like the start of an entry and like no continuation."""
    starts = line.rlike(java(profile.entry_start, anchored=True))
    for pattern in profile.continuation_patterns:
        starts = starts & ~line.rlike(java(pattern, anchored=True))
    return starts


def number_entries(lines: DataFrame, profile: LogProfile, file: str = "file", block_lines: int = BLOCK_LINES) -> DataFrame:
    """Adds entry_id (from 1 in each file): a line starts an entry if it looks so and isn't the file's first line.

    Running sums go over blocks of lines side by side; sums of earlier blocks are added from a table of blocks.
    """
    flagged = lines.withColumn("_start", (starts_entry(F.col("line"), profile) & (F.col("line_no") > 1)).cast("bigint")).withColumn("_block", F.floor((F.col("line_no") - 1) / block_lines))
    running = Window.partitionBy(file, "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(file).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = flagged.groupBy(file, "_block").agg(F.sum("_start").alias("_n")).select(file, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return flagged.withColumn("_in", F.sum("_start").over(running)).join(blocks, [file, "_block"]).withColumn("entry_id", F.col("_in") + F.col("_before") + 1).drop("_start", "_block", "_in", "_before")


def entries(lines: DataFrame, profile: LogProfile, file: str = "file") -> DataFrame:
    """One row for each entry: file, entry_id, line_number, line_end (both from 1), first, lines, raw_text."""
    grouped = number_entries(lines, profile, file).groupBy(file, "entry_id").agg(F.min("line_no").alias("line_number"), F.max("line_no").alias("line_end"), F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]).alias("lines"))
    return grouped.withColumn("first", F.get("lines", F.lit(0))).withColumn("raw_text", F.array_join("lines", "\n"))


def fields(line: Column, profile: LogProfile) -> dict[str, Column]:
    """Columns by field name: groups of the first of the profile's patterns that matches; null for absent ones."""
    if profile.type == "json":
        found = json_fields(line, profile.field_map)
        return {name: found[name] for name in profile.field_map}
    out: dict[str, Column] = {}
    tried = F.lit(False)
    for pattern in [p for p in [profile.line_pattern, *profile.alt_patterns] if p]:
        converted = java(pattern, anchored=True)
        hit = line.rlike(converted) & ~tried
        for i, name in enumerate(group_names(pattern), 1):
            if name:
                value = F.when(hit, F.nullif(F.regexp_extract(line, converted, i), F.lit("")))
                out[name] = F.coalesce(out[name], value) if name in out else value
        tried = tried | line.rlike(converted)
    return out


def parsed(found: DataFrame, profile: LogProfile) -> DataFrame:
    """Adds level, timestamp, thread_id, static_text, service and is_error to entries."""
    got = fields(F.col("first"), profile)
    nothing = F.lit(None).cast("string")
    level = F.lower(F.coalesce(got.get("level", nothing), fn.level(F.col("first"))))
    message = F.coalesce(F.nullif(got.get("message", nothing), F.lit("")), fn.message(F.col("first"), java(profile.entry_start), profile.message_separators))
    out = found.withColumns({"level": level, "timestamp": got.get("timestamp", nothing), "thread_id": got.get(profile.thread_field, nothing), "static_text": message, "service": F.lit(profile.service)})
    return out.withColumn("is_error", F.col("level").isin(profile.error_levels) | fn.matches_any(F.col("raw_text"), [java(p) for p in profile.error_markers]))


def kept(found: DataFrame, profile: LogProfile) -> DataFrame:
    """Entries without an ignored pattern or a known error."""
    known = [k["pattern"] for k in profile.known_errors if "pattern" in k]
    return found.filter(~fn.matches_any(F.col("raw_text"), [java(p) for p in [*profile.ignore_patterns, *known]]))


def stack_frames(found: DataFrame, profile: LogProfile, key: list[str]) -> DataFrame:
    """key, cause_depth, frame_idx, class_name, method, file, line of frames in the lines behind an entry's first.

    Starts of entries are cut from these lines first. Each "caused by" line is a level deeper. In Python traces the
    file stands for the class.
    """
    patterns = profile.stack
    if not patterns:
        raise ValueError("the profile's language has no stack traces")
    start = java(profile.entry_start, anchored=True)
    rest = F.transform(F.slice("lines", F.lit(2), F.size("lines")), lambda x: F.regexp_replace(x, start, ""))
    lines = found.select(*key, F.posexplode(rest).alias("n", "l"))
    order = Window.partitionBy(*key).orderBy("n")
    cause = F.col("l").rlike(java(patterns["caused_by"], anchored=True)) if "caused_by" in patterns else F.lit(False)
    deep = lines.withColumn("cause_depth", F.sum(cause.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    frame = java(patterns["frame"], anchored=True)
    frames = deep.filter(F.col("l").rlike(frame))
    part = lambda i: F.regexp_extract("l", frame, i)
    names = {"class_name": part(1), "method": part(3), "file": part(1), "line": part(2).cast("int")} if "caused_by" not in patterns else {"class_name": part(1), "method": part(2), "file": part(3), "line": part(4).cast("int")}
    number = F.row_number().over(Window.partitionBy(*key, "cause_depth").orderBy("n")) - 1
    return frames.withColumns({"frame_idx": number} | names).select(*key, "cause_depth", "frame_idx", *names)


def exceptions(found: DataFrame, profile: LogProfile, key: list[str]) -> DataFrame:
    """key, cause_depth, exception, message: the header or cause of each level (Java), the last exception line (Python)."""
    patterns = profile.stack
    start = java(profile.entry_start, anchored=True)
    rest = F.transform(F.slice("lines", F.lit(2), F.size("lines")), lambda x: F.regexp_replace(x, start, ""))
    lines = found.select(*key, F.posexplode(rest).alias("n", "l"))
    head = java(patterns["exception"], anchored=True)
    if "caused_by" not in patterns:
        got = lines.filter(F.col("l").rlike(head)).groupBy(*key).agg(F.max_by("l", "n").alias("l"))
        return got.select(*key, F.lit(0).alias("cause_depth"), F.regexp_extract("l", head, 1).alias("exception"), F.regexp_extract("l", head, 2).alias("message"))
    cause = java(patterns["caused_by"], anchored=True)
    first = lines.filter((F.col("n") == 0) & F.col("l").rlike(head)).select(*key, F.lit(0).alias("cause_depth"), F.regexp_extract("l", head, 1).alias("exception"), F.regexp_extract("l", head, 2).alias("message"))
    deeper = lines.filter(F.col("l").rlike(cause)).withColumn("cause_depth", F.row_number().over(Window.partitionBy(*key).orderBy("n")))
    return first.unionByName(deeper.select(*key, "cause_depth", F.regexp_extract("l", cause, 1).alias("exception"), F.regexp_extract("l", cause, 2).alias("message")))


def deduplicated(found: DataFrame, idx: str = "entry_idx", level: str = "level", text: str = "static_text", by: list[str] | None = None) -> DataFrame:
    """Entries with equal signatures become their first one, with repeat_count; entries of preserved levels all stay."""
    by = by or []
    keep = F.lower(level).isin(PRESERVED)
    marked = found.withColumn("_own", F.when(keep, F.col(idx))).withColumn("_sig", F.when(~keep, fn.signature(F.col(text))))
    row = F.struct(*found.columns)
    grouped = marked.groupBy(*by, "_own", "_sig").agg(F.min_by(row, F.col(idx)).alias("_row"), F.count("*").alias("repeat_count"))
    return grouped.select("_row.*", "repeat_count")


def coverage(resolved: DataFrame, tier: str = "tier") -> DataFrame:
    """n, resolved, coverage_pct: the share of entries in tiers 1 to 3, in hundredths, to one place."""
    ok = F.count_if(F.col(tier) <= 3)
    return resolved.agg(F.count("*").alias("n"), ok.alias("resolved"), F.round(100.0 * ok / F.greatest(F.count("*"), F.lit(1)), 1).alias("coverage_pct"))
