"""Sinks: recorded events, DOT graphs and Markdown reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import redacted
from ..operators.store import monotone

# Colours of tiers in graphs.
COLOURS = {1: "palegreen", 2: "lightblue", 3: "khaki", 4: "lightgray"}


def record(events: DataFrame, path: str, session: str, order: str, clock: str) -> None:
    """Events as JSON lines, in order within a session, with a clock that never goes back and secrets masked."""
    told = monotone(events, session, order, clock)
    text = [c for c, t in told.dtypes if t == "string" and c != session]
    told.withColumns({c: redacted(F.col(c)) for c in text}).sortWithinPartitions(session, order).write.mode("overwrite").json(path)


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """part, line: lines of a directed graph in DOT; error nodes are red, others have the colour of their tier."""
    colour = F.when(F.col("is_error"), F.lit("red")).otherwise(F.element_at(F.create_map(*[F.lit(x) for k, v in COLOURS.items() for x in (k, v)]), F.col("tier")))
    label = F.replace("label", F.lit('"'), F.lit("'"))
    body = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('  "'), F.col("id").cast("string"), F.lit('" [label="'), label, F.lit('", fillcolor='), F.coalesce(colour, F.lit("white")), F.lit("];")).alias("line"))
    links = edges.select(F.lit(2).alias("part"), F.concat(F.lit('  "'), F.col("src").cast("string"), F.lit('" -> "'), F.col("dst").cast("string"), F.lit('";')).alias("line"))
    return body.unionByName(links)


def markdown_rows(verdicts: DataFrame) -> DataFrame:
    """line: one row of a Markdown table for each finding (title, file_path, line, status, why)."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in ("title", "file_path", "line", "status", "why")]
    return verdicts.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
