"""What counts where a language model says nothing: deterministic choices over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Caps and confidences.
AGENTS, REPORTS, HITS = 5, 3, 2
UNSURE, SURE = 0.3, 0.95
LENS = "general_failure_analysis"
TEXT = 2000


def assignments(errors: DataFrame, idx: str, node: str, most: int = AGENTS) -> DataFrame:
    """One error for each starting node (its first), the first `most` in order."""
    first = errors.groupBy(node).agg(F.min(idx).alias(idx))
    return first.orderBy(idx, node).limit(most)


def evidence_summary(reports: DataFrame, idx: str, confidence: str, few: int = REPORTS) -> DataFrame:
    """Reports over UNSURE; the first few if there is none."""
    good = reports.filter(F.col(confidence) > UNSURE)
    some = good.agg((F.count("*") > 0).alias("_some"))
    none = reports.orderBy(idx).limit(few).crossJoin(F.broadcast(some)).filter("NOT _some").drop("_some")
    return good.unionByName(none)


def early_exit(reports: DataFrame, confidence: str) -> DataFrame:
    """One row: whether there is a single report and it is sure."""
    return reports.agg(((F.count("*") == 1) & (F.max(confidence) >= SURE)).alias("exit"))


def assessment(text: Column) -> Column:
    """A trace report from free text: its beginning, unsure."""
    return F.struct(F.substring(text, 1, TEXT).alias("assessment"), F.lit(UNSURE).alias("confidence"))


def lenses(chosen: Column) -> Column:
    """The lenses that a router chose, the general one if it chose none."""
    return F.when(F.size(F.coalesce(chosen, F.array().cast("array<string>"))) > 0, chosen).otherwise(F.array(F.lit(LENS)))


def top_hits(hits: DataFrame, score: str, key: str, most: int = HITS) -> DataFrame:
    return hits.orderBy(F.desc(score), key).limit(most)


def usage(calls: DataFrame) -> DataFrame:
    """model, calls, input_tokens, output_tokens."""
    return calls.groupBy("model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
