"""Which of many needles occur in which of many texts: an equi-join on each needle's rarest three characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(text: Column, sizes: list[int]) -> Column:
    """Distinct runs of the given numbers of characters."""
    whole = lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: i + n - 1 <= F.length(text)), lambda i: F.call_function("substring", text, i, F.lit(n)))
    return F.array_distinct(F.concat(*[whole(n) for n in sizes]))


def contained(texts: DataFrame, needles: DataFrame, text: str, needle: str, by: list[str] | None = None) -> DataFrame:
    """by, text, needle, at (from 1): distinct pairs of a text and a needle in it, with the place where it is first found.

    A needle is looked for only in the texts that have its rarest run of three characters (all of a shorter one), counted
    over the texts; one with a run that no text has is left at once. So the work grows with texts, needles and the pairs
    that share a rare run, not with all pairs. With `by`, both have these columns, and only equal ones meet. Empty and null needles and
    texts are in no pair; names of `text`, `needle` and `by` differ.
    """
    by = by or []
    hay = texts.select(*by, text).filter(F.length(text) > 0).distinct()
    pins = needles.select(*by, needle).filter(F.length(needle) > 0).distinct()
    sizes = sorted(r.n for r in pins.select(F.least(F.length(needle), F.lit(GRAM)).alias("n")).distinct().collect())  # three numbers at most
    if not sizes:
        return hay.select(*by, text, F.lit("").alias(needle), F.lit(0).alias("at")).limit(0)
    own = F.when(F.length(needle) >= GRAM, _grams(F.col(needle), [GRAM])).otherwise(F.array(needle))
    wanted = pins.select(*by, needle, F.explode(own).alias("__gram"))
    held = hay.select(*by, text, F.explode(_grams(F.col(text), sizes)).alias("__gram")).join(wanted.select(*by, "__gram").distinct(), [*by, "__gram"], "left_semi")
    counts = held.groupBy(*by, "__gram").agg(F.count("*").alias("__texts"))
    rarest = wanted.join(counts, [*by, "__gram"], "left").groupBy(*by, needle).agg(F.min(F.struct(F.coalesce("__texts", F.lit(0)).alias("n"), "__gram")).alias("__rarest")).filter("__rarest.n > 0").select(*by, needle, F.col("__rarest.__gram").alias("__gram"))
    return held.join(rarest, [*by, "__gram"]).withColumn("at", F.call_function("locate", F.col(needle), F.col(text))).filter("at > 0").select(*by, text, needle, "at")
