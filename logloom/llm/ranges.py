"""Cut points of an integer column from exact counts: equal input gives equal ranges, whatever the number of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells that a span of values is counted in at once, and ranges that are made at most (the plan holds their cut points).
CELLS = 2048
MOST = 1 << 15


def cut_points(df: DataFrame, column: str, weight: str, target: int) -> list[int]:
    """Ascending values v; a range ends before each of them, and a range's weight is about `target` or one value's.

    Values are counted in cells of equal width; cells over the target are counted again in cells of their own, until
    each is within the target or a single value. The driver sees counts of cells only; more than MOST ranges are never
    made (the target is raised to the total by MOST). Nulls and an empty table give no cut point.
    """
    held = df.select(F.col(column).cast("long").alias("v"), F.col(weight).cast("long").alias("w")).filter("v IS NOT NULL")
    low, high, total = held.agg(F.min("v"), F.max("v"), F.sum("w")).first()
    if low is None:
        return []
    target = max(target, -(-total // MOST), 1)
    if total <= target:
        return []
    done: list[tuple[int, int]] = []  # first value of a cell, weight
    spans, waiting = [(low, high)], []  # at most 64 spans are looked into at a time
    while spans:
        width = {i: max(1, -(-(b - a + 1) // CELLS)) for i, (a, b) in enumerate(spans)}
        which = F.coalesce(*[F.when((F.col("v") >= a) & (F.col("v") <= b), F.lit(i)) for i, (a, b) in enumerate(spans)])
        start = F.element_at(F.array(*[F.lit(a) for a, _ in spans]), F.col("i") + 1)
        step = F.element_at(F.array(*[F.lit(width[i]) for i in range(len(spans))]), F.col("i") + 1)
        cells = held.withColumn("i", which).filter("i IS NOT NULL").withColumn("c", F.floor((F.col("v") - start) / step)).groupBy("i", "c").agg(F.sum("w").alias("w")).collect()
        again = []
        for i, c, w in cells:
            first = spans[i][0] + c * width[i]
            if w > target and width[i] > 1:
                again.append((first, min(first + width[i] - 1, spans[i][1])))
            else:
                done.append((first, w))
        waiting += sorted(again)
        spans, waiting = waiting[:64], waiting[64:]
    cuts, weight_here = [], 0
    for first, w in sorted(done):
        if weight_here and weight_here + w > target:
            cuts.append(first)
            weight_here = 0
        weight_here += w
    return cuts


def place(value: Column, cuts: list[int]) -> Column:
    """The number of the range that holds a value, from 0; null values are in range 0."""
    if not cuts:
        return F.pmod(F.xxhash64(value), F.lit(1)).cast("int")  # 0, but no constant: a join on it stays an equi-join
    # two steps, so that the work for each row grows with the square root of the number of ranges
    size = max(1, round(len(cuts) ** 0.5))
    groups = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    passed = lambda array: F.size(F.filter(array, lambda c: c <= value))
    coarse = passed(F.array(*[F.lit(int(g[0])) for g in groups]))
    inner = F.element_at(F.array(*[F.array(*[F.lit(int(c)) for c in g]) for g in groups]), F.greatest(coarse, F.lit(1)))
    return F.when(value.isNull() | (coarse == 0), F.lit(0)).otherwise((coarse - 1) * size + passed(inner)).cast("int")
