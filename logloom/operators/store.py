"""Stores as append-only tables: latest state, replacement, newest first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last change of each key, with first_seen, the least of its first order column: by aggregation, no sort of a key."""
    row = F.struct(*changes.columns)
    out = changes.groupBy(*key).agg(F.max_by(row, F.struct(*order)).alias("_r"), F.min(order[0]).alias("first_seen"))
    return out.select("_r.*", "first_seen")


def replaced(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows whose key has no new row, and the new rows."""
    return stored.join(new.select(*key).distinct(), key, "left_anti").select(new.columns).unionByName(new)


def newest(rows: DataFrame, order: str, tie: str, n: int = 50) -> DataFrame:
    return rows.orderBy(F.desc(order), F.desc(tie)).limit(n)


def upserted(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows that no new row equals in the key (null equals null), and the new rows."""
    cond = [stored[k].eqNullSafe(new[k]) for k in key]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    return stored.join(new, on, "left_anti").unionByName(new)


def emit_once(events: DataFrame, session: str, item: str, order: str) -> DataFrame:
    """The first event of each item of a session."""
    row = F.struct(*events.columns)
    return events.groupBy(session, item).agg(F.min_by(row, order).alias("_r")).select("_r.*")


def monotone(events: DataFrame, session: str, order: str, clock: str, out: str = "t_ms") -> DataFrame:
    """Adds a clock that never goes back within a session."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn(out, F.max(clock).over(w))
