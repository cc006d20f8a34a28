"""Alignment queries: events are entries of functions, orders are functions whose lines log or call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment
from .registry import query, table

ALIGN = """e AS (SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS fid, 'fn' || (json_extract_string(props, '$.k')::BIGINT % 40) AS method, event_type || ' of item ' || json_extract_string(props, '$.k') || ' by ' || user_id % 7 AS message, CASE event_type WHEN 'error' THEN 'error' ELSE 'info' END AS level, 'fn' || user_id % 5 AS anchor, user_id FROM events),
ks AS (SELECT DISTINCT fid FROM e), templates AS (SELECT fid, 0 AS ord, 'click of' AS needle FROM ks UNION ALL SELECT fid, 1, 'view of item ' || fid || ' by' FROM ks UNION ALL SELECT fid, 2, '' FROM ks WHERE fid % 10 = 0),
merged AS (SELECT fid, 1 AS ord, 'signup' AS needle FROM ks UNION ALL SELECT fid, 2, 'item ' || fid || ' by 3' FROM ks WHERE fid % 2 = 0),
runtime AS (SELECT DISTINCT anchor, method, fid % 40 AS ord, CASE WHEN fid % 3 = 0 THEN 'purchase of' WHEN fid % 3 = 1 THEN '' ELSE 'by 5' END AS needle FROM e WHERE fid % 40 < 12),
hits AS (SELECT event_id, 1 AS rung, t.ord, 'tpl[' || t.ord || ']' AS label FROM e JOIN templates t ON t.fid = e.fid AND contains(message, needle) WHERE e.fid > 0 UNION ALL SELECT event_id, 2, m.ord, 'merged[' || m.ord || ']' FROM e JOIN merged m ON m.fid = e.fid AND contains(message, needle) WHERE e.fid > 0
  UNION ALL SELECT event_id, 3, r.ord, e.anchor || '[' || r.ord || ']' FROM e JOIN runtime r ON r.anchor = e.anchor AND r.method = e.method AND contains(message, needle)),
best AS (SELECT event_id, min((rung, ord, label)) AS b FROM hits GROUP BY event_id),
found AS (SELECT e.*, b[1] AS rung, b[2] AS ord, b[3] AS label, CASE WHEN b IS NULL THEN CASE WHEN level = 'error' THEN 'error_unmapped' ELSE 'unexpected_entry' END END AS divergence FROM e LEFT JOIN best USING (event_id))"""


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    method = F.concat(F.lit("fn"), (F.col("fid") % 40).cast("string"))
    e = table(spark, sf_dir, "events").withColumn("fid", k)
    said = F.concat("event_type", F.lit(" of item "), F.col("fid").cast("string"), F.lit(" by "), (F.col("user_id") % 7).cast("string"))
    e = e.select("event_id", "user_id", "fid", F.concat(F.lit("Shop."), method).alias("function"), said.alias("message"), F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"), F.concat(F.lit("fn"), (F.col("user_id") % 5).cast("string")).alias("anchor"))
    ks = e.select("fid").distinct()
    own = F.array(
        F.struct(F.lit(0).alias("ord"), F.array(F.lit("a "), F.lit(" click of "), F.lit("never")).alias("frags")),
        F.struct(F.lit(1).alias("ord"), F.array(F.concat(F.lit("view of item "), F.col("fid").cast("string"), F.lit(" by "))).alias("frags")),
        F.struct(F.lit(2).alias("ord"), F.when(F.col("fid") % 10 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("it"))).alias("frags")),
    )
    templates = ks.select("fid", F.lit("tpl").alias("fname"), F.inline(own))
    merged = ks.select("fid", F.inline(F.array(F.struct(F.lit(0).alias("ord"), F.lit("of").alias("text")), F.struct(F.lit(1).alias("ord"), F.lit("signup").alias("text")), F.struct(F.lit(2).alias("ord"), F.when(F.col("fid") % 2 == 0, F.concat(F.lit("item "), F.col("fid").cast("string"), F.lit(" by 3"))).alias("text")))))
    text = F.when(F.col("fid") % 3 == 0, "purchase of").when(F.col("fid") % 3 == 2, "by 5")
    runtime = e.filter("fid % 40 < 12").select("anchor", method.alias("func"), (F.col("fid") % 40).alias("ord"), text.alias("text")).distinct()
    return alignment.compared(e, templates, merged, runtime)


@query(f"WITH {ALIGN} SELECT event_id, rung::INT AS rung, ord::BIGINT AS ord, label, divergence FROM found")
def q_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir).select("event_id", "rung", F.col("ord").cast("long").alias("ord"), "label", "divergence")


@query(f"WITH {ALIGN} SELECT user_id, count(*) AS entries, count(rung) AS matched, round(100.0 * count(rung) / count(*), 6)::DOUBLE AS coverage FROM found GROUP BY user_id")
def q_compare_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.coverage(compared(spark, sf_dir), "user_id").withColumn("coverage", F.round("coverage", 6))


@query(f"WITH {ALIGN} SELECT event_id, 'Shop.' || method AS expected, 'Shop.' || method || ' [' || level || '] ' || message AS actual, divergence FROM found WHERE divergence IS NOT NULL")
def q_compare_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.divergences(compared(spark, sf_dir)).select("event_id", "expected", "actual", "divergence")


NODES = "nodes AS (SELECT l_orderkey AS fid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS id, l_partkey % 3 = 0 AS calls, (l_orderkey * 7 + l_partkey) % 1500 AS target, 'part ' || l_partkey AS text FROM lineitem)"


def order_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with every third part call another function, the others log."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("fid")).agg(F.array_sort(F.collect_list(line)).alias("s"))
    n = orders.select("fid", F.posexplode("s").alias("node_id", "x"))
    calls = F.col("x.l_partkey") % 3 == 0
    return n.select("fid", "node_id", F.when(calls, "call").otherwise("log").alias("type"), (F.col("node_id") + 1).alias("line"), F.when(~calls, "info").alias("log_level"), F.when(~calls, F.concat(F.lit("part "), F.col("x.l_partkey").cast("string"))).alias("log_text"), F.when(calls, (F.col("fid") * 7 + F.col("x.l_partkey")) % 1500).alias("call_target_id"))


# Depth first with a stack of (function, next node): each step looks at one node.
WALK = f"""{NODES}, logged AS (SELECT DISTINCT fid FROM nodes WHERE NOT calls), sizes AS (SELECT fid, max(id) + 1 AS n FROM nodes GROUP BY fid),
walk AS (SELECT fid AS anchor, 0 AS step, [fid] AS visited, [{{'f': fid, 'i': 0::BIGINT}}] AS st, NULL::BIGINT AS fid, NULL::BIGINT AS id FROM logged UNION ALL
SELECT w.anchor, w.step + 1, CASE WHEN n.calls AND l.fid IS NOT NULL AND NOT list_contains(w.visited, n.target) THEN list_append(w.visited, n.target) ELSE w.visited END,
  CASE WHEN n.fid IS NULL THEN w.st[1 : len(w.st) - 1] WHEN n.calls AND l.fid IS NOT NULL AND NOT list_contains(w.visited, n.target) AND len(w.st) <= 4 THEN list_append(list_append(w.st[1 : len(w.st) - 1], {{'f': w.st[-1].f, 'i': w.st[-1].i + 1}}), {{'f': n.target, 'i': 0::BIGINT}}) ELSE list_append(w.st[1 : len(w.st) - 1], {{'f': w.st[-1].f, 'i': w.st[-1].i + 1}}) END,
  CASE WHEN NOT n.calls THEN n.fid END, CASE WHEN NOT n.calls THEN n.id END
FROM (SELECT * FROM walk WHERE len(st) > 0) w LEFT JOIN nodes n ON n.fid = w.st[-1].f AND n.id = w.st[-1].i LEFT JOIN logged l ON l.fid = n.target AND n.target > 0),
done AS (SELECT anchor, arg_max(visited, step) AS visited FROM walk GROUP BY anchor), callers AS (SELECT target AS fid, min(fid) AS caller FROM nodes WHERE calls GROUP BY target),
chain AS (SELECT anchor, visited, anchor AS now, 0 AS k FROM done UNION ALL SELECT c.anchor, list_append(c.visited, x.caller), x.caller, k + 1 FROM chain c JOIN callers x ON x.fid = c.now WHERE k < 3 AND NOT list_contains(c.visited, x.caller)),
logs AS (SELECT anchor, -k AS up, 0 AS step, now AS fid, id FROM chain JOIN nodes ON nodes.fid = now AND NOT calls WHERE k > 0 UNION ALL SELECT anchor, 0, step, fid, id FROM walk WHERE fid IS NOT NULL)"""


@query(f"WITH RECURSIVE {WALK} SELECT anchor, row_number() OVER (PARTITION BY anchor ORDER BY up, step, id)::INT AS seq_no, logs.fid, (id + 1)::INT AS line, text FROM logs JOIN nodes USING (fid, id)")
def q_indexed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = order_nodes(spark, sf_dir)
    callers = nodes.filter("type = 'call'").select(F.col("call_target_id").alias("fid"), F.col("fid").alias("caller"))
    return alignment.indexed_logs(nodes, callers).select("anchor", "seq_no", "fid", "line", "text")
