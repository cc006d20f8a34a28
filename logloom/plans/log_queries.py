"""Log queries: documents are raw log texts, events are entries on threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LogProfile
from ..functions import text as fn
from ..operators import analysis, cluster, graph, logs, resolve, templates
from ..sources.logs import json_fields, text_lines
from .registry import query, table

PROFILE = LogProfile(entry_start=r"^[A-Z]", continuation_patterns=[r"^\s+", r"^The "])
LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"
LEVEL = r"replace(coalesce(nullif(lower(regexp_extract(line, '(?i)\b(TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL)\b', 1)), ''), 'info'), 'warning', 'warn')"
SIGNATURE = r"""trim(regexp_replace(line, '[0-9a-fA-F]{4,}|\d{4}-\d{2}-\d{2}[T_][\d:.]+Z?|\d+|"[^"]*"|''[^'']*''|\s+', ' ', 'g'))"""


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as entries: views have no function."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("entry_idx"), F.col("user_id").alias("thread_id"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("function"), (F.col("event_type") == "error").alias("is_error"), "value", "props", "ts", "event_type")


ENTRIES = "entries AS (SELECT event_id AS entry_idx, user_id AS thread_id, CASE WHEN event_type <> 'view' THEN event_type END AS function, event_type = 'error' AS is_error, value, props, ts, event_type FROM events)"


@query(f"""WITH {LINES},
flagged AS (SELECT *, CASE WHEN line_no > 1 AND regexp_matches(line, '^[A-Z]') AND NOT regexp_matches(line, '^\\s+') AND NOT regexp_matches(line, '^The ') THEN 1 ELSE 0 END AS s FROM lines),
numbered AS (SELECT *, 1 + sum(s) OVER (PARTITION BY doc_id ORDER BY line_no) AS entry_id FROM flagged)
SELECT doc_id, entry_id::BIGINT AS entry_id, min(line_no)::BIGINT AS line_number, max(line_no)::BIGINT AS line_end, sum(length(line))::BIGINT AS n_chars FROM numbered GROUP BY doc_id, entry_id""")
def q_entry_sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = logs.number_entries(lines_of(spark, sf_dir), PROFILE, "doc_id")
    return numbered.groupBy("doc_id", "entry_id").agg(F.min("line_no").alias("line_number"), F.max("line_no").alias("line_end"), F.sum(F.length("line")).alias("n_chars"))


SAID = "CASE event_type WHEN 'error' THEN 'at 9 ERROR ' WHEN 'view' THEN 'Warning: ' WHEN 'click' THEN '[debug] errors ' WHEN 'signup' THEN 'x Fatal,critical ' ELSE 'informed ' END || props"


@query(f"WITH e AS (SELECT user_id, {SAID} AS line FROM events) SELECT {LEVEL} AS level, count(*) AS n, count(DISTINCT user_id) AS users FROM e GROUP BY 1")
def q_level_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.expr(SAID).alias("line"))
    return e.groupBy(fn.level(F.col("line")).alias("level")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("""WITH l AS (SELECT event_id, CASE WHEN value > 20 THEN '2024-01-01 10:00:00 [t' || user_id || '] ' || event_type || ' : ' || props ELSE '2024-01-01 10:00:00 at ' || event_type || ' - ' || props END AS line, props FROM events)
SELECT event_id, props AS message FROM l""")
def q_message_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    stamp = F.lit("2024-01-01 10:00:00 ")
    line = F.when(F.col("value") > 20, F.concat(stamp, F.lit("[t"), F.col("user_id").cast("string"), F.lit("] "), "event_type", F.lit(" : "), "props")).otherwise(F.concat(stamp, F.lit("at "), "event_type", F.lit(" - "), "props"))
    return e.select("event_id", fn.message(line, r"^\d{4}-\d{2}-\d{2}", [" : ", " - "]).alias("message"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.absent') AS absent FROM events")
def q_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", json_fields(F.col("props"), {"k": "k", "absent": "absent"}).alias("f")).select("event_id", "f.k", "f.absent")


@query("""SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error' OR regexp_matches(props, '9\\d\\}')) AS errors FROM events
WHERE NOT regexp_matches(event_type || props, 'view.*: 1\\d\\}') GROUP BY user_id""")
def q_error_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = LogProfile(error_markers=[r"9\d\}"], ignore_patterns=[r"view.*: 1\d\}"])
    e = table(spark, sf_dir, "events").withColumn("raw_text", F.concat("event_type", "props"))
    flag = (F.col("event_type").isin(profile.error_levels)) | fn.matches_any(F.col("raw_text"), profile.error_markers)
    return logs.kept(e, profile).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(flag).alias("errors"))


@query(f"""WITH {LINES}, told AS (SELECT doc_id * 1000000 + line_no AS idx, {LEVEL} AS level, {SIGNATURE} AS sig FROM lines)
SELECT min(idx)::BIGINT AS entry_idx, count(*) AS repeat_count FROM told GROUP BY CASE WHEN level IN ('error', 'fatal', 'severe', 'warn') THEN idx END, CASE WHEN level IN ('error', 'fatal', 'severe', 'warn') THEN NULL ELSE sig END""")
def q_signature_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = lines_of(spark, sf_dir).select((F.col("doc_id") * 1000000 + F.col("line_no")).alias("entry_idx"), fn.level(F.col("line")).alias("level"), F.col("line").alias("static_text"))
    return logs.deduplicated(told).select("entry_idx", "repeat_count")


TEMPLATES = """heads AS (SELECT doc_id AS fid, string_split(text, chr(10))[1] AS head FROM documents),
raw AS (SELECT fid, [substr(head, 1, 12), string_split(head, ' ')[-1]] AS frags FROM heads),
templates AS (SELECT fid, frags, trim(frags[1]) AS key FROM raw WHERE length(trim(frags[1])) >= 3),
messages AS (SELECT DISTINCT line AS t FROM lines),
hits AS (SELECT t, key FROM messages, (SELECT DISTINCT key FROM templates) WHERE substr(t, 1, 3) = substr(key, 1, 3) AND starts_with(t, key)),
longest AS (SELECT t, max_by(key, length(key)) AS key FROM hits GROUP BY t),
pairs AS (SELECT t, fid FROM longest JOIN templates USING (key) WHERE strpos(substr(t, length(frags[1]) + 1), frags[2]) > 0)"""


def document_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.get(F.split("text", "\n"), F.lit(0))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fid"), F.array(F.substring(head, 1, 12), F.element_at(F.split(head, " "), -1)).alias("frags"), F.lit("head").alias("fname"), F.lit(1).alias("line"))


@query(f"WITH {LINES}, {TEMPLATES} SELECT t AS line, count(DISTINCT fid) AS candidates, min(fid) AS fid FROM pairs GROUP BY t")
def q_template_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.counted(lines_of(spark, sf_dir), document_templates(spark, sf_dir).drop("line"), "line")


@query(f"WITH {LINES}, {TEMPLATES} SELECT key, count(*) AS messages FROM longest GROUP BY key")
def q_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = templates.admitted(document_templates(spark, sf_dir))
    found = templates.longest_prefix(lines_of(spark, sf_dir), ready.select("key").distinct(), "line")
    return found.groupBy("key").agg(F.count("*").alias("messages"))


STATUS = f"""WITH {LINES}, {TEMPLATES}, n AS (SELECT t, count(DISTINCT fid) AS n FROM pairs GROUP BY t),
statuses AS (SELECT CASE WHEN length(line) < 5 THEN 'skip' WHEN n IS NULL THEN 'miss' WHEN n = 1 THEN 'hit' ELSE 'ambiguous' END AS status FROM lines LEFT JOIN n ON t = line)"""


def resolved_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = lines_of(spark, sf_dir).select((F.col("doc_id") * 1000000 + F.col("line_no")).alias("entry_idx"), F.col("line").alias("static_text"))
    return resolve.first_pass(entries, document_templates(spark, sf_dir))


@query(STATUS + " SELECT status, CASE WHEN status = 'hit' THEN 2 ELSE 4 END AS tier, count(*) AS n FROM statuses GROUP BY 1, 2")
def q_resolution_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved_lines(spark, sf_dir).groupBy("status", "tier").agg(F.count("*").alias("n"))


@query(STATUS + " SELECT count(*) AS n, count(*) FILTER (WHERE status = 'hit') AS resolved, round(100.0 * count(*) FILTER (WHERE status = 'hit') / count(*), 1)::DOUBLE AS coverage_pct FROM statuses")
def q_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.coverage(resolved_lines(spark, sf_dir)).withColumn("coverage_pct", F.col("coverage_pct").cast("double"))


@query("SELECT event_id, array_to_string(list_filter([trim(x) FOR x IN regexp_split_to_array(event_type || ' of ' || props || ' for %s at $user', '\\$\\{[^}]*\\}|\\$\\w+|\\{[^}]*\\}|%[-+0 #]*\\d*(?:\\.\\d+)?[sdifgxXc]')], lambda x: x <> ''), '|') AS fragments FROM events")
def q_fragment_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat("event_type", F.lit(" of "), "props", F.lit(" for %s at $user"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(fn.fragments(line), "|").alias("fragments"))


@query(f"WITH {ENTRIES} SELECT entry_idx, function, last_value(function IGNORE NULLS) OVER (PARTITION BY thread_id ORDER BY entry_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM entries")
def q_prev_on_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.previous_on_thread(events_of(spark, sf_dir), "thread_id", "entry_idx", "function").select("entry_idx", "function", "previous")


@query(f"""WITH {ENTRIES}, t AS (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN 4 ELSE 2 END AS tier FROM entries)
SELECT DISTINCT a.entry_idx FROM t a JOIN t b ON a.tier = 4 AND b.tier <= 3 AND a.thread_id = b.thread_id AND b.entry_idx BETWEEN a.entry_idx - 3 AND a.entry_idx + 3""")
def q_neighbour_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = events_of(spark, sf_dir).withColumn("tier", F.when(F.col("event_type").isin("view", "click"), 4).otherwise(2))
    return resolve.near_resolved(tiers, "entry_idx", "tier", "thread_id")


CLUSTERED = f"""WITH {ENTRIES}, numbered AS (SELECT *, greatest(1, sum(CASE WHEN function = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY thread_id ORDER BY entry_idx)) AS cluster_no FROM entries)"""


@query(CLUSTERED + " SELECT thread_id, cluster_no::BIGINT AS cluster_no, min_by(function, entry_idx) FILTER (WHERE function IS NOT NULL) AS anchor, min(entry_idx) AS first, max(entry_idx) AS last, count(*) AS n FROM numbered GROUP BY 1, 2 HAVING count(function) > 0")
def q_thread_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_of(spark, sf_dir)
    anchors = e.filter("function = 'signup'").select("function")
    found = cluster.cluster_summary(cluster.thread_clusters(e, anchors, "thread_id", "entry_idx", "function"), "thread_id", "entry_idx", "function")
    return found.withColumn("cluster_no", F.col("cluster_no").cast("bigint"))


FAULTS = f"{ENTRIES}, faults AS (SELECT *, json_extract_string(props, '$.k')::BIGINT AS fid, 'f' || json_extract_string(props, '$.k') AS name FROM entries)"


def faults_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return events_of(spark, sf_dir).withColumns({"fid": k.cast("bigint"), "name": F.concat(F.lit("f"), k)})


@query(f"""WITH {FAULTS}, e AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY entry_idx) AS r FROM faults WHERE is_error)
SELECT fid, max(name) AS name, count(*) AS error_count, min(entry_idx) AS first_idx, string_agg(CASE WHEN r <= 5 THEN thread_id || ' ' || props END, '|' ORDER BY entry_idx) AS samples FROM e GROUP BY fid""")
def q_error_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = faults_of(spark, sf_dir).withColumn("text", F.concat_ws(" ", F.col("thread_id").cast("string"), "props"))
    return cluster.error_clusters(named, "entry_idx", "fid", "name", "text").withColumn("samples", F.array_join("samples", "|"))


@query(f"""WITH {FAULTS}, e AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY entry_idx) AS r FROM faults WHERE is_error),
near AS (SELECT DISTINCT e.fid, b.name FROM e JOIN faults b ON e.r <= 3 AND b.entry_idx BETWEEN e.entry_idx - 3 AND e.entry_idx + 3 AND b.name <> e.name),
ranked AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY name) AS n FROM near)
SELECT fid, string_agg(name, ',' ORDER BY name) AS related FROM ranked WHERE n <= 8 GROUP BY fid""")
def q_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.related_functions(faults_of(spark, sf_dir), "entry_idx", "fid", "name").withColumn("related", F.array_join("related", ","))


@query(f"WITH {FAULTS} SELECT DISTINCT a.entry_idx, a.thread_id, a.event_type FROM faults a JOIN faults b ON b.is_error AND b.fid >= 95 AND a.entry_idx BETWEEN b.entry_idx - 10 AND b.entry_idx + 5")
def q_context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = faults_of(spark, sf_dir)
    return cluster.windows(e, e.filter("is_error AND fid >= 95"), "entry_idx").select("entry_idx", "thread_id", "event_type")


ALIGNED = f"{ENTRIES}, expected(function, ord) AS (VALUES ('signup', 1), ('click', 2), ('purchase', 3)), aligned AS (SELECT entries.*, ord FROM entries LEFT JOIN expected USING (function))"


def aligned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = spark.createDataFrame([("signup", 1), ("click", 2), ("purchase", 3)], "function string, ord int")
    return cluster.aligned(events_of(spark, sf_dir), F.broadcast(expected), "thread_id", "entry_idx", "function")


@query(f"WITH {ALIGNED} SELECT thread_id, count(function) AS with_function, count(ord) AS matched, round(100.0 * count(ord) / greatest(count(function), 1), 1)::DOUBLE AS coverage FROM aligned GROUP BY thread_id")
def q_alignment_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.thread_coverage(aligned_events(spark, sf_dir), "thread_id", "function").withColumn("coverage", F.col("coverage").cast("double"))


@query(f"""WITH {ALIGNED}, odd AS (SELECT thread_id, entry_idx, CASE WHEN is_error THEN 'error_unmapped' ELSE 'unexpected_entry' END AS divergence FROM aligned WHERE function IS NOT NULL AND ord IS NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY entry_idx) AS r FROM odd WHERE thread_id IN (SELECT DISTINCT thread_id FROM odd ORDER BY thread_id LIMIT 5))
SELECT thread_id, entry_idx, divergence FROM ranked WHERE r <= 8""")
def q_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.divergence_report(aligned_events(spark, sf_dir), "thread_id", "entry_idx").select("thread_id", "entry_idx", "divergence")


@query(f"WITH {ENTRIES} SELECT thread_id::VARCHAR AS thread_id, count(*) AS n FROM entries WHERE thread_id IN (SELECT thread_id FROM entries WHERE is_error AND value > 50) GROUP BY 1")
def q_error_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = events_of(spark, sf_dir).withColumn("bad", F.col("is_error") & (F.col("value") > 50))
    return cluster.error_threads(hot, "thread_id", "bad").groupBy("thread_id").agg(F.count("*").alias("n"))


@query(f"""WITH {ENTRIES}, direct AS (SELECT entry_idx, 'name' AS how FROM entries WHERE function = 'purchase'),
lost AS (SELECT DISTINCT a.entry_idx FROM (SELECT * FROM entries WHERE event_type = 'view' AND value > 30) a JOIN direct d ON d.entry_idx BETWEEN a.entry_idx - 3 AND a.entry_idx + 3)
SELECT * FROM direct UNION ALL SELECT entry_idx, 'neighbour' FROM lost""")
def q_owned_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_of(spark, sf_dir).withColumns({"fid": F.lit(-1).cast("bigint"), "bad": (F.col("event_type") == "view") & (F.col("value") > 30)})
    return cluster.owned(e, spark.createDataFrame([(7, "Purchase")], "fid bigint, name string"), "entry_idx", "fid", "function", "bad")


@query(f"""WITH {FAULTS}, e AS (SELECT *, CASE WHEN value > 1 THEN 1 ELSE 2 END AS tier FROM faults WHERE is_error),
sums AS (SELECT grp, count(*) AS errors, count(DISTINCT fid) AS roots, bool_and(tier = 1) AS certain, min(fid) AS first FROM (SELECT 'all' AS grp, * FROM e UNION ALL SELECT 'one', * FROM e WHERE fid = (SELECT min(fid) FROM e WHERE value > 1) AND value > 1) GROUP BY grp)
SELECT grp, errors, roots, certain AND roots = 1 AS obvious, CASE WHEN certain AND roots = 1 THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN certain AND roots = 1 THEN first END AS root FROM sums""")
def q_obvious_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = faults_of(spark, sf_dir).filter("is_error").withColumn("tier", F.when(F.col("value") > 1, 1).otherwise(2))
    least = errors.filter("tier = 1").agg(F.min("fid").alias("fid"))
    one = errors.filter("tier = 1").join(F.broadcast(least), "fid")  # the least root alone: a row
    told = lambda found, grp: cluster.obvious_cause(found, "tier", "fid").withColumn("grp", F.lit(grp))
    return told(errors, "all").unionByName(told(one, "one")).withColumn("confidence", F.col("confidence").cast("double"))


TOLD = """e AS (SELECT event_id AS entry_idx, user_id % 7 AS t, event_type AS et, value AS v, json_extract_string(props, '$.k')::BIGINT AS k FROM events),
ks AS (SELECT DISTINCT k FROM e), edges AS (SELECT k AS src, (3 * k + 1) % 100 AS dst FROM ks), cands AS (SELECT k, unnest(list_distinct([k, (k + 1) % 100, (7 * k) % 100])) AS c FROM ks),
hopw AS (SELECT k AS src, k AS dst, 0 AS h FROM ks UNION SELECT hopw.src, edges.dst, h + 1 FROM hopw JOIN edges ON edges.src = hopw.dst WHERE h < 6),
hops AS (SELECT src, dst, min(h) AS h FROM hopw GROUP BY 1, 2), prevs AS (SELECT -1 AS p UNION SELECT k FROM ks UNION SELECT c FROM cands),
scored AS (SELECT k, p, c, CASE WHEN p = -1 THEN 0.4::DOUBLE WHEN p = c THEN 0.9::DOUBLE WHEN h > 0 THEN 0.4::DOUBLE + 0.5::DOUBLE / h ELSE 0.4::DOUBLE END AS s FROM cands CROSS JOIN prevs LEFT JOIN hops ON src = p AND dst = c),
ranked AS (SELECT *, row_number() OVER w AS r, lead(s) OVER w AS nxt FROM scored WINDOW w AS (PARTITION BY k, p ORDER BY s DESC, c)),
moves AS (SELECT k, p, c AS best, s, CASE WHEN s > 0.5 AND s - coalesce(nxt, 0) > 0.2 THEN 'resolved' ELSE 'branch' END AS decision FROM ranked WHERE r = 1),
steps AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY entry_idx) AS n FROM e WHERE et = 'click' OR (et = 'signup' AND v <= 20) OR (et = 'purchase' AND v > 5)),
walk AS (SELECT DISTINCT t, 0::BIGINT AS n, -1::BIGINT AS prev, NULL::BIGINT AS entry_idx, NULL::VARCHAR AS decision, NULL::DOUBLE AS s FROM steps UNION ALL
SELECT steps.t, steps.n, CASE WHEN et = 'click' THEN best ELSE steps.k END, steps.entry_idx, moves.decision, moves.s FROM walk JOIN steps ON steps.t = walk.t AND steps.n = walk.n + 1 JOIN moves ON moves.k = steps.k AND moves.p = walk.prev),
told AS (SELECT e.*, CASE WHEN et = 'click' THEN w.decision END AS decision, CASE WHEN et = 'click' THEN w.prev WHEN et = 'error' OR (et = 'signup' AND v > 20) OR (et = 'purchase' AND v <= 5) THEN NULL ELSE e.k END AS fid,
CASE WHEN et = 'signup' AND v <= 20 THEN 1 WHEN et = 'view' THEN 2 WHEN et = 'click' OR (et = 'purchase' AND v > 5) THEN 3 ELSE 4 END AS tier,
CASE WHEN et = 'signup' AND v <= 20 THEN 0.95 WHEN et = 'view' THEN 0.85 WHEN et = 'click' THEN w.s WHEN et = 'purchase' AND v > 5 THEN 0.6 ELSE 0.0 END::DOUBLE AS confidence, et = 'purchase' AND v > 5 AS inferred FROM e LEFT JOIN walk w USING (entry_idx)),
near AS (SELECT DISTINCT a.entry_idx FROM told a JOIN told b ON a.t = b.t AND b.tier <= 3 AND b.entry_idx BETWEEN a.entry_idx - 3 AND a.entry_idx + 3 WHERE a.et = 'signup' AND a.tier = 4)"""


def told_entries(spark: SparkSession, sf_dir: str, *more: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Entries (and more columns of their events), templates, functions and calls: views fit one template, clicks several, purchases a class, signups have traces.

    Templates, functions and calls come from the few distinct items, which are read from the events once.
    """
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = table(spark, sf_dir, "events").withColumns({"k": k, "t": F.col("user_id") % 7})
    kind = F.col("event_type")
    known = kind.isin("purchase", "signup") & ~((kind == "purchase") & (F.col("value") <= 5))
    message = F.when(kind == "view", F.expr("'view item ' || k || ': seen'")).when(kind == "click", F.expr("'click item ' || k || ': done'")).when(kind == "error", "err")
    message = message.when((kind == "purchase") & (F.col("value") > 20), F.expr("'bought after view item ' || k || ': paid'")).when(kind == "purchase", F.expr("'bought by fn' || k")).otherwise(F.expr("'signup of fn' || k || ' here'"))
    owner = F.expr("'C' || k % 10")
    entries = e.select(F.col("event_id").alias("entry_idx"), F.col("t").alias("thread_id"), message.alias("static_text"), F.when(known, owner).alias("class_name"), (kind == "signup").alias("stack"), F.when((kind == "signup") & (F.col("value") <= 20), F.concat(owner, F.expr("'.fn' || k"))).alias("frame"), *more)
    ks = graph.written(e.select("k").distinct())
    views = ks.select(F.col("k").alias("fid"), F.array(F.expr("'view item ' || k || ':'")).alias("frags"))
    clicks = ks.select(F.explode(F.array_distinct(F.expr("array(k, (k + 1) % 100, (7 * k) % 100)"))).alias("fid"), F.array(F.expr("'click item ' || k || ':'")).alias("frags"))
    templates_ = views.unionByName(clicks).withColumns({"fname": F.expr("'fn' || fid"), "line": F.lit(1)})
    functions = ks.select(F.col("k").alias("fid"), owner.alias("class_name"), F.expr("'fn' || k").alias("name"), F.lit(None).cast("string").alias("source"), F.array(F.expr("'view item ' || k || ':'")).alias("templates"))
    return entries, templates_, functions, ks.select(F.col("k").alias("src"), ((3 * F.col("k") + 1) % 100).alias("dst"))


def told(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.attributed(*told_entries(spark, sf_dir))


@query(f"""WITH RECURSIVE {TOLD}, both_ AS (SELECT told.*, near.entry_idx IS NOT NULL AS close_ FROM told LEFT JOIN near ON near.entry_idx = told.entry_idx)
SELECT entry_idx, CASE WHEN close_ THEN 3 ELSE tier END::INTEGER AS tier, round(CASE WHEN close_ THEN 0.55 ELSE confidence END, 6)::DOUBLE AS confidence, CASE WHEN close_ THEN k ELSE fid END AS fid, coalesce(decision, '') AS decision, inferred OR close_ AS inferred FROM both_""")
def q_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiers from messages, traces, classes, calls and neighbours."""
    return told(spark, sf_dir).select("entry_idx", "tier", F.round("confidence", 6).alias("confidence"), "fid", "decision", "inferred")


#: A log of events: a line for each, signups with a trace below, of which half has frames of the platform alone.
LOG_PROFILE = LogProfile(
    line_pattern=r"^(?P<timestamp>\S+ \S+) \[(?P<thread>[^\]]+)\] (?P<level>[A-Z]+) (?P<logger>[\w.$]*) : (?P<message>.*)",
    continuation_patterns=[r"^\s+at ", r"^java\."], ignore_patterns=["view item 9\\d: seen"], known_errors=[{"pattern": "item 13: done"}], framework_markers=["org.apache"],
)
LOG_TOLD = (
    TOLD.replace("FROM events)", "FROM events WHERE NOT (event_type = 'view' AND json_extract_string(props, '$.k')::BIGINT >= 90) AND NOT (event_type = 'click' AND json_extract_string(props, '$.k')::BIGINT = 13))", 1)
    .replace("ks AS (SELECT DISTINCT k FROM e)", "ks AS (SELECT DISTINCT json_extract_string(props, '$.k')::BIGINT AS k FROM events)")
    .replace("(et = 'signup' AND v <= 20)", "et = 'signup'")
    .replace("CASE WHEN et = 'click' THEN best ELSE steps.k END", "CASE WHEN et = 'click' THEN best WHEN et = 'signup' AND v > 20 THEN -1 ELSE steps.k END")
    .replace("WHEN et = 'signup' AND v <= 20 THEN 1", "WHEN et = 'signup' THEN 1").replace("WHEN et = 'signup' AND v <= 20 THEN 0.95", "WHEN et = 'signup' THEN 0.95")
)


def event_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Lines of one log file (numbered with gaps), templates, functions and calls."""
    e, templates_, functions, calls = told_entries(spark, sf_dir, "value", "event_type")
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    message = F.when((F.col("event_type") == "purchase") & (F.col("value") <= 2), "bought by org.apache").otherwise(F.col("static_text"))
    head = F.concat(F.lit("2024-01-01 10:00:00 [t"), F.col("thread_id").cast("string"), F.lit("] "), level, F.lit(" "), F.coalesce(F.concat(F.lit("app."), "class_name"), F.lit("")), F.lit(" : "), message)
    own = F.coalesce(F.concat(F.lit("\tat "), "frame", F.lit("(File.java:7)")), F.lit("\tat java.util.Map.get(Map.java:2)"))
    lines = F.when(F.col("event_type") == "signup", F.array(head, F.lit("java.lang.IllegalStateException: bad"), own, F.lit("\tat java.util.List.get(List.java:1)"))).otherwise(F.array(head))
    told = e.select(F.lit("app.log").alias("file"), "entry_idx", F.posexplode(lines).alias("n", "line"))
    return told.select("file", (F.col("entry_idx") * 4 + F.col("n") + 1).alias("line_no"), "line"), templates_, functions, calls


@query(f"""WITH RECURSIVE {LOG_TOLD} SELECT entry_idx, (4 * entry_idx + CASE WHEN et = 'signup' THEN 4 ELSE 1 END)::BIGINT AS line_end, tier, round(confidence, 6)::DOUBLE AS confidence, CASE WHEN et = 'signup' AND v > 20 THEN NULL ELSE fid END AS fid, coalesce(decision, '') AS decision, inferred,
et = 'error' AS is_error, CASE WHEN et = 'view' THEN 1 END AS line, CASE WHEN et = 'signup' THEN CASE WHEN v <= 20 THEN 'C' || k % 10 || '.fn' || k ELSE 'java.util.Map.get' END END AS trace, CASE WHEN et = 'purchase' AND v > 5 THEN 'C' || k % 10 END AS origin_class, et = 'purchase' AND v <= 2 AS framework FROM told""")
def q_resolve_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines through sessions, fields, filters, traces, classes and all tiers."""
    lines, *rest = event_log(spark, sf_dir)
    got = analysis.resolved(lines, LOG_PROFILE, *rest)
    return got.select(((F.col("line_number") - 1) / 4).cast("long").alias("entry_idx"), "line_end", "tier", F.round("confidence", 6).alias("confidence"), "fid", "decision", "inferred", "is_error", "line", F.get("trace", F.lit(0)).alias("trace"), "origin_class", "framework")


@query(f"""WITH RECURSIVE {TOLD}, others AS (SELECT entry_idx, fid, array_to_string([fid] || list_sort(list_filter(list_distinct([k, (k + 1) % 100, (7 * k) % 100]), lambda x: x <> fid)), ',') AS fids FROM told WHERE decision = 'branch') SELECT entry_idx, fids FROM others""")
def q_branch_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best candidates of entries that no candidate leads."""
    return told(spark, sf_dir).filter("decision = 'branch'").select("entry_idx", F.array_join(F.col("fids").cast("array<string>"), ",").alias("fids"))


@query(f"""WITH {FAULTS}, e AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY entry_idx) AS r FROM faults WHERE is_error),
near AS (SELECT DISTINCT e.fid, b.name FROM e JOIN faults b ON e.r <= 3 AND b.entry_idx BETWEEN e.entry_idx - 3 AND e.entry_idx + 3 AND b.name <> e.name),
ranked AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY name) AS n FROM near), rel AS (SELECT fid, string_agg(name, ',' ORDER BY name) AS related FROM ranked WHERE n <= 5 GROUP BY fid),
c AS (SELECT fid, max(name) AS function, count(*) AS error_count, string_agg(CASE WHEN r <= 2 THEN thread_id || ' ' || props END, '; ' ORDER BY entry_idx) AS s FROM e GROUP BY fid)
SELECT 'c_' || fid AS id, function, error_count, CASE WHEN fid % 2 = 0 THEN 'about ' || function ELSE s END AS summary, coalesce(related, '') AS related FROM c LEFT JOIN rel USING (fid)""")
def q_cluster_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even functions have a summary; the others show their first messages."""
    named = faults_of(spark, sf_dir).withColumn("text", F.concat_ws(" ", F.col("thread_id").cast("string"), "props"))
    clusters = cluster.error_clusters(named, "entry_idx", "fid", "name", "text")
    summaries = named.select("fid").distinct().filter("fid % 2 = 0").withColumn("summary", F.expr("'about f' || fid"))
    told = cluster.choices(clusters, cluster.related_functions(named, "entry_idx", "fid", "name"), summaries)
    return told.withColumn("related", F.array_join("related", ","))


@query(f"WITH {FAULTS} SELECT entry_idx, fid FROM faults WHERE is_error AND fid IN (3, 70, 71)")
def q_selected_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.selected(faults_of(spark, sf_dir), "c_3, c_70,c_71", "fid").select("entry_idx", "fid")


@query(f"""WITH {ENTRIES}, places AS (SELECT entry_idx AS error_idx, unnest(range(entry_idx - 3, entry_idx + 3)) AS entry_idx FROM entries WHERE is_error)
SELECT error_idx, entry_idx, coalesce(function, '?') AS function, entry_idx = error_idx AS marked FROM places JOIN entries USING (entry_idx)""")
def q_error_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.error_flow(events_of(spark, sf_dir), "entry_idx", "function")
