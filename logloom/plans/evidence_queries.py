"""Evidence, store and stream queries: users are sessions, reports and findings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import evidence, store
from ..sources.events import messages
from ..streaming import fold, missions
from .registry import query, table


@query("""SELECT source, count(*) AS rows, round(count(*) FILTER (WHERE lang IS NULL OR lang = 'en') / count(*), 6)::DOUBLE AS worst_ratio, count(*) >= 5 AND round(count(*) FILTER (WHERE lang IS NULL OR lang = 'en') / count(*), 6) <= 0.2 AS healthy FROM documents GROUP BY source""")
def q_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("lang", F.when(F.col("lang") != "en", F.col("lang")))
    return evidence.health(d, ["text", "lang"], by="source").select("source", "rows", "worst_ratio", "healthy")


OUTCOME = "CASE event_type WHEN 'purchase' THEN 'passed' WHEN 'error' THEN 'error' WHEN 'click' THEN 'failed' WHEN 'view' THEN 'skipped' END"


def raw_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test report of each hour of events: one summary line for each outcome and test of the hour."""
    e = table(spark, sf_dir, "events").filter("event_type <> 'signup'")
    word = F.when(F.col("event_type") == "purchase", "PASSED").when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "FAILED").otherwise("SKIPPED [1]")
    line = F.concat(word, F.lit(" tests/t.py::test_"), F.get_json_object("props", "$.k"), F.lit(" - \u001b[31mreason\u001b[0m"))
    cases = e.select(F.date_trunc("hour", "ts").alias("hour"), line.alias("l")).distinct()
    text = F.concat(F.lit("=== FAILURES ===\nFAILED no::test\n=== short test summary info ===\n"), F.array_join(F.array_sort(F.collect_list("l")), "\n"), F.lit("\n======== 0 passed in 0.50s ========"))
    return cases.groupBy("hour").agg(text.alias("text"), F.lit(1).alias("exit_code"))


@query(f"""WITH c AS (SELECT DISTINCT date_trunc('hour', ts) AS hour, json_extract_string(props, '$.k') AS k, {OUTCOME} AS o FROM events WHERE event_type <> 'signup'),
n AS (SELECT hour, count(*) FILTER (WHERE o = 'passed')::INTEGER AS passed, count(*) FILTER (WHERE o = 'failed')::INTEGER AS failed, count(*) FILTER (WHERE o = 'error')::INTEGER AS errors, count(*) FILTER (WHERE o = 'skipped')::INTEGER AS skipped FROM c GROUP BY hour)
SELECT strftime(hour, '%Y-%m-%d %H') AS hour, passed, failed, CASE WHEN failed + errors = 0 THEN 1 ELSE errors END AS errors, skipped, false AS is_green FROM n""")
def q_report_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evidence.reports(raw_reports(spark, sf_dir), "hour", "text", "exit_code")
    return out.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "passed", "failed", "errors", "skipped", "is_green")


FINDINGS = """f AS (SELECT user_id AS id, count(*) FILTER (WHERE event_type = 'signup') > 12 AS locatable, count(*) FILTER (WHERE event_type = 'click' AND value > 20) AS tests,
count(*) FILTER (WHERE event_type = 'view') > 8 AS report, max(value) > 150 AS failure, min(value) > 0.5 AS nothing, count(*) FILTER (WHERE event_type = 'error') > 10 AS broken, count(*) % 2 = 0 AS related FROM events GROUP BY user_id),
v AS (SELECT id, CASE WHEN NOT locatable THEN 'unlocatable' WHEN tests = 0 THEN 'uncovered' WHEN NOT report THEN 'uncovered' WHEN failure THEN 'inconclusive' WHEN nothing THEN 'inconclusive' WHEN broken AND related THEN 'confirmed' WHEN broken THEN 'inconclusive' ELSE 'unreproduced' END AS status FROM f)"""


def verdicts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    f = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(
        (n("signup") > 12).alias("locatable"), F.count_if((F.col("event_type") == "click") & (F.col("value") > 20)).alias("tests"), (n("view") > 8).alias("report"), (F.max("value") > 150).alias("failure"), (F.min("value") > 0.5).alias("nothing"), (n("error") > 10).alias("broken"), (F.count("*") % 2 == 0).alias("related"),
    )
    return f.select("id", evidence.verdict(*[F.col(c) for c in ("locatable", "tests", "report", "failure", "nothing", "broken", "related")]).alias("status"))


@query(f"WITH {FINDINGS} SELECT id, status FROM v")
def q_verdict_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts_of(spark, sf_dir)


@query(f"WITH {FINDINGS}, s(status) AS (VALUES ('confirmed'), ('unreproduced'), ('uncovered'), ('unlocatable'), ('inconclusive')) SELECT s.status, count(v.id) AS n FROM s LEFT JOIN v USING (status) GROUP BY 1")
def q_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.tally(verdicts_of(spark, sf_dir))


@query("""WITH fn AS (SELECT c_custkey AS fid, c_mktsegment AS path, c_custkey AS lo, c_custkey + c_nationkey AS hi, c_nationkey AS span FROM customer),
fi AS (SELECT o_orderkey AS id, c_mktsegment AS file_path, o_custkey AS line FROM orders JOIN customer ON c_custkey = o_custkey),
i AS (SELECT id, fid, span, min(span) OVER (PARTITION BY id) AS best FROM fi JOIN fn ON path = file_path AND line BETWEEN lo AND hi)
SELECT id, fid, span::BIGINT AS span FROM i WHERE span = best""")
def q_interval_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    spans = c.select(F.col("c_custkey").alias("fid"), F.col("c_mktsegment").alias("path"), F.col("c_custkey").alias("start_line"), (F.col("c_custkey") + F.col("c_nationkey")).alias("end_line"))
    found = table(spark, sf_dir, "orders").join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("file_path")), "o_custkey")
    return evidence.located(found.select(F.col("o_orderkey").alias("id"), "file_path", F.col("o_custkey").alias("line")), spans)


@query("""SELECT o_custkey, o_orderkey, o_orderstatus, first_seen::VARCHAR AS first_seen FROM (SELECT *, min(o_orderdate) OVER (PARTITION BY o_custkey) AS first_seen, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def q_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = store.latest(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return out.select("o_custkey", "o_orderkey", "o_orderstatus", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"))


@query("""SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' UNION ALL
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def q_replace_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return store.replaced(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), ["o_custkey"])


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def q_newest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.newest(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", 50).select("o_orderkey", "o_custkey")


@query("SELECT event_id, user_id, json_extract_string(props, '$.k') AS item FROM events QUALIFY row_number() OVER (PARTITION BY user_id, item ORDER BY event_id) = 1")
def q_emit_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("item", F.get_json_object("props", "$.k"))
    return store.emit_once(e, "user_id", "item", "event_id").select("event_id", "user_id", "item")


@query("SELECT event_id, max(round(value * 1000)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id) AS t_ms FROM events")
def q_monotone_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("clock", F.round(F.col("value") * 1000).cast("bigint"))
    return store.monotone(e, "user_id", "event_id", "clock").select("event_id", "t_ms")


SESSIONS = "s AS (SELECT user_id AS session_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'red' WHEN 'purchase' THEN 'green' WHEN 'signup' THEN 'started' WHEN 'view' THEN 'line' ELSE 'other' END AS event, json_extract_string(props, '$.k') AS id FROM events)"
STATES = f"""WITH {SESSIONS}, f AS (SELECT session_id, min(seq) FILTER (WHERE event = 'red') AS first_red FROM s GROUP BY 1)
SELECT session_id::VARCHAR AS session_id, count(*) AS events, count(DISTINCT id) FILTER (WHERE event = 'line') AS lines,
CASE max_by(event, seq) FILTER (WHERE event IN ('started', 'red') OR (event = 'green' AND seq > first_red)) WHEN 'red' THEN 'reproduced' WHEN 'green' THEN 'verified' WHEN 'started' THEN 'started' END AS phase,
bool_or(event = 'red') AS red, coalesce(max(seq) FILTER (WHERE event = 'green') > max(seq) FILTER (WHERE event = 'red'), false) AS green
FROM s JOIN f USING (session_id) GROUP BY session_id"""


def session_events(e: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "red").when(F.col("event_type") == "purchase", "green").when(F.col("event_type") == "signup", "started").when(F.col("event_type") == "view", "line").otherwise("other")
    return e.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), kind.alias("event"), F.get_json_object("props", "$.k").alias("id"))


@query(STATES)
def q_fold_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.folded(session_events(table(spark, sf_dir, "events")))


def _shared(spark: SparkSession, name: str) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="spark-streams-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(STATES)
def s_fold_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same states from a stream of the events' file: each batch's states are appended, the furthest of a session counts."""
    path, out = f"{sf_dir}/events.parquet", _shared(spark, "states")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(path if _is_folder(spark, path) else path.replace("events.parquet", "event[s].parquet"))
    job = fold.fold_stream(session_events(stream)).writeStream.outputMode("update").option("checkpointLocation", _shared(spark, "stream")).trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("append").parquet(out)).start()
    job.awaitTermination()
    states = spark.read.parquet(out)
    return store.latest(states, ["session_id"], ["events"]).drop("first_seen")


def _is_folder(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


@query("SELECT doc_id, md5(regexp_replace(text, '(^|[^A-Za-z0-9_])(?:dtn_|nvapi-|sk-|ghp_)[A-Za-z0-9_\\-]{3,}', '\\1[REDACTED]', 'g')) AS md5 FROM documents")
def q_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(fn.redacted(F.col("text"))).alias("md5"))


@query(f"WITH {FINDINGS} SELECT id, coalesce(status = 'confirmed', false) AS can_act, CASE WHEN status = 'confirmed' THEN 'issue,pr' ELSE 'issue' END AS tools FROM v")
def q_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.coalesce(F.col("status") == "confirmed", F.lit(False))
    return verdicts_of(spark, sf_dir).select("id", ok.alias("can_act"), F.when(ok, "issue,pr").otherwise("issue").alias("tools"))


@query("""WITH r AS (SELECT event_id, user_id, event_type = 'error' AS is_broken, event_type = 'purchase' AS is_green FROM events WHERE event_type IN ('error', 'purchase', 'click'))
SELECT event_id, CASE WHEN is_broken THEN 'reproduce' WHEN is_green AND coalesce(bool_or(is_broken) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'verify' ELSE 'baseline' END AS kind FROM r""")
def q_run_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "events").filter("event_type IN ('error', 'purchase', 'click')").select("event_id", F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("is_broken"), (F.col("event_type") == "purchase").alias("is_green"))
    return fold.run_kind(r).select("event_id", "kind")


@query("SELECT conv_id, turn, role AS event, turn::VARCHAR AS id, md5(text) AS md5 FROM conversations")
def q_sse_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = F.concat(F.lit(": comment\nid: "), F.col("turn").cast("string"), F.lit("\nevent: "), "role", F.lit("\ndata: "), F.replace("text", F.lit("\n"), F.lit("\ndata: ")), F.lit("\r\n\r\n"))
    c = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("k"), frame.alias("s"))
    return messages(c, "k", "s").select("k.conv_id", "k.turn", "event", "id", F.md5("data").alias("md5"))


@query("""WITH l AS (SELECT conv_id, turn, [trim(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '[*_`#]+', '', 'g')) FOR x IN string_split('---' || chr(10) || '<b>' || text, chr(10))] AS lines FROM conversations)
SELECT conv_id, turn, substr(coalesce(list_filter(lines, lambda x: NOT regexp_matches(x, '^[-=_\\s]*$'))[1], ''), 1, 120) AS title FROM l""")
def q_comment_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", fn.clean_title(F.concat(F.lit("---\n<b>"), "text")).alias("title"))


def traced_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of each hour with blocks of errors and failures."""
    e = table(spark, sf_dir, "events").filter("event_type IN ('error', 'click')").withColumns({"hour": F.date_trunc("hour", "ts"), "k": F.get_json_object("props", "$.k"), "bad": F.col("event_type") == "error"})
    each = e.select("hour", "k", "bad").distinct()
    block = F.when(F.col("bad"), F.concat(F.lit("___ ERROR at setup of tests/t.py::test_"), "k", F.lit(" ___\n\nbad "), "k", F.lit("\n"))).otherwise(F.concat(F.lit("___ Suite::test_"), "k", F.lit(" ___\nboom "), "k"))
    line = F.concat(F.when(F.col("bad"), "ERROR").otherwise("FAILED"), F.lit(" tests/t.py::test_"), "k", F.lit(" - x"))
    listed = lambda c, bad: F.array_join(F.array_sort(F.collect_list(F.when(F.col("bad") == F.lit(bad), c))), "\n")
    text = F.concat(F.lit("=== ERRORS ===\n"), listed(block, True), F.lit("\n=== FAILURES ===\nnothing yet\n"), listed(block, False), F.lit("\n=== slowest durations ===\n0.25s call tests/t.py::test_1\n0.50s setup tests/t.py::test_1\n=== short test summary info ===\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\n======== 1 failed in 0.50s ========"))
    return each.groupBy("hour").agg(text.alias("text"), F.lit(1).alias("exit_code"))


@query("""WITH c AS (SELECT DISTINCT date_trunc('hour', ts) AS hour, json_extract_string(props, '$.k') AS k, event_type = 'error' AS bad FROM events WHERE event_type IN ('error', 'click'))
SELECT strftime(hour, '%Y-%m-%d %H') AS hour, 'tests/t.py::test_' || k AS node_id, CASE WHEN bad THEN 'error' ELSE 'failed' END AS outcome, CASE WHEN k = '1' THEN 0.75 ELSE 0.0 END::DOUBLE AS duration_s,
CASE WHEN bool_or(bad) OVER (PARTITION BY hour, k) THEN 'bad ' ELSE 'boom ' END || k AS traceback FROM c""")
def q_report_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = evidence.report_lines(traced_reports(spark, sf_dir), "hour", "text")
    return evidence.cases(lines, "hour").withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 2000 THEN substr(text, length(text) - 1999, 2000) ELSE text END) AS md5 FROM documents")
def q_raw_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(evidence.raw_tail(F.col("text"))).alias("md5"))


@query("""WITH r AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '== ' || p_size || '.1' WHEN 1 THEN '==' || p_size || '.*' WHEN 2 THEN '>=1,==' || p_size ELSE '' END AS spec, p_size FROM part)
SELECT p_partkey, lower(replace(p_brand, '#', '-')) AS name, CASE WHEN p_size % 4 = 0 THEN p_size || '.1' END AS pin FROM r JOIN part USING (p_partkey, p_size)""")
def q_requirement_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.expr("CASE p_size % 4 WHEN 0 THEN '== ' || p_size || '.1' WHEN 1 THEN '==' || p_size || '.*' WHEN 2 THEN '>=1,==' || p_size ELSE '' END")
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("# made by a tool\n-r other.txt\n"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("[extra] "), spec, F.lit(" ; python_version > '3' # why")).alias("text"))
    return evidence.requirements(p, "p_partkey", "text").select("p_partkey", "name", evidence.pinned(F.col("spec")).alias("pin"))


@query("""WITH fn AS (SELECT c_custkey AS fid, c_mktsegment AS path, c_custkey AS lo, c_custkey + c_nationkey AS hi, c_nationkey AS span, 'fn' || c_custkey % 20 AS name FROM customer),
fi AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'gone.py' ELSE c_mktsegment END AS file_path, o_custkey AS line FROM orders JOIN customer ON c_custkey = o_custkey),
i AS (SELECT id, fid, span, min(span) OVER (PARTITION BY id) AS best FROM fi JOIN fn ON path = file_path AND line BETWEEN lo AND hi),
s AS (SELECT fi.id, file_path, i.fid, name FROM fi LEFT JOIN i ON i.id = fi.id AND i.span = i.best LEFT JOIN fn ON fn.fid = i.fid),
n AS (SELECT id, count(fid) AS places, count(DISTINCT CASE WHEN fid % 2 = 0 THEN 't::' || fid END) AS tests, bool_or(coalesce(file_path = 'BUILDING' OR name IN ('fn3', 'fn4'), false)) AS rel FROM s GROUP BY id)
SELECT id, tests, CASE WHEN places = 0 THEN 'unlocatable' WHEN tests = 0 THEN 'uncovered' WHEN rel THEN 'confirmed' ELSE 'inconclusive' END AS status FROM n""")
def q_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as findings, located in customers as functions; a failing report names a file and two functions."""
    c = table(spark, sf_dir, "customer")
    functions = c.select(F.col("c_custkey").alias("fid"), F.col("c_mktsegment").alias("path"), F.col("c_custkey").alias("start_line"), (F.col("c_custkey") + F.col("c_nationkey")).alias("end_line"), F.expr("'fn' || c_custkey % 20").alias("name"))
    found = table(spark, sf_dir, "orders").join(c.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "gone.py").otherwise(F.col("c_mktsegment")).alias("file_path"), F.col("o_custkey").alias("line"))
    tests = functions.filter("fid % 2 = 0").select("fid", F.expr("'t::' || fid").alias("node_id"))
    told = c.filter("c_custkey IN (3, 4)").select(F.expr("'t::' || c_custkey").alias("node_id"), F.lit("failed").alias("outcome"), F.expr("'in fn' || c_custkey || ' of src/BUILDING'").alias("traceback"))
    reported = evidence.flagged(told.agg(F.lit(1).alias("exit_code"), F.count("*").cast("int").alias("failed"), F.lit(0).alias("errors"), F.lit(9).alias("passed")))
    return evidence.verified(found, functions, tests, reported, told)


MISSION = """CASE event_type WHEN 'signup' THEN CASE k % 6 WHEN 0 THEN 'runtime.connecting' WHEN 1 THEN 'runtime.connected' WHEN 2 THEN 'runtime.turn.started' WHEN 3 THEN 'runtime.turn.completed' WHEN 4 THEN 'runtime.failed' ELSE 'approval.required' END
WHEN 'error' THEN 'tests.red_observed' WHEN 'purchase' THEN 'tests.green_observed' WHEN 'view' THEN 'sandbox.line.appended'
ELSE CASE k % 6 WHEN 0 THEN 'approval.approved' WHEN 1 THEN 'approval.denied' WHEN 2 THEN 'approval.submitting' WHEN 3 THEN 'approval.resolved' WHEN 4 THEN 'approval.failed' ELSE CASE WHEN k < 10 THEN 'mission.reset' ELSE 'proof.node.updated' END END END"""
SAYS = "CASE WHEN event_type = 'click' AND k % 6 = 3 THEN CASE WHEN k % 4 < 2 THEN 'approve' ELSE 'deny' END WHEN event_type = 'click' AND k % 6 = 5 THEN CASE WHEN k < 10 THEN NULL ELSE 'imports' END ELSE 't' || k END"
RUNS = "CASE WHEN event_type = 'error' THEN CASE WHEN k % 5 = 0 THEN 'baseline' ELSE 'reproduce' END WHEN event_type = 'purchase' THEN CASE WHEN k % 6 = 0 THEN 'baseline' ELSE 'verify' END END"
EXITS = "CASE WHEN event_type = 'error' THEN 1 + k % 2 WHEN event_type = 'purchase' THEN CASE WHEN k % 4 = 3 THEN 1 ELSE 0 END END"


# One event after the other: each step takes the next one of every session.
MISSIONS = f"""x AS (SELECT user_id AS s, event_id AS seq, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events),
e AS (SELECT s, seq, {MISSION} AS type, {SAYS} AS text, k % 7 AS n, 'm' || k % 2 AS run, {RUNS} AS phase, {EXITS} AS code, row_number() OVER (PARTITION BY s ORDER BY seq) AS i FROM x),
f AS (SELECT *, type = 'tests.red_observed' AND phase <> 'baseline' AS red, type = 'tests.green_observed' AND phase <> 'baseline' AS green FROM e),
w AS (SELECT DISTINCT s, 0::BIGINT AS i, 'idle' AS status, NULL::VARCHAR AS error, FALSE AS asked, FALSE AS red, FALSE AS green, 0::BIGINT AS rt, 0::BIGINT AS gt, NULL::VARCHAR AS pending, 'idle' AS sub, NULL::VARCHAR AS ae, NULL::BOOLEAN AS approved, NULL::VARCHAR AS rr, NULL::VARCHAR AS gr, 0::BIGINT AS since FROM f UNION ALL
SELECT w.s, f.i, CASE f.type WHEN 'mission.reset' THEN 'idle' WHEN 'runtime.connecting' THEN 'connecting' WHEN 'runtime.connected' THEN 'idle' WHEN 'runtime.turn.started' THEN 'streaming' WHEN 'runtime.turn.completed' THEN CASE WHEN asked THEN 'awaiting_approval' ELSE 'completed' END WHEN 'runtime.failed' THEN 'failed' WHEN 'approval.required' THEN 'awaiting_approval' ELSE status END,
  CASE WHEN f.type IN ('mission.reset', 'runtime.connecting') THEN NULL WHEN f.type = 'runtime.failed' THEN f.text ELSE error END, CASE WHEN f.type = 'mission.reset' THEN FALSE ELSE asked OR f.type = 'approval.required' END,
  CASE WHEN f.type = 'mission.reset' THEN FALSE ELSE w.red OR f.red END, CASE WHEN f.type = 'mission.reset' OR f.red THEN FALSE WHEN f.green AND w.red THEN TRUE ELSE w.green END,
  CASE WHEN f.type = 'mission.reset' THEN 0 WHEN f.red THEN f.n WHEN f.type = 'tests.red_observed' THEN 0 ELSE rt END,
  CASE WHEN f.type = 'mission.reset' OR f.red THEN 0 WHEN f.green AND w.red THEN f.n WHEN f.type = 'tests.green_observed' AND f.phase = 'baseline' THEN CASE WHEN f.code = 0 THEN f.n ELSE 0 END ELSE gt END,
  CASE WHEN f.type = 'mission.reset' THEN NULL WHEN f.type = 'approval.required' THEN f.text ELSE pending END,
  CASE WHEN f.type = 'mission.reset' OR f.red THEN 'idle' WHEN f.type = 'approval.submitting' THEN 'submitting' WHEN f.type = 'approval.failed' THEN 'failed' WHEN f.type = 'approval.resolved' THEN CASE f.text WHEN 'approve' THEN 'accepted' ELSE 'denied' END WHEN f.type = 'approval.denied' AND approved IS NULL THEN 'denied' ELSE sub END,
  CASE WHEN f.type IN ('mission.reset', 'approval.submitting', 'approval.resolved') OR f.red THEN NULL WHEN f.type = 'approval.failed' THEN f.text ELSE ae END,
  CASE WHEN f.type = 'mission.reset' OR f.red THEN NULL WHEN f.type = 'approval.resolved' THEN f.text = 'approve' WHEN f.type = 'approval.denied' AND approved IS NULL THEN FALSE WHEN f.type = 'approval.approved' AND approved IS NULL AND asked AND sub <> 'submitting' AND rr IS NOT NULL AND rr = gr THEN TRUE ELSE approved END,
  CASE WHEN f.type = 'mission.reset' THEN NULL WHEN f.red THEN f.run ELSE rr END, CASE WHEN f.type = 'mission.reset' OR f.red THEN NULL WHEN f.green AND w.red THEN CASE WHEN f.code = 0 THEN f.run END ELSE gr END, CASE WHEN f.type = 'mission.reset' THEN f.seq ELSE since END
FROM w JOIN f ON f.s = w.s AND f.i = w.i + 1),
last AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY i DESC) = 1)"""
MISSIONS = f"""WITH RECURSIVE {MISSIONS} SELECT s::VARCHAR AS session_id, status, error, red, green, rt AS red_tests, gt AS green_tests, pending, sub AS submission, ae AS approval_error, approved,
(SELECT count(DISTINCT text) FROM f WHERE f.s = last.s AND type = 'sandbox.line.appended' AND seq > since OR f.s = last.s AND type = 'sandbox.line.appended' AND since = 0) AS lines,
EXISTS (SELECT 1 FROM f WHERE f.s = last.s AND type = 'proof.node.updated' AND (seq > since OR NOT EXISTS (SELECT 1 FROM f r WHERE r.s = last.s AND r.type = 'mission.reset'))) AS imports FROM last"""


def mission_events(e: DataFrame) -> DataFrame:
    told = e.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return told.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), F.expr(MISSION).alias("type"), F.expr(SAYS).alias("text"), F.lit("amber").alias("status"), (F.col("k") % 7).alias("n"), F.expr("'m' || k % 2").alias("run"), F.expr(RUNS).alias("phase"), F.expr(EXITS).cast("bigint").alias("exit_code"))


_TOLD = ["session_id", "status", "error", "red", "green", "red_tests", "green_tests", "pending", "submission", "approval_error", "approved", "lines"]


@query(MISSIONS)
def q_mission_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole states of sessions from their events."""
    got = missions.states(mission_events(table(spark, sf_dir, "events")))
    return got.select(*_TOLD, F.array_contains("nodes", "imports amber").alias("imports"))


@query(MISSIONS)
def s_mission_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of the events' file."""
    path, out = f"{sf_dir}/events.parquet", _shared(spark, "missions")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(path if _is_folder(spark, path) else path.replace("events.parquet", "event[s].parquet"))
    job = missions.state_stream(mission_events(stream)).writeStream.outputMode("update").option("checkpointLocation", _shared(spark, "missions-stream")).trigger(availableNow=True).foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)).start()
    job.awaitTermination()
    states = store.latest(spark.read.parquet(out), ["session_id"], ["batch"])
    return states.select(*_TOLD, F.array_contains("nodes", "imports amber").alias("imports"))
