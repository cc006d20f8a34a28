"""Queries of stack traces, patches and names: events are entries with a trace below."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LogProfile
from ..operators import evidence, graph, logs, resolve
from .registry import query, table

JAVA = LogProfile(entry_start=r"^\d{4}-\d{2}-\d{2}")
PYTHON = LogProfile(entry_start=r"^\d{4}-\d{2}-\d{2}", continuation_patterns=[r"^\s+", r"^Traceback", r"^\w+Error"], language="python")
#: The number in an event's properties, and whose frames an event's trace has.
K = "json_extract_string(props, '$.k')::BIGINT"
TRACED = f"t AS (SELECT event_id AS id, event_type AS et, {K} AS k FROM events WHERE event_type IN ('error', 'signup', 'click'))"


def traces(spark: SparkSession, sf_dir: str, language: str = "java") -> DataFrame:
    """id, lines: errors have a trace with a cause, signups one with frames of the platform, clicks none."""
    e = table(spark, sf_dir, "events").filter("event_type IN ('error', 'signup', 'click')").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    said = lambda text: F.expr(text)
    head = F.lit("2024-01-01 10:00:00 ERROR it broke")
    if language == "python":
        below = F.array(F.lit("Traceback (most recent call last):"), said("concat('  File \"app/m', k % 5, '.py\", line ', k + 1, ', in fn', k % 3)"), F.lit("    call()"), said("concat('  File \"lib/x.py\", line 7, in go', k % 2)"), said("concat('ValueError: bad ', k)"))
    else:
        error = F.array(
            said("concat('app.BadException: no ', k)"), said("concat('\\tat app/app.C', k % 5, '.fn', k % 3, '(File.java:', k + 1, ')')"), F.lit("\tat java.util.List.get(List.java:9)"), said("concat('\\tat org.fw.Proxy$', k % 2, '.<init>(Proxy.java:3)')"), F.lit("\t... 12 more"),
            said("concat('Caused by: io.NetError: down ', k)"), said("concat('\\tat net.S', k % 4, '.send(S.java:5)')"), F.lit("Caused by: io.Deep: "), F.lit("words"),
        )
        below = F.when(F.col("event_type") == "error", error).otherwise(F.array(F.lit("\tat java.util.Map.get(Map.java:2)"), F.lit("\tat sun.misc.X.y(X.java:4)")))
    return e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", F.array(head)).otherwise(F.concat(F.array(head), below)).alias("lines"))


@query(f"""WITH {TRACED} SELECT id, 0::BIGINT AS cause_depth, 0 AS frame_idx, 'app.C' || k % 5 AS class_name, 'fn' || k % 3 AS method, 'File.java' AS file, (k + 1)::INT AS line FROM t WHERE et = 'error' UNION ALL SELECT id, 0, 1, 'java.util.List', 'get', 'List.java', 9 FROM t WHERE et = 'error'
UNION ALL SELECT id, 0, 2, 'org.fw.Proxy$' || k % 2, '<init>', 'Proxy.java', 3 FROM t WHERE et = 'error' UNION ALL SELECT id, 1, 0, 'net.S' || k % 4, 'send', 'S.java', 5 FROM t WHERE et = 'error' UNION ALL SELECT id, 0, 0, 'java.util.Map', 'get', 'Map.java', 2 FROM t WHERE et = 'signup' UNION ALL SELECT id, 0, 1, 'sun.misc.X', 'y', 'X.java', 4 FROM t WHERE et = 'signup'""")
def q_stack_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.stack_frames(traces(spark, sf_dir), JAVA, ["id"])


@query(f"WITH {TRACED} SELECT id, 0::INT AS cause_depth, 'app.BadException' AS exception, 'no ' || k AS message FROM t WHERE et = 'error' UNION ALL SELECT id, 1, 'io.NetError', 'down ' || k FROM t WHERE et = 'error' UNION ALL SELECT id, 2, 'io.Deep', '' FROM t WHERE et = 'error'")
def q_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.exceptions(traces(spark, sf_dir), JAVA, ["id"])


@query(f"""WITH {TRACED}, f AS (SELECT * FROM t WHERE et <> 'click') SELECT id, 0::BIGINT AS cause_depth, 0 AS frame_idx, 'app/m' || k % 5 || '.py' AS class_name, 'fn' || k % 3 AS method, (k + 1)::INT AS line, 'bad ' || k AS message FROM f UNION ALL SELECT id, 0, 1, 'lib/x.py', 'go' || k % 2, 7, 'bad ' || k FROM f""")
def q_python_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = traces(spark, sf_dir, "python")
    return logs.stack_frames(found, PYTHON, ["id"]).drop("file").join(logs.exceptions(found, PYTHON, ["id"]).select("id", "message"), "id")


@query(f"WITH {TRACED} SELECT id, CASE et WHEN 'error' THEN 'app.C' || k % 5 || '.fn' || k % 3 ELSE 'java.util.Map.get' END AS frames FROM t WHERE et <> 'click'")
def q_app_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that are the application's, the first one where none is."""
    f = logs.stack_frames(traces(spark, sf_dir), JAVA, ["id"]).filter("cause_depth = 0")
    named = f.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", F.concat_ws(".", "class_name", "method").alias("q")))), lambda x: x["q"]).alias("f"))
    return named.select("id", F.array_join(resolve.app_frames(F.col("f"), [*resolve.PLATFORM, "org.fw"]), ",").alias("frames"))


DIFF = "'diff --git a/old' || k % 5 || '.py b/new.py' || chr(10) || '--- a/old' || k % 5 || '.py' || chr(10) || CASE WHEN k % 3 = 0 THEN '+++ /dev/null' WHEN k % 3 = 1 THEN '+++ b/new.py' ELSE '+++ b/test_' || k || '.py' END || chr(10) || '@@ -1 +1 @@' || chr(10) || '-a' || chr(10) || '+b'"


@query(f"""WITH e AS (SELECT event_id AS id, {K} AS k FROM events), f AS (SELECT id, 'old' || k % 5 || '.py' AS path, 0 AS first FROM e UNION ALL SELECT id, 'new.py', 0 FROM e UNION ALL SELECT id, 'test_' || k || '.py', 2 FROM e WHERE k % 3 = 2)
SELECT id, path, first, (SELECT k % 3 <> 2 FROM e WHERE e.id = f.id) AS allowed FROM f""")
def q_diff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of patches, and whether a patch leaves tests and unnamed files alone."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    files = evidence.diff_files(e.select(F.col("event_id").alias("id"), F.expr(DIFF).alias("diff")), "id", "diff")
    listed = files.groupBy("id").agg(F.collect_list("path").alias("files"))
    allowed = F.array(F.lit("new.py"), *[F.lit(f"old{i}.py") for i in range(5)])
    return files.join(listed.select("id", evidence.patch_allowed(F.col("files"), allowed).alias("allowed")), "id")


NAMED = "f AS (SELECT p_partkey AS fid, 'run' || p_partkey % 50 AS name, 'Job' || p_partkey % 400 AS class_name FROM part)"


@query(f"""WITH {NAMED}, n AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'x.Job' || p_partkey % 400 || '.run' || p_partkey % 50 WHEN 1 THEN 'run' || p_partkey % 60 WHEN 2 THEN 'Nothing.run' || p_partkey % 50 ELSE 'walk' || p_partkey % 9 END AS name FROM part),
s AS (SELECT name, regexp_extract(name, '[^.]+$') AS short, lower(regexp_extract(name, '(\\w+)\\.\\w+$', 1)) AS cls FROM n), h AS (SELECT s.name, f.fid, CASE WHEN cls <> '' AND lower(class_name) = cls THEN 0 WHEN cls <> '' AND (contains(lower(class_name), cls) OR contains(cls, lower(class_name))) THEN 1 ELSE 2 END AS p FROM s JOIN f ON f.name = s.short),
b AS (SELECT name, min(p) AS p, arg_min(fid, (p, fid)) AS fid, count(DISTINCT fid) AS n FROM h GROUP BY name)
SELECT n.name, fid, CASE WHEN fid IS NULL THEN 'not_found' WHEN p = 0 THEN 'class_method' WHEN b.n = 1 THEN 'unique' WHEN p = 1 THEN 'class_hint' ELSE 'ambiguous' END AS how FROM n LEFT JOIN b USING (name)""")
def q_validated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    functions = p.select(F.col("p_partkey").alias("fid"), F.expr("'run' || p_partkey % 50").alias("name"), F.expr("'Job' || p_partkey % 400").alias("class_name"))
    names = p.select(F.expr("CASE p_partkey % 4 WHEN 0 THEN 'x.Job' || p_partkey % 400 || '.run' || p_partkey % 50 WHEN 1 THEN 'run' || p_partkey % 60 WHEN 2 THEN 'Nothing.run' || p_partkey % 50 ELSE 'walk' || p_partkey % 9 END").alias("name"))
    return graph.validated(names, functions)


OWNED = "f AS (SELECT p_partkey AS fid, CASE WHEN p_partkey % 10 = 0 THEN 'withPart' WHEN p_partkey % 10 = 1 THEN 'build' ELSE 'step' || p_partkey % 10 END AS name, 'C' || p_partkey // 10 AS class_name, p_partkey // 20 AS path, p_partkey % 10 AS m FROM part)"


@query(f"""WITH {OWNED} SELECT a.fid AS src, b.fid AS dst, TRUE AS synthetic, 'inner' AS reason FROM f a JOIN f b ON a.path = b.path AND a.fid <> b.fid AND b.name IN ('step' || (a.fid % 7 + 2), 'build') WHERE a.m IN (0, 1) AND NOT (b.fid - a.fid = 3)""")
def q_inner_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("m", F.col("p_partkey") % 10)
    name = F.when(F.col("m") == 0, "withPart").when(F.col("m") == 1, "build").otherwise(F.expr("'step' || m"))
    source = F.expr("concat('return this.step', p_partkey % 7 + 2, '(x).build().Other(y)')")
    functions = p.select(F.col("p_partkey").alias("fid"), name.alias("name"), F.expr("p_partkey div 20").alias("path"), source.alias("source"))
    known = functions.select(F.col("fid").alias("src"), (F.col("fid") + 3).alias("dst"))
    return graph.inner_calls(functions, known)


@query(f"""WITH {OWNED}, inj AS (SELECT DISTINCT class_name, 'part' || (fid // 10) % 3 AS field, 'C' || (fid // 10 + 1) AS injected FROM f) SELECT DISTINCT a.fid AS src, b.fid AS dst, TRUE AS synthetic, 'inject' AS reason FROM f a JOIN inj ON inj.class_name = a.class_name AND inj.field = 'part' || a.fid % 3 JOIN f b ON b.class_name = injected AND b.name = 'step' || (a.fid % 8 + 2) WHERE a.fid <> b.fid""")
def q_injected_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumns({"m": F.col("p_partkey") % 10, "c": F.expr("p_partkey div 10")})
    name = F.when(F.col("m") == 0, "withPart").when(F.col("m") == 1, "build").otherwise(F.expr("'step' || m"))
    functions = p.select(F.col("p_partkey").alias("fid"), name.alias("name"), F.expr("'C' || c").alias("class_name"))
    nodes = p.select(F.col("p_partkey").alias("fid"), F.lit("call").alias("type"), F.expr("'part' || p_partkey % 3 || '.step' || (p_partkey % 8 + 2)").alias("call_target"))
    injects = p.select(F.expr("'C' || c").alias("class_name"), F.expr("'part' || c % 3").alias("field_name"), F.expr("'C' || (c + 1)").alias("injected")).distinct()
    return graph.injected_calls(nodes, functions, injects)
