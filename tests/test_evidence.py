import json

import pytest
from pyspark.sql import functions as F

from logloom.functions import text as fn
from logloom.operators import cluster, evidence, store
from logloom.sources import events, sinks, tables
from logloom.streaming import fold

RED = """============= test session starts =============
collected 0 items / 2 errors
==================================== ERRORS ====================================
________________ ERROR collecting tests/test_a.py ________________
ImportError: no module
=========================== short test summary info ============================
ERROR tests/test_a.py
ERROR tests/test_b.py - ImportError: x
!!!!!!!!!!!!!!!!!!! Interrupted: 2 errors during collection !!!!!!!!!!!!!!!!!!!!
============================== 2 errors in 0.36s ==============================="""
GREEN = """=========================== short test summary info ============================
PASSED tests/test_a.py::test_one
SKIPPED [1] tests/test_a.py:12: needs network
XPASS tests/test_a.py::test_two
0.24s call     tests/test_a.py::test_one
\u001b[32m======================== 3 passed, 1 skipped in 0.50s =========================\u001b[0m"""


def report(spark, text, code):
    return evidence.reports(spark.createDataFrame([(1, text, code)], "id int, text string, code int"), "id", "text", "code").first()


def test_red_and_green_reports(spark):
    r = report(spark, RED, 2)
    assert (r.passed, r.failed, r.errors, r.is_broken, r.is_green, r.is_execution_failure, r.wall_s) == (0, 0, 2, True, False, True, 0.36)
    r = report(spark, GREEN, 0)
    assert (r.passed, r.failed, r.errors, r.skipped, r.is_green, r.is_broken) == (3, 0, 0, 1, True, False)


@pytest.mark.parametrize(("text", "code", "errors", "nothing"), [("", 124, 1, False), ("", 0, 0, True), ("= 1 skipped in 0.1s =", 0, 0, True), ("killed", 137, 1, False)])
def test_reports_without_cases(spark, text, code, errors, nothing):
    r = report(spark, text, code)
    assert (r.errors, r.ran_nothing, r.is_green) == (errors, nothing, False)


def test_cases_of_a_summary(spark):
    lines = evidence.report_lines(spark.createDataFrame([(1, GREEN)], "id int, text string"), "id", "text")
    assert sorted((r.node_id, r.outcome) for r in evidence.summary_cases(lines, "id").collect()) == [("tests/test_a.py", "skipped"), ("tests/test_a.py::test_one", "passed"), ("tests/test_a.py::test_two", "passed")]
    assert [(r.node_id, r.duration_s) for r in evidence.durations(lines, "id").collect()] == [("tests/test_a.py::test_one", 0.24)]


@pytest.mark.parametrize(("bodies", "healthy", "ratio"), [(["x"] * 6, True, 0.0), (["x"] * 4, False, 0.0), (["x"] * 4 + [""], True, 0.2), (["x"] * 3 + [" ", None], False, 0.4), (["0"] * 5, True, 0.0)])
def test_health(spark, bodies, healthy, ratio):
    r = evidence.health(spark.createDataFrame([("t", b) for b in bodies], "tag string, body string"), ["tag", "body"]).first()
    assert (r.healthy, r.worst_ratio) == (healthy, ratio) and (r.symptom == "") == healthy


LADDER = [
    ((False, 1, True, False, False, True, True), "unlocatable"), ((True, 0, True, False, False, True, True), "uncovered"), ((True, 1, False, False, False, True, True), "uncovered"), ((True, 1, True, True, False, True, True), "inconclusive"),
    ((True, 1, True, False, True, True, True), "inconclusive"), ((True, 1, True, False, False, True, True), "confirmed"), ((True, 1, True, False, False, True, False), "inconclusive"), ((True, 1, True, False, False, False, False), "unreproduced"),
]


def test_every_rung_of_the_ladder(spark):
    names = "locatable boolean, tests int, report boolean, failure boolean, nothing boolean, broken boolean, related boolean"
    rows = spark.createDataFrame([k for k, _ in LADDER], names)
    got = rows.select(evidence.verdict(*[F.col(c.split()[0]) for c in names.split(", ")]).alias("status"))
    assert [r.status for r in got.collect()] == [v for _, v in LADDER]
    assert {r.status: r.n for r in evidence.tally(got).collect()} == {"confirmed": 1, "unreproduced": 1, "uncovered": 2, "unlocatable": 1, "inconclusive": 3}


def test_findings_are_located_by_the_tightest_span(spark):
    f = spark.createDataFrame([(1, "a.py", 1, 500), (2, "a.py", 60, 70), (3, "a.py", 60, 70), (4, "b.py", 1, 9)], "fid int, path string, start_line int, end_line int")
    found = spark.createDataFrame([(1, "a.py", 65), (2, "a.py", 400), (3, "b.py", 99), (4, "c.py", 1)], "id int, file_path string, line int")
    assert sorted((r.id, r.fid) for r in evidence.located(found, f).collect()) == [(1, 2), (1, 3), (2, 1), (3, 4)]


def test_diffs_and_patches(spark):
    diff = "diff --git a/old.py b/new.py\n--- a/old.py\n+++ b/new.py\n@@ -1 +1 @@\n--- /dev/null\n+++ b/tests/test_x.py"
    got = evidence.diff_files(spark.createDataFrame([(1, diff)], "id int, diff string"), "id", "diff")
    assert sorted(r.path for r in got.collect()) == ["new.py", "old.py", "tests/test_x.py"]
    cases = spark.createDataFrame([(["a.py"], ["a.py"]), (["a.py", "t/test_x.py"], ["a.py", "t/test_x.py"]), ([], ["a.py"]), (["b.py"], ["a.py"]), (["a.py", "a.py"], ["a.py"])], "files array<string>, allowed array<string>")
    assert [r[0] for r in cases.select(evidence.patch_allowed(F.col("files"), F.col("allowed"))).collect()] == [True, False, False, False, True]
    assert [r[0] for r in cases.select(evidence.carries(F.col("files"), F.col("allowed"))).collect()] == [True, True, False, False, True]


def test_requirements(spark):
    text = "# note\nrequests==2.0  # pin\n-r base.txt\nMy_Pkg[extra]>=1 \\\n  ,<2 --hash=sha256:ab\n\nflask ; python_version > '3'\n"
    got = [(r.name, r.spec) for r in evidence.requirements(spark.createDataFrame([("f", text)], "f string, t string"), "f", "t").orderBy("n").collect()]
    assert got == [("requests", "==2.0"), ("my-pkg", ">=1    ,<2"), ("flask", "")]


def test_stores(spark):
    old = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b")], "repo string, pr int, v string")
    new = spark.createDataFrame([("r", 2, "c"), ("s", 9, "d")], "repo string, pr int, v string")
    assert sorted(r.v for r in store.replaced(old, new, ["repo", "pr"]).collect()) == ["a", "c", "d"]
    nulls = spark.createDataFrame([(None, 1, "x")], "repo string, pr int, v string")
    assert sorted(r.v for r in store.upserted(old.union(nulls), spark.createDataFrame([(None, 1, "y")], old.schema), ["repo", "pr"]).collect()) == ["a", "b", "y"]
    changes = spark.createDataFrame([("k", 1, "one"), ("k", 3, "three"), ("k", 2, "two")], "id string, seq int, state string")
    assert [(r.state, r.first_seen) for r in store.latest(changes, ["id"], ["seq"]).collect()] == [("three", 1)]
    assert [r.seq for r in store.newest(changes, "seq", "state", 2).collect()] == [3, 2]
    clock = spark.createDataFrame([("s", 1, 5), ("s", 2, 3), ("s", 3, 9)], "session string, seq int, t int")
    assert [r.t_ms for r in store.monotone(clock, "session", "seq", "t").orderBy("seq").collect()] == [5, 5, 9]


def test_clusters_and_windows(spark):
    rows = [(0, "t", None, False), (1, "t", "x", False), (2, "t", "boot", False), (3, "t", "x", True), (4, "u", None, True)]
    e = spark.createDataFrame(rows, "i bigint, thread string, f string, is_error boolean")
    got = cluster.cluster_summary(cluster.thread_clusters(e, spark.createDataFrame([("boot",)], "f string"), "thread", "i", "f"), "thread", "i", "f")
    assert sorted((r.thread, r.cluster_no, r.anchor, r["first"], r["last"]) for r in got.collect()) == [("t", 1, "x", 0, 3)]
    assert sorted(r.i for r in cluster.windows(e, e.filter("i = 3"), "i", 1, 5).collect()) == [2, 3, 4]
    assert cluster.error_threads(e, "thread", "is_error").count() == 5


def test_secrets_are_masked(spark):
    rows = spark.createDataFrame([("key sk-abc_1 x",), ("task-sk-123",), ("ghp_A12,dtn_999",), ("risk-free sk-1 dtn_ab",)], "t string")
    assert [r[0] for r in rows.select(fn.redacted(F.col("t"))).collect()] == ["key [REDACTED] x", "task-[REDACTED]", "[REDACTED],[REDACTED]", "risk-free sk-1 dtn_ab"]


def test_values_of_sensitive_keys_are_masked(spark):
    said = '{"a": {"Token": "x\\"y", "n": 1}, "api_key": 12, "bearer": null, "note": "sk-abcd", "tokens": "z"}'
    got = spark.createDataFrame([(said,)], "t string").select(fn.redacted_json(F.col("t"))).first()[0]
    assert got == '{"a": {"Token": "[REDACTED]", "n": 1}, "api_key": "[REDACTED]", "bearer": "[REDACTED]", "note": "[REDACTED]", "tokens": "z"}'


def test_frames_and_json(spark):
    text = ": hi\r\nid: 1\r\ndata: a\r\ndata:  b\r\n\r\nevent: ping\n\n\nid: 2\n\n: only a comment\n\n"
    got = [(r.seq, r.event, r.id, r.data) for r in events.messages(spark.createDataFrame([("s", text)], "k string, t string"), "k", "t").orderBy("seq").collect()]
    assert [g[1:] for g in got] == [("message", "1", "a\n b"), ("ping", None, None), ("message", "2", None)]
    replies = spark.createDataFrame([("```json\n{\"a\": 1}\n```",), ("Sure: [1, 2] ok",), ("none",), ('{"b": 2}',)], "t string")
    assert [r[0] for r in replies.select(events.salvaged(F.col("t"))).collect()] == ['{"a": 1}', "[1, 2]", None, '{"b": 2}']
    page = json.dumps([{"id": 1, "user": {"login": "Bot"}, "path": "a.py", "line": None, "original_line": 7, "body": "fix", "html_url": "u"}, {"id": 2, "user": {"login": "human"}, "body": "x"}])
    assert [(r.id, r.line) for r in events.review_comments(spark.createDataFrame([(page,)], "p string"), "p", ["bot"]).collect()] == [(1, 7)]


EVENTS = [("green", None), ("started", None), ("line", "1"), ("line", "1"), ("red", None), ("line", "2"), ("green", None), ("red", None), ("done", None)]


def _in_order(events):
    """The state by one pass over events in order."""
    phase, red, green, lines = None, False, False, set()
    for event, key in events:
        if event == "red":
            phase, red, green = "reproduced", True, False
        elif event == "green" and red:
            phase, green = "verified", True
        elif event in ("started", "done"):
            phase = event
        elif event == "line" and key is not None:
            lines.add(key)
    return len(events), len(lines), phase, red, green


def test_fold_of_every_prefix(spark):
    for n in range(1, len(EVENTS) + 1):
        state = _in_order(EVENTS[:n])
        rows = [("s", i, e, k) for i, (e, k) in enumerate(EVENTS[:n])]
        got = fold.folded(spark.createDataFrame(rows, "session_id string, seq bigint, event string, id string")).first()
        assert tuple(got)[1:] == state, n
        for order in (rows, rows[::-1], rows[1::2] + rows[::2]):
            marks = fold.NO_MARKS
            for _, seq, event, _ in order:
                marks = fold.marked(marks, event, seq)
            assert fold.told((n, state[1], *marks[2:])) == state, n


def test_states_of_late_rows(spark, tmp_path):
    rows = [("s", i, e, k) for i, (e, k) in enumerate(EVENTS)]
    for part in (rows[1::2], rows[::2]):
        spark.createDataFrame(part[::-1], "session_id string, seq bigint, event string, id string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("session_id string, seq bigint, event string, id string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        job = fold.fold_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out"))).start()
        job.awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    last = spark.read.parquet(str(tmp_path / "out")).orderBy("events").collect()
    assert len(last) == 2 and tuple(last[-1])[1:] == _in_order(EVENTS)


def test_chunks_in_any_order(spark, tmp_path):
    text = "".join(f"id: {i}\r\ndata: x{i}\r\n\r\n" for i in range(20)) + "data: tail\n"
    cuts = [(n, text[i : i + 11]) for n, i in enumerate(range(0, len(text), 11))]
    cuts.append((len(cuts), None))
    for part in (cuts[2::3], cuts[:1] + cuts[1::3], cuts[::3]):
        spark.createDataFrame([("s", n, c) for n, c in part[::-1]], "session_id string, n bigint, chunk string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("session_id string, n bigint, chunk string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    job = fold.frame_stream(stream).writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
    job.awaitTermination()
    got = [(r.id, r.data) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()]
    assert got == [(str(i), f"x{i}") for i in range(20)] + [(None, "tail")]


def test_streams_cut_anywhere(spark, tmp_path):
    text = "id: 1\r\ndata: a\r\n\r\ndata: b\n\nevent: ping\n\n: c\n\ndata: end\n\n"
    cuts = [text[i : i + 7] for i in range(0, len(text), 7)]
    for i, c in enumerate(cuts):
        spark.createDataFrame([("s", i, c)], "session_id string, n bigint, chunk string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id string, n bigint, chunk string").option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    job = fold.frame_stream(stream).writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
    job.awaitTermination()
    got = [(r.event, r.id, r.data) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()]
    assert got == [("message", "1", "a"), ("message", None, "b"), ("ping", None, None), ("message", None, "end")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, 5, "my sk-secret1"), ("s", 2, 3, "ok")], "session string, seq int, t int, body string")
    sinks.record(rows, str(tmp_path / "rec"), "session", "seq", "t")
    assert [(r.t_ms, r.body) for r in spark.read.json(str(tmp_path / "rec")).orderBy("seq").collect()] == [(5, "my [REDACTED]"), (5, "ok")]
    nodes = spark.createDataFrame([(1, 'a"b', 2, False), (2, "c", 4, True)], "id int, label string, tier int, is_error boolean")
    lines = [r.line for r in sinks.dot_lines(nodes, spark.createDataFrame([(1, 2)], "src int, dst int")).orderBy("part", "line").collect()]
    assert lines == ['  "1" [label="a\'b", fillcolor=lightblue];', '  "2" [label="c", fillcolor=red];', '  "1" -> "2";']
    assert tables.read(spark, str(tmp_path), "calls").count() == 0
    tables.write(spark.createDataFrame([(1, 2, False, "")], tables.SCHEMAS["calls"]), str(tmp_path), "calls")
    assert tables.read(spark, str(tmp_path), "calls").count() == 1
