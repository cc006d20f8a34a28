import json

import pytest
from pyspark.sql import functions as F

from logloom.operators import evidence, fallbacks, gates, graph, resolve


def test_gates(spark):
    rows = spark.createDataFrame([(True, "requests"), (False, "-x"), (None, None)], "v boolean, p string")
    got = rows.select(gates.can_act(F.col("v")), gates.tools(F.col("v")), gates.safe(F.col("p"), gates.PACKAGE)).collect()
    assert [tuple(r) for r in got] == [(True, ["issue", "pr"], True), (False, ["issue"], False), (False, ["issue"], False)]
    assert spark.range(1).select(gates.required(F.lit("pr"))).first()[0] == "verified"
    with pytest.raises(Exception, match="unknown target"):
        spark.range(1).select(gates.required(F.lit("force"))).collect()
    schema = {"properties": {"n": {"type": "integer", "minimum": 1}, "s": {"type": "string"}}, "required": ["n"]}
    assert gates.problems({"n": True, "x": 1}, schema) == ["n: not integer", "x: unexpected"]
    assert gates.problems({}, schema) == ["n: missing"] and gates.problems({"n": 0}, schema) == ["n: out of range"] and not gates.problems({"n": 2, "s": ""}, schema)
    m = spark.createDataFrame([("pending", "a", "a", 1, 0), ("pending", "a", "b", 1, 0), (None, "a", "a", 1, 0)], "approval string, sandbox_id string, approval_sandbox_id string, red_exit int, green_exit int")
    assert [r.approvable for r in gates.approvable(m).collect()] == [True, False, False]


def test_fallbacks(spark):
    e = spark.createDataFrame([(i, f"f{i % 7}") for i in range(20)], "i int, node string")
    assert [r.i for r in fallbacks.assignments(e, "i", "node").orderBy("i").collect()] == [0, 1, 2, 3, 4]
    r = spark.createDataFrame([(1, 0.2), (2, 0.9), (3, 0.1), (4, 0.3)], "i int, c double")
    assert [x.i for x in fallbacks.evidence_summary(r, "i", "c").collect()] == [2]
    assert sorted(x.i for x in fallbacks.evidence_summary(r.filter("i <> 2"), "i", "c").collect()) == [1, 3, 4]
    assert fallbacks.early_exit(r, "c").first()[0] is False and fallbacks.early_exit(r.filter("i = 2").withColumn("c", F.lit(0.95)), "c").first()[0] is True
    got = spark.createDataFrame([(["a"],), ([],), (None,)], "l array<string>").select(fallbacks.lenses(F.col("l"))).collect()
    assert [x[0] for x in got] == [["a"], [fallbacks.LENS], [fallbacks.LENS]]
    assert [x.i for x in fallbacks.top_hits(r, "c", "i").collect()] == [2, 4]


def test_accessors_and_builders(spark):
    f = spark.createDataFrame([(1, "getName", "p", "user.name"), (2, "show", "p", "print user.name"), (3, "withName", "q", "this.put(x)"), (4, "put", "q", ""), (5, "put", "r", "")], "fid bigint, name string, path string, source string")
    none = spark.createDataFrame([], "src bigint, dst bigint")
    assert [(r.src, r.dst) for r in graph.property_calls(f, none).collect()] == [(2, 1)]
    assert graph.property_calls(f, spark.createDataFrame([(2, 1)], "src bigint, dst bigint")).count() == 0
    assert [(r.src, r.dst) for r in graph.inner_calls(f, none).collect()] == [(3, 4)]


def test_names_are_validated(spark):
    f = spark.createDataFrame([(1, "run", "Job"), (2, "run", "Task"), (3, "stop", "Job")], "fid bigint, name string, class_name string")
    names = spark.createDataFrame([("Task.run",), ("stop",), ("run",), ("gone",), ("MyTask.run",)], "name string")
    got = {r.name: (r.fid, r.how) for r in graph.validated(names, f).collect()}
    assert got == {"Task.run": (2, "class_method"), "stop": (3, "unique"), "run": (1, "ambiguous"), "gone": (None, "not_found"), "MyTask.run": (2, "class_hint")}
    nodes = spark.createDataFrame([(9, "stop"), (9, "job.run"), (9, "x.run")], "fid bigint, call_target string")
    assert {r.call_target: r.call_target_id for r in graph.call_targets(nodes, f).collect()} == {"stop": 3, "job.run": 1, "x.run": None}


def test_loggers_and_classes(spark):
    line = spark.createDataFrame([("[t] a.B : hi",), ("INFO x.Y: hi",), ("none",)], "l string")
    assert [r[0] for r in line.select(resolve.logger_class(F.col("l"), [r"(?P<level>[A-Z]+)\s+(?P<logger>[\w.]+): (?P<message>.*)"])).collect()] == ["a.B", "x.Y", None]
    e = spark.createDataFrame([(1, "saveAll: wrote rows", "S"), (2, "wrote rows", "S"), (3, "", "S"), (4, "zzz", "S")], "entry_idx int, static_text string, class_name string")
    c = spark.createDataFrame([("S", 10, "save", ["wrote rows"]), ("S", 11, "saveAll", ["wrote rows"]), ("S", 12, "load", [])], "class_name string, fid bigint, name string, templates array<string>")
    assert {r.entry_idx: (r.fid, r.rule) for r in resolve.by_class(e, c).collect()} == {1: (11, 0), 2: (10, 4)}


def test_related_failures(spark):
    kind = "array<struct<outcome:string,node_id:string,traceback:string>>"
    rows = spark.createDataFrame([([("failed", "t/test_a.py::x", "in core/mod.py")], ["core/mod.py"]), ([("passed", "core/mod.py", None)], ["core/mod.py"]), ([("error", "a", None)], ["", "zz"])], f"cases {kind}, needles array<string>")
    assert [r[0] for r in rows.select(evidence.related(F.col("cases"), F.col("needles"))).collect()] == [True, False, False]


def test_paths_behind_the_last_segment_of_a_name(spark):
    from logloom.operators import lookups

    rows = [("/a/shop/b/shop/c.py",), ("/a/shopping/c.py",), ("shop/x.py",), ("C:\\w\\shop\\y.py",), ("/a/shop",)]
    got = spark.createDataFrame(rows, "p string").select(lookups.relative(F.col("p"), "shop").alias("r")).collect()
    assert [r.r for r in got] == ["c.py", "/a/shopping/c.py", "x.py", "y.py", ""]


def test_blocks_and_tracebacks(spark):
    text = "=== ERRORS ===\nlost\n___ ERROR collecting tests/x.py ___\nE one\n\n___ t::a ___\n\n=== FAILURES ===\n___ K::a ___\nfirst\n___ a ___\nsecond\n=== FAILURES ===\n___ b ___\nnot here\n=== short test summary info ===\nFAILED t.py::a - x\nERROR tests/x.py\nPASSED t.py::b\n=== 1 failed ==="
    raw = spark.createDataFrame([(1, text), (2, ""), (3, None)], "k int, s string")
    lines = evidence.report_lines(raw, "k", "s")
    assert {(r.k, r.title, r.text) for r in evidence.blocks(lines, "k", "ERRORS").collect()} == {(1, "ERROR collecting tests/x.py", "E one"), (1, "t::a", "")}
    assert {(r.node_id, r.outcome, r.traceback) for r in evidence.cases(lines, "k").collect()} == {("t.py::a", "failed", "first"), ("tests/x.py", "error", "E one"), ("t.py::b", "passed", None)}


def test_classes_by_name_source_and_template(spark):
    e = spark.createDataFrame([(1, "loads of save", "S"), (2, "- opening file: x", "S"), (3, "see wrote rows now", "S")], "entry_idx int, static_text string, class_name string")
    c = spark.createDataFrame([("S", 10, "save", "log('opening file')", ["nope"]), ("S", 11, "other", "", ["wrote rows"]), ("T", 1, "save", "", None)], "class_name string, fid bigint, name string, source string, templates array<string>")
    assert {r.entry_idx: (r.fid, r.rule) for r in resolve.by_class(e, c).collect()} == {1: (10, 2), 2: (10, 3), 3: (11, 4)}


def test_contracts_tell_the_schemas(spark):
    from pyspark.sql import types as T

    from logloom.sources import tables

    found = {k: T.StructType.fromJson(json.loads(v)) for k, v in tables.contracts().items()}
    assert found.keys() == tables.SCHEMAS.keys()
    assert all(spark.createDataFrame([], tables.SCHEMAS[k]).schema == v for k, v in found.items())


def test_selected_clusters_and_flow(spark):
    from logloom.operators import cluster

    rows = [(1, None, None, False), (2, "a", 7, True), (3, None, None, True), (4, "b", 8, True), (9, "c", 7, False)]
    e = spark.createDataFrame(rows, "i bigint, function string, fid bigint, is_error boolean")
    chosen = lambda s: sorted(r.i for r in cluster.selected(e, s, "fid").collect())
    assert chosen(" ALL ") == [2, 3, 4] and chosen("c_7, c_-1") == [2, 3] and chosen("none") == []
    flow = cluster.error_flow(e.withColumn("is_error", F.col("i") == 4), "i", "function").orderBy("i").collect()
    assert [(r.error_idx, r.i, r.function, r.marked) for r in flow] == [(4, 1, "?", False), (4, 2, "a", False), (4, 3, "?", False), (4, 4, "b", True)]
