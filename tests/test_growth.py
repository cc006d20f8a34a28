"""Operators whose work must grow with their input: results by hand, and what stands below a join in the plan."""

import random
import re

import pytest
from pyspark.sql import functions as F

from logloom.operators import flows, graph, hunks, manifests, resolve, templates, traversal
from logloom.plans import log_queries
from logloom.plans.catalog import queries


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_missing_members_aren_t_held_again(spark):
    rnd = random.Random(4)
    classes = [(rnd.choice("ABCD"), rnd.choice("xyz")) for _ in range(12)] + [("E", None), (None, "x")]
    functions = [(rnd.randrange(30), rnd.choice("xyzw")) for _ in range(50)] + [(31, None)]
    have = [(rnd.choice("ABCDF"), rnd.randrange(30)) for _ in range(40)]
    df = graph.missing_members(spark.createDataFrame(classes, "class_name string, path string"), spark.createDataFrame(functions, "fid bigint, path string"), spark.createDataFrame(have, "class_name string, fid bigint"))
    got = sorted(((r.class_name, r.fid) for r in df.collect()), key=repr)
    assert got == sorted({(c, f) for c, p in classes for f, q in functions if p is not None and p == q} - set(have), key=repr)
    plan = _plan(df)
    assert "Aggregate" not in plan[: plan.index("Join Inner")]


def _edges(functions, calls, words, most):
    out = set()
    for dst, name, _ in functions:
        found = sorted({src for src, _, source in functions if src != dst and words(name) in source.split() and (src, name) not in calls})
        out |= {(src, dst) for src in found[:most]}
    return out


@pytest.mark.parametrize("seed", range(2))
def test_edges_to_common_names_are_no_product(spark, seed):
    rnd = random.Random(seed)
    names = ["getAlpha", "getBeta", "setAlpha", "gammaRay"]
    functions = [(i, rnd.choice(names), " ".join(rnd.sample(["alpha", "beta", "other", ".gammaRay("], rnd.randrange(4)))) for i in range(60)]
    calls = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)]
    f = spark.createDataFrame(functions, "fid bigint, name string, source string")
    c = spark.createDataFrame(calls, "src bigint, dst bigint")
    of = {i: n for i, n, _ in functions}
    accessors = [x for x in functions if x[1] != "gammaRay"]
    found = graph.property_calls(f, c, most=3)
    want = {(s, d) for s, d in _edges(functions, {(s, of[d]) for s, d in calls}, lambda n: n[3].lower() + n[4:], 3) if d in {x[0] for x in accessors}}
    assert {(r.src, r.dst) for r in found.collect()} == want and found.count() == len(want)
    called = graph.token_calls(f, c, most=3)
    open_ = {i for i, n, _ in functions if n == "gammaRay"} - {d for _, d in calls}
    want = {(s, d) for s, d in _edges(functions, set(), lambda n: f".{n}(", 3) if d in open_}
    assert {(r.src, r.dst) for r in called.collect()} == want and called.count() == len(want)
    # only the first sources of a name meet its functions
    for df in (found, called):
        plan = _plan(df)
        assert "Window" in plan[plan.index("Join Inner") :]


def test_ends_by_indentation_split_a_source_once(spark):
    texts = ["def f():\n  a\n\n  b\nc", "def f():\na", "def f():", "", "def f():\n\n \n    x\n  y", "def f():\n\ta\n\t \n\tb"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", flows.function_end(F.col("t"), "python").alias("n"))
    assert [r.n for r in df.orderBy("i").collect()] == [4, 1, 1, 1, 4, 4]
    assert _plan(df).count("split(") == 1


def test_log_calls_are_put_together_once(spark):
    f = spark.createDataFrame([(1, 'log.info(\n"a {} b"\n, x)\nprint("c")\nx = 1'), (2, None), (3, "log.warn(n)")], "fid bigint, source string")
    df = templates.extracted(f)
    assert sorted((r.fid, r.line, r.level, r.text, r.frags) for r in df.collect()) == [(1, 1, "info", "a  b", ["a ", " b"]), (1, 4, "print", "c", ["c"])]
    plan = _plan(df)
    assert plan.count("aggregate(") == 1 and plan.count("split(source") == 1


def test_statements_are_split_into_fragments_once(spark):
    f = spark.createDataFrame([(1, 'if (a) {\nlog.warn("late %s of " + n + " days")\nlog.info(x)\n}\nreturn a'), (2, None)], "fid bigint, source string")
    df = flows.nodes(f)
    got = sorted((r.fid, r.node_id, r.type, r.log_level, r.log_text, r.frags) for r in df.collect())
    assert got == [(1, 0, "branch", None, None, None), (1, 1, "log", "warn", 'late  of " + n + " days', ["late ", ' of " + n + " days']), (1, 2, "log", "info", "", []), (1, 3, "return", None, None, None)]
    assert _plan(df).count("%[-+0-9*.]*[sdflxvqweEgGoO]") == 1


def test_messages_aren_t_multiplied_by_the_lengths_of_keys(spark):
    known = [(1, ["call a", "x"]), (2, ["call a", "x"]), (3, ["call ab", "y"]), (4, ["call", "of it"]), (2, ["call a", "z"]), (None, ["call a", "z"]), (5, [None]), (6, None)]
    t = spark.createDataFrame(known, "fid bigint, frags array<string>").withColumns({"fname": F.lit("f"), "line": F.lit(1)})
    said = ["call a x", "call a x z", "call ab y", "call ab x", "call of it", "call", "", None, "call a z"]
    m = spark.createDataFrame(list(enumerate(said)), "entry_idx int, static_text string")
    prefix = templates.longest_prefix(m, templates.admitted(t))
    got = {(r._text, r.fid, r.key) for r in prefix.collect()}
    assert got == {(s, f, k) for s, k in [("call a x", "call a"), ("call a x z", "call a"), ("call ab y", "call ab"), ("call ab x", "call ab"), ("call of it", "call"), ("call", "call"), ("call a z", "call a")] for f, x in known if x and x[0] == k}
    assert "explode(filter(_lengths" in _plan(prefix) and not [line for line in _plan(prefix).split("\n") if "Generate explode(filter(_lengths" in line and "_text" in line]
    out = {r.static_text: (r.status, r.fid, [c.fid for c in r.candidates or []]) for r in resolve.first_pass(m, t).collect()}
    assert out["call a x"] == ("ambiguous", None, [1, 2]) and out["call a x z"] == ("ambiguous", None, [None, 1, 2]) and out["call ab y"] == ("hit", 3, [3]) and out["call ab x"] == ("miss", None, []) and out["call"][0] == "skip" and out[None][0] == "skip"
    plan = _plan(resolve.first_pass(m, t).groupBy("status").count())
    assert "collect_set(named_struct" not in plan and "collect_list" not in plan


def test_templates_that_many_functions_share_meet_a_message_once(spark):
    known = [(i, ["call a", "x"]) for i in range(50)] + [(3, ["call a", "z"]), (60, ["call a", "z"]), (61, ["call ab", "y"]), (61, ["call ab", "y"]), (None, ["call a", "x"]), (62, [None]), (63, None)]
    t = spark.createDataFrame(known, "fid bigint, frags array<string>").withColumn("fname", F.lit("f"))
    m = spark.createDataFrame([("call a x",), ("call a x",), ("call a xz",), ("call a z",), ("call ab y",), ("call ab",), (None,)], "static_text string")
    df = templates.counted(m, t)
    assert sorted(map(tuple, df.collect())) == [("call a x", 50, 0), ("call a xz", 51, 0), ("call a z", 2, 3), ("call ab y", 1, 61)]
    query = queries()["q_template_match"](spark, "/root/testdata/sf0.001")
    assert "count(distinct fid" not in _plan(query) and re.search(r"Aggregate \[frags", _plan(query))


def test_what_items_tell_is_not_read_from_all_events_again(spark):
    lines, *rest = log_queries.event_log(spark, "/root/testdata/sf0.001")
    assert "Join" not in _plan(lines) and len(rest) == 3 and all("get_json_object" not in _plan(t) for t in rest)
    assert lines.select("file", "line_no").distinct().count() == lines.count() > 0


def test_lines_of_a_file_are_trimmed_once(spark, monkeypatch):
    held = []
    monkeypatch.setattr(hunks, "written", lambda df: held.append(df.columns) or graph.written(df))
    patches = spark.createDataFrame([(1, "+++ b/f\n@@ x\n a \t\n-b\x0b\f\r\n+c")], "id bigint, diff string")
    got = hunks.anchored(patches, spark.createDataFrame([("f", "z\n a\na\nb \r\n")], "path string, text string"))
    assert [(r.diff.split("\n")[1], r.moved) for r in got.collect()] == [("@@ -3,2 +3,2 @@", 1)] and ["path", "_lines"] in held
    assert "rtrim" not in _plan(got).lower() and "\\s+$" not in _plan(got)


def _walked(root, edges, most):
    at = {root: ()}

    def walk(node):
        if most is not None and len(at[node]) > most:
            return
        for place, other in sorted((p, o) for n, o, p in edges if n == node):
            if other not in at:
                at[other] = (*at[node], place)
                walk(other)

    walk(root)
    return {(root, n, p) for n, p in at.items()}


@pytest.mark.parametrize(("most", "rounds", "many"), [(None, 2, 1), (2, 1, 1), (4, 6, 1), (1, 2, 99)])
def test_walks_of_many_roots_are_one_job_of_several_rounds(spark, monkeypatch, most, rounds, many):
    rnd = random.Random(5)
    pairs = {(rnd.randrange(12), rnd.randrange(12)) for _ in range(22)} | {(3, 3)}
    edges = [(n, o, p) for p, (n, o) in enumerate(rnd.sample(sorted(pairs), len(pairs)))]
    roots, want = [0, 3, 5, 7, 20], set()
    for r in roots:
        want |= _walked(r, edges, most)
    told = traversal.depth_first(spark.createDataFrame([(r,) for r in roots], "root bigint"), spark.createDataFrame(edges, "node bigint, other bigint, place int"), most, rounds, many)
    assert sorted((r.root, r.node, tuple(r.at)) for r in told.collect()) == sorted(want)
    wrote = []
    monkeypatch.setattr(traversal, "written", lambda df: wrote.append(1) or graph.written(df))
    line = spark.createDataFrame([(i, i + 1, 0) for i in range(8)], "node bigint, other bigint, place int")
    assert traversal.depth_first(spark.createDataFrame([(0,)], "root bigint"), line, 4).count() == 6
    assert len(wrote) <= 5


def test_keys_are_worked_out_for_distinct_versions(spark):
    rows = [("a", "1.10"), ("a", "1.9"), ("a", "1.9"), ("a", "x"), ("b", "no"), ("c", "1.0"), ("c", "1"), (None, "2"), ("d", None)]
    df = manifests.newest(spark.createDataFrame(rows * 3, "package string, version string").distinct())
    assert sorted(((r.package, r.version) for r in df.collect()), key=repr) == sorted([("a", "1.10"), ("c", "1.0"), (None, "2")], key=repr)
    plan = _plan(df).split("\n")
    distinct = next(i for i, line in enumerate(plan) if re.search(r"Aggregate \[package#\d+, version#\d+\]", line))
    assert "regexp_extract" in "".join(plan[: distinct + 1]) and "regexp_extract" not in "".join(plan[distinct + 1 :])


def test_each_distinct_requirement_is_read_once(spark):
    files = [(r, p, x) for r in range(4) for p, x in [("requirements.txt", "a==1.0\n-r more.txt\nB_c>=2,<3\nno requirement at all"), ("more.txt", "a==2.0\nd[x]==1.1; os_name == 'nt'")]]
    df = manifests.dependencies(spark.createDataFrame(files, "repo bigint, path string, text string"))
    got = sorted((r.repo, r.n, r.name, r.canonical, r.spec, r.version) for r in df.collect())
    assert got == [(r, *x) for r in range(4) for x in [(1, "a", "a", "a==1.0", "1.0"), (2, "d", "d", "d[x]==1.1; os_name == 'nt'", "1.1"), (3, "B_c", "b-c", "B_c>=2,<3", None)]]
    assert "regexp_extract" not in _plan(df)
