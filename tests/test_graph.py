import random

import pytest
from pyspark.sql import functions as F

from logloom.functions import text as fn
from logloom.operators import flows, graph, retrieval, selection


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src bigint, dst bigint")


def _first_visit(seeds, pairs, most):
    """Depth and origin by hand: an id takes over the origin of its smallest predecessor when it is first seen."""
    seen = {s: (0, s) for s in seeds}
    frontier = set(seeds)
    for depth in range(1, most + 1):
        new = {}
        for a, b in sorted(set(pairs)):
            if a in frontier and b not in seen and b not in new:
                new[b] = (depth, seen[a][1])
        seen |= new
        frontier = set(new)
    return seen


@pytest.mark.parametrize("seed", range(3))
def test_reach_on_random_cyclic_graphs(spark, seed):
    rnd = random.Random(seed)
    pairs = [(rnd.randint(0, 25), rnd.randint(0, 25)) for _ in range(45)] + [(3, 3), (1, 2), (2, 1)]
    got = {r.id: (r.depth, r.origin) for r in graph.reach(spark.createDataFrame([(0,), (7,)], "id bigint"), edges_of(spark, pairs), 4, origin=True).collect()}
    assert got == _first_visit([0, 7], pairs, 4)


def test_shortest_paths_and_pairs(spark):
    e = edges_of(spark, [(1, 2), (2, 3), (3, 1), (1, 4), (4, 3), (3, 5)])
    got = {r.id: (r.hops, r.path) for r in graph.shortest_paths(spark.createDataFrame([(1,)], "id bigint"), e).collect()}
    assert got[3] == (2, [1, 2, 3]) and got[5] == (3, [1, 2, 3, 5]) and got[1] == (0, [1])
    hops = {(r.src, r.dst): r.hops for r in graph.pair_hops(spark.createDataFrame([(1, 5), (5, 1), (2, 1)], "src bigint, dst bigint"), e).collect()}
    assert hops == {(1, 5): 3, (2, 1): 2}


def test_classes_of_nodes(spark):
    pairs = [(i, 100) for i in range(12)] + [(100, 50), (50, 60), (0, 50)]
    f = spark.createDataFrame([(0,), (50,), (60,), (100,), (999,)], "fid bigint")
    got = {r.fid: r.node_class for r in graph.classified(f, edges_of(spark, pairs), F.col("fid") == 50).collect()}
    assert got == {0: "entry", 50: "anchor", 60: "leaf", 100: "utility", 999: "entry"}


def test_lookups(spark):
    f = spark.createDataFrame([(1, "run", "/a/shop/x.py", "A", "go()"), (2, "run", "/a/B.py", "B", "x.run()"), (3, "runner", "/c", "C", "")], "fid bigint, name string, path string, class_name string, source string")
    assert [r.fid for r in graph.resolve(f, "run", "B").collect()] == [2] and graph.resolve(f, "run", "Z").count() == 2
    assert [(r.fid, r.prio) for r in graph.mentions(f, "run", 10).collect()] == [(1, 0), (2, 0), (3, 0)]
    assert f.filter(graph.in_repo(F.col("path"), "shop")).count() == 1 and f.filter(graph.in_repo(F.col("path"), "sho")).count() == 0
    calls = edges_of(spark, [(2, 1), (2, 1), (3, 1)])
    assert sorted(r.other for r in graph.neighbours(calls, f, f.filter("fid = 1")).collect()) == [2, 3]
    assert [r.fid for r in graph.neighbours(calls, f, f.filter("fid = 2"), "callees").select(F.col("other").alias("fid")).collect()] == [1]


def test_repairs(spark):
    f = spark.createDataFrame([(1, "save", "p", "Repo", ""), (2, "go", "q", "Svc", "self.repository.save(x)"), (3, "lonely", "r", "X", "y.save()")], "fid bigint, name string, path string, class_name string, source string")
    classes = spark.createDataFrame([("Repo", "p"), ("Svc", "q")], "class_name string, path string")
    have = spark.createDataFrame([("Repo", 1)], "class_name string, fid bigint")
    assert [(r.class_name, r.fid) for r in graph.missing_members(classes, f, have).collect()] == [("Svc", 2)]
    nodes = spark.createDataFrame([(2, "call", "repository.save")], "fid bigint, type string, call_target string")
    injects = spark.createDataFrame([("Svc", "repository", "Repo")], "class_name string, field_name string, injected string")
    assert [(r.src, r.dst) for r in graph.injected_calls(nodes, f, injects).collect()] == [(2, 1)]
    assert sorted((r.src, r.dst) for r in graph.token_calls(f, edges_of(spark, []), shortest=4).collect()) == [(2, 1), (3, 1)]


def test_prefixes_match_at_dots(spark):
    i = spark.createDataFrame([("pkg.api",), ("pkg.apiclient",), ("pkg",), ("other",)], "imported string")
    t = spark.createDataFrame([("pkg.api.client",), ("pkg.api",)], "target string")
    assert sorted((r.imported, r.target) for r in selection.prefix_matched(i, t).collect()) == [("pkg", "pkg.api"), ("pkg", "pkg.api.client"), ("pkg.api", "pkg.api"), ("pkg.api", "pkg.api.client")]


def test_selection_of_tests(spark):
    contacts = spark.createDataFrame([(1,)], "fid bigint")
    got = {r.fid: (r.depth, r.origin) for r in selection.by_callers(contacts, edges_of(spark, [(2, 1), (3, 2), (1, 3)])).collect()}
    assert got == {2: (1, 1), 3: (2, 1)}
    imports = spark.createDataFrame([("t/test_a.py", "t.test_a", "src.mid"), ("src/mid.py", "src.mid", "src.core"), ("t/test_b.py", "t.test_b", "src.corex")], "file_path string, module string, imported string")
    got = {r.module: (r.depth, r.origins) for r in selection.by_imports(spark.createDataFrame([("src.core",)], "module string"), imports).collect()}
    assert got == {"src.mid": (1, ["src.core"]), "t.test_a": (2, ["src.core"])}
    a = spark.createDataFrame([(2, 1), (3, 1)], "fid bigint, origin bigint")
    b = spark.createDataFrame([(3, 9)], "fid bigint, origin bigint")
    rows = selection.union(a, b, 1).collect()
    assert [(r.fid, r.origins, r.strategy, r.truncated) for r in rows] == [(2, [1], "callers", True)]
    assert selection.union(a, b, -5).count() == 0
    assert [(r.fid, r.origins) for r in selection.union(a, b, 9).collect()] == [(2, [1]), (3, [1, 9])]


def test_names(spark):
    one = spark.createDataFrame([("src/pkg/__init__.py", "src/pkg/mod.py", "A::b", "a.b.C", "x/y", "My Fix: #12!")], "a string, b string, c string, d string, e string, f string")
    r = one.select(fn.module_name(F.col("a")), fn.module_name(F.col("b")), fn.method_name(F.col("c")), fn.method_name(F.col("d")), fn.method_name(F.col("e")), fn.slug(F.col("f"))).first()
    assert list(r) == ["pkg", "pkg.mod", "b", "C", "y", "my-fix-12"]
    tests = spark.createDataFrame([("test_a", "tests/x.py"), ("test_a", "src/tests.py"), ("help", "tests/x.py")], "n string, p string")
    assert [r[0] for r in tests.select(selection.is_test(F.col("n"), F.col("p"))).collect()] == [True, False, False]
    assert spark.range(1).select(selection.node_id(F.lit("p.py"), F.lit("T"), F.lit("test_a")), selection.node_id(F.lit("p.py"), F.lit(""), F.lit("t"))).first()[:] == ("p.py::T::test_a", "p.py::t")


def test_chunks(spark):
    words = " ".join(f"w{i}" for i in range(600))
    rows = retrieval.chunks(spark.createDataFrame([(1, words), (2, "just  a few\nwords are here"), (3, "short")], "fid int, source string"), "fid", "source").orderBy("fid", "chunk_no").collect()
    assert [(r.fid, r.chunk_no, len(r.chunk.split())) for r in rows] == [(1, 0, 256), (1, 1, 256), (1, 2, 256), (1, 3, 132), (2, 0, 6)]
    assert rows[-1].chunk == "just  a few\nwords are here"


def test_ranks_are_fused(spark):
    hits = [(0, 1, 0.9, 1), (0, 2, 0.8, 2), (1, 2, 0.7, 1), (1, 3, 0.6, 2), (2, 4, 0.5, 1)]
    rows = retrieval.fused(spark.createDataFrame(hits, "lane int, fid bigint, score double, rank int"), 3).collect()
    assert [r.fid for r in rows] == [2, 1, 4] and rows[0].lanes == 2 and rows[0].best_lane == 0 and abs(rows[0].rrf - (1 / 62 + 1 / 61)) < 1e-12


def test_tiers_boosts_and_merges(spark):
    c = spark.createDataFrame([(1, 0.9), (2, 0.5), (3, 0.2)], "fid bigint, score double")
    ran = spark.createDataFrame([(1,), (1,), (3,)], "fid bigint")
    bad = spark.createDataFrame([(1,), (7,), (7,)], "fid bigint")
    assert sorted((r.fid, r.tier, r.log_count) for r in retrieval.tiered(c, ran, bad).collect()) == [(1, 1, 2), (2, 2, 0), (7, 3, 0)]
    classes = spark.createDataFrame([(1, "leaf"), (2, "entry")], "fid bigint, node_class string")
    got = {r.fid: round(r.score, 6) for r in retrieval.boosted(c, bad, classes).collect()}
    assert got == {1: 0.92, 2: 0.53, 3: 0.2}
    assert [(r.fid, r.score) for r in retrieval.merged(c, spark.createDataFrame([(2, 0.95)], "fid bigint, score double"), 2).collect()] == [(2, 0.95), (1, 0.9)]


def test_call_paths(spark):
    got = [tuple(r.path) for r in retrieval.call_paths(spark.createDataFrame([(1,)], "fid bigint"), edges_of(spark, [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5)])).orderBy("path").collect()]
    assert got == [(1, 2, 3, 4)]


SOURCE = """def run(x) {
    log.info("start job {}", x)
    if (x > 1) {
        helper.call(x)
        log.warn("big")
    }
    x.go(x)
    return x
}"""


def test_flow_graphs(spark):
    f = spark.createDataFrame([(1, SOURCE)], "fid bigint, source string")
    nodes = flows.nodes(f)
    got = [(r.node_id, r.type, r.line, r.log_level, r.call_target, r.branch_depth) for r in nodes.orderBy("node_id").collect()]
    assert got == [(0, "log", 2, "info", None, 0), (1, "branch", 3, None, None, 0), (2, "call", 4, None, "helper.call", 1), (3, "log", 5, "warn", None, 1), (4, "call", 7, None, "x.go", 0), (5, "return", 8, None, None, 0)]
    links = flows.edges(nodes)
    assert sorted((r.src, r.dst, r.edge_type) for r in links.collect()) == [(0, 1, "next"), (1, 2, "next"), (1, 4, "branch_false"), (2, 3, "next"), (3, 4, "next"), (4, 5, "next")]
    stay, bridged = flows.contracted(nodes, links, spark.createDataFrame([("call",)], "name string"))
    assert sorted(r.node_id for r in stay.collect()) == [0, 1, 2, 3, 5]
    assert sorted((r.src, r.dst, r.edge_type) for r in bridged.collect()) == [(0, 1, "next"), (1, 2, "next"), (1, 5, "next"), (2, 3, "next"), (3, 5, "next")]


def test_logs_of_callees_are_merged_in_place(spark):
    rows = [(1, 0, "log", 1, "info", "a", None), (1, 1, "call", 2, None, None, 2), (1, 2, "log", 3, "info", "c", None), (2, 0, "log", 1, "info", "b", None), (2, 1, "call", 2, None, None, 1)]
    nodes = spark.createDataFrame(rows, "fid bigint, node_id int, type string, line int, log_level string, log_text string, call_target_id bigint")
    got = [(r.seq_no, r.fid, r.text) for r in flows.merged_logs(spark.createDataFrame([(1,)], "fid bigint"), nodes).orderBy("seq_no").collect()]
    assert got == [(1, 1, "a"), (2, 2, "b"), (3, 1, "c")]


def test_long_and_circular_chains_are_bridged(spark):
    nodes = [(1, i, "call", "zz") for i in range(1, 9)] + [(1, 0, "log", None), (1, 9, "log", None)] + [(2, i, "call" if i else "log", "zz" if i else None) for i in range(3)]
    found = spark.createDataFrame(nodes, "fid bigint, node_id int, type string, call_target string")
    links = [(1, i, i + 1, "next") for i in range(9)] + [(2, 0, 1, "next"), (2, 1, 2, "next"), (2, 2, 1, "next")]
    stay, bridged = flows.contracted(found, spark.createDataFrame(links, "fid bigint, src int, dst int, edge_type string"), spark.createDataFrame([("call",)], "name string"))
    assert [tuple(r) for r in bridged.collect()] == [(1, 0, 9, "next")] and stay.count() == 3
