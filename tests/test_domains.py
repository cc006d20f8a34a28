"""Domains by brute force on random graphs, their texts, and searches that are routed to them."""

import random

import pytest

from logloom.operators import graph, retrieval


def _tree(start, calls, hops):
    seen, level = {start}, {start}
    for _ in range(hops):
        level = {d for s, d in calls if s in level} - seen
        seen |= level
    return seen


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_wide_by_brute_force(spark, seed):
    rng = random.Random(seed)
    n = 60
    calls = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([30, 60, 90]))})
    functions = spark.createDataFrame([(i,) for i in range(n)], "fid long")
    for hops, least in ((2, 4), (5, 5), (1, 2)):
        got = {r.fid for r in graph.wide(functions, spark.createDataFrame(calls, "src long, dst long"), hops, least).collect()}
        assert got == {i for i in range(n) if len(_tree(i, calls, hops)) >= least}


def test_index(spark):
    functions = spark.createDataFrame(
        [(1, "start", "src/a/Start.groovy"), (2, "b", "x.java"), (3, "c", "x.java"), (4, "d", "x.java"), (5, "e", "x.java"), (6, "f", "x.java"), (7, "g", "x.java"), (8, "small", "Small.java"), (9, "loop", "Loop.java"), (10, "chain", None)],
        "fid long, name string, path string",
    )
    # 1 calls seven; 8 reaches four; 9 calls itself, so it is called; 10 has no path; 99 is no function
    calls = [(1, d) for d in range(2, 8)] + [(1, 99), (8, 2), (8, 3), (8, 4), (9, 9)] + [(9, d) for d in range(2, 7)] + [(10, 2), (2, 3), (3, 4), (4, 5), (10, 2)]
    summaries = spark.createDataFrame([(1, "s" * 300), (2, "other")], "fid long, summary string")
    edges = spark.createDataFrame(calls, "src long, dst long")
    got = {r.entry: (r.label, r.text) for r in graph.domain_index(functions, edges, summaries).collect()}
    assert got == {1: ("start (Start)", "start Start b c d e f " + "s" * 200), 8: ("small (Small)", "small Small b c d "), 10: (None, "chain  b ")}
    less = {r.entry for r in graph.domain_index(functions, edges.filter("src <> 2"), summaries).collect()}
    assert less == {1, 8}  # 8 still reaches 2, 3, 4 and 5; 10 only 2; 3 has callers
    assert graph.domain_index(functions, edges.limit(0), summaries).count() == 0


def test_routing(spark):
    vectors = spark.createDataFrame([(i, [1.0, 0.0] if i < 4 else [0.0, 1.0]) for i in range(8)], "entry long, embedding array<double>")
    queries = spark.createDataFrame([(1, [0.6, 0.8]), (2, [0.39, -0.9])], "query_id long, qvec array<double>")
    got = sorted((r.query_id, r.entry) for r in retrieval.routed(vectors, queries).collect())
    assert got == [(1, 0), (1, 4), (1, 5), (1, 6), (1, 7)]  # five at most, 0.40 at least

    calls = spark.createDataFrame([(0, 10), (10, 11), (11, 0), (4, 10), (7, 12)], "src long, dst long")
    routed = spark.createDataFrame([(1, 0), (1, 4), (3, 7)], "query_id long, entry long")
    members = graph.domain_members(routed, calls)
    assert sorted(map(tuple, members.collect())) == [(1, 0), (1, 4), (1, 10), (1, 11), (3, 7), (3, 12)]

    hits = spark.createDataFrame([(1, 20, 0.50, 1), (1, 10, 0.47, 2), (1, 21, 0.49, 3), (1, 22, 0.45, 4), (2, 20, 0.5, 1), (2, 22, 0.4, 2)], "query_id long, fid long, score double, rank int")
    classes = spark.createDataFrame([(20, "leaf"), (22, "anchor"), (21, "utility")], "fid long, node_class string")
    out = retrieval.domain_search(hits, routed, members, classes, 3).collect()
    ranked = {q: [(r.fid, round(r.score, 6), r.domain_match) for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == q] for q in (1, 2)}
    # 10 is a member; 21 and 22 change places only if raised; equal scores keep their order
    assert ranked == {1: [(10, 0.52, True), (21, 0.49, False), (22, 0.48, False)], 2: [(20, 0.5, False), (22, 0.4, False)]}
