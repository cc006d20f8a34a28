"""Entries against expected logs, and the logs to expect around a function, by hand and by a plain depth-first walk."""

import random

from logloom.operators import alignment


def test_rungs_in_turn(spark):
    entries = [
        (1, 5, "A.run", "job started: 7", "info", "A.run"), (2, 5, "A.run", "saved row 9", "info", "A.run"), (3, 5, "A.run", "swept up", "info", "Z.go"), (4, 5, "A.run", "lost", "error", "Z.go"),
        (5, None, "B.stop", "anything", "warn", "Z.go"), (6, 6, "C.x", None, "info", "Q"), (7, 7, "C.x", "whatever", "info", "Q"), (8, 5, "", "job started", "info", "A"), (9, 5, None, "job started", "info", "A"),
    ]
    e = spark.createDataFrame(entries, "id int, fid bigint, function string, message string, level string, anchor string")
    templates = spark.createDataFrame([(5, "A.run", 0, ["id", " job started", "never"]), (5, "A.run", 1, ["row"]), (6, "C.x", 3, ["ab"]), (7, "C.x", 4, ["zzzzz"]), (7, "C.x", 5, [])], "fid bigint, fname string, ord int, frags array<string>")
    merged = spark.createDataFrame([(5, 0, "row"), (5, 1, "saved"), (5, 2, "saved row")], "fid bigint, ord int, text string")
    runtime = spark.createDataFrame([("Z.go", 0, "walk", "swept"), ("Z.go", 1, "run", "swept"), ("Z.go", 2, "stop", None)], "anchor string, ord int, func string, text string")
    found = alignment.compared(e, templates, merged, runtime)
    assert {r.id: (r.rung, r.label, r.divergence) for r in found.collect()} == {
        1: (1, "A.run[0]", None), 2: (2, "merged[1]", None), 3: (3, "Z.go[1]", None), 4: (None, None, "error_unmapped"), 5: (3, "Z.go[2]", None), 6: (None, None, "unexpected_entry"), 7: (1, "C.x[5]", None),
    }
    assert {r.id: r.actual for r in alignment.divergences(found).collect()} == {4: "A.run [error] lost", 6: "C.x [info] "}
    assert alignment.compared(e.limit(0), templates, merged, runtime).count() == 0


def _expected(nodes, callers, down, up):
    """Depth first with one set of functions that were seen."""
    logs = {f for f, _, kind, _ in nodes if kind == "log"}
    own = {}
    for f, i, kind, to in sorted(nodes, key=lambda n: n[:2]):
        own.setdefault(f, []).append((i, kind, to))

    def walk(f, seen, depth):
        if depth > down:
            return []
        out = []
        for i, kind, to in own[f]:
            if kind == "log":
                out.append((f, i))
            elif to and to in logs and to not in seen:
                seen.add(to)
                out += walk(to, seen, depth + 1)
        return out

    for anchor in sorted(logs):
        seen, above, now = {anchor}, [], anchor
        inner = walk(anchor, seen, 0)
        for _ in range(up):
            now = min((c for f, c in callers if f == now), default=None)
            if now is None or now in seen:
                break
            seen.add(now)
            above = [(now, i) for i, kind, _ in own.get(now, []) if kind == "log"] + above
        yield from ((anchor, n, *x) for n, x in enumerate(above + inner, 1))


def test_expected_logs_are_those_of_a_walk(spark):
    draw = random.Random(11)
    for size, most in ((12, 2), (25, 4)):
        nodes = [(f, i, *(("call", draw.randint(1, size + 2)) if draw.random() < 0.6 else ("log", None))) for f in range(1, size) for i in range(draw.randint(1, 6))]
        callers = [(to, f) for f, _, kind, to in nodes if kind == "call"]
        df = spark.createDataFrame([(f, i, kind, i + 1, "info", f"{f}.{i}", to) for f, i, kind, to in nodes], "fid bigint, node_id int, type string, line int, log_level string, log_text string, call_target_id bigint")
        got = alignment.indexed_logs(df, spark.createDataFrame(callers, "fid bigint, caller bigint"), down=most)
        assert sorted((r.anchor, r.seq_no, r.fid, r.line - 1) for r in got.collect()) == list(_expected(nodes, callers, most, 3))
