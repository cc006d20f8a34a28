import re

import pytest

from logloom.config import LogProfile, group_names, java, load_profile, merged, profile
from logloom.functions import text as fn
from logloom.operators import logs, resolve, templates
from logloom.sources.logs import read_lines
from pyspark.sql import functions as F

SPRING = LogProfile(
    entry_start=r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}",
    line_pattern=r"(?P<timestamp>\S+ \S+)\s+(?P<level>\w+)\s+\[(?P<context>[^\]]*)\]\s+\S+\s+---\s+\[(?P<thread>[^\]]+)\]\s+(?P<logger>\S+)\s+:\s+(?P<message>.*)",
    service="shop",
)
LOG = """junk before
2024-01-01 10:00:00 INFO [ctx] 1 --- [main] a.B : started 7 jobs
2024-01-01 10:00:01 WARNING [ctx] 1 --- [main] a.B : slow
2024-01-01 10:00:02 ERROR [ctx] 1 --- [w-1] a.C : failed
java.lang.IllegalStateException: bad state
\tat app.Service.run(Service.java:12)
\tat app.Main.main(Main.java:3)
Caused by: java.io.IOException: disk
\tat app.Disk.read(Disk.java:99)
\t... 1 more
2024-01-01 10:00:03 INFO [ctx] 1 --- [main] a.B : started 8 jobs"""


@pytest.fixture(scope="module")
def found(spark):
    lines = spark.createDataFrame([("f", i, s) for i, s in enumerate(LOG.split("\n"), 1)], "file string, line_no bigint, line string")
    return logs.parsed(logs.entries(lines, SPRING), SPRING)


def test_leading_lines_and_continuations(found):
    rows = found.orderBy("entry_id").collect()
    assert [(r.line_number, r.line_end) for r in rows] == [(1, 1), (2, 2), (3, 3), (4, 10), (11, 11)]
    assert [r.level for r in rows] == ["info", "info", "warning", "error", "info"]
    assert [r.thread_id for r in rows] == [None, "main", "main", "w-1", "main"]
    assert rows[3].static_text == "failed" and rows[3].is_error and rows[0].static_text == "junk before" and rows[1].service == "shop"


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_blocks_of_lines_number_entries_alike(spark, block):
    lines = spark.createDataFrame([("f", i, s) for i, s in enumerate(LOG.split("\n"), 1)], "file string, line_no bigint, line string")
    got = [r.entry_id for r in logs.number_entries(lines, SPRING, block_lines=block).orderBy("line_no").collect()]
    assert got == [1, 2, 3, 4, 4, 4, 4, 4, 4, 4, 5]


def test_stack_frames_by_cause(found):
    got = [(r.cause_depth, r.frame_idx, r.class_name, r.method, r.line) for r in logs.stack_frames(found, SPRING, ["entry_id"]).orderBy("cause_depth", "frame_idx").collect()]
    assert got == [(0, 0, "app.Service", "run", 12), (0, 1, "app.Main", "main", 3), (1, 0, "app.Disk", "read", 99)]
    got = [(r.cause_depth, r.exception, r.message) for r in logs.exceptions(found, SPRING, ["entry_id"]).orderBy("cause_depth").collect()]
    assert got == [(0, "java.lang.IllegalStateException", "bad state"), (1, "java.io.IOException", "disk")]


def test_python_traces(spark):
    p = LogProfile(language=["python"])
    text = ["2024-01-01 x", "Traceback", '  File "a/b.py", line 3, in run', '  File "c.py", line 9, in go', "ValueError: one", "KeyError: two"]
    one = spark.createDataFrame([(1, text)], "entry_id int, lines array<string>")
    assert [(r.file, r.line, r.method) for r in logs.stack_frames(one, p, ["entry_id"]).orderBy("frame_idx").collect()] == [("a/b.py", 3, "run"), ("c.py", 9, "go")]
    assert [(r.exception, r.message) for r in logs.exceptions(one, p, ["entry_id"]).collect()] == [("KeyError", "two")]


@pytest.mark.parametrize(("levels", "texts", "want"), [
    (["info"] * 5, ["same"] * 5, [(0, 5)]),
    (["ERROR"] * 4, ["same"] * 4, [(0, 1), (1, 1), (2, 1), (3, 1)]),
    (["warn"] * 3, ["same"] * 3, [(0, 1), (1, 1), (2, 1)]),
    (["info", "error", "info"], ["same"] * 3, [(0, 2), (1, 1)]),
    (["info"] * 3, ["job 7 ran", "job 88 ran", "other"], [(0, 2), (2, 1)]),
    (["debug"] * 2, ["at 2024-01-01T10:00:00Z", "at 2025-02-03T11:11:11Z"], [(0, 2)]),
])
def test_deduplication(spark, levels, texts, want):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(levels, texts, strict=True))], "entry_idx int, level string, static_text string")
    assert [(r.entry_idx, r.repeat_count) for r in logs.deduplicated(rows).orderBy("entry_idx").collect()] == want


@pytest.mark.parametrize(("line", "want"), [
    ("2024-01-01 10:00:00 [main] a : hello - x", "hello - x"), ("2024-01-01 10:00:00 some text - hello", "hello"), ("2024-01-01 plain", "plain"), ("no start", "no start"), ("[a : b] : c", "c"), ("", ""),
])
def test_messages(spark, line, want):
    got = spark.createDataFrame([(line,)], "l string").select(fn.message(F.col("l"), r"^\d{4}-\d{2}-\d{2}", [" : ", " - "]).alias("m")).first().m
    assert got == want


@pytest.mark.parametrize(("line", "want"), [("a WARNING b", "warn"), ("xERROR error", "error"), ("nothing", "info"), ("Fatal: x", "fatal"), ("WARN", "warn")])
def test_levels(spark, line, want):
    assert spark.createDataFrame([(line,)], "l string").select(fn.level(F.col("l"))).first()[0] == want


def test_profiles(tmp_path):
    (tmp_path / "base.yaml").write_text("log_format:\n  entry_start: '^X'\n  error_levels: [error, fatal]\nlanguage: java\n")
    (tmp_path / "own.yaml").write_text("extends: base\nlog_format:\n  error_levels: [panic]\nservice: s\nunknown: 1\n")
    p = load_profile(tmp_path / "own.yaml")
    assert (p.entry_start, p.error_levels, p.service, p.language) == ("^X", ["panic"], "s", "java")
    assert merged({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}}
    (tmp_path / "loop.yaml").write_text("extends: loop\n")
    with pytest.raises(ValueError):
        load_profile(tmp_path / "loop.yaml")
    assert profile({"language": ["cobol", "python"]}).stack["frame"].startswith(r"^\s+File") and profile({"language": "go"}).stack is None


def test_dialect():
    assert java("(?P<a_b>x)(?P=a_b)") == r"(?<ax5Fb>x)\k<ax5Fb>" and java("(?P<ab>x)") == "(?<ab>x)" and java("^x", anchored=True) == r"\A(?:^x)"
    assert group_names(r"(a)(?P<b>c)(d)") == ["", "b", ""]


def test_json_logs(spark):
    p = LogProfile(type="json", field_map={"level": "level", "message": "msg", "thread": "goroutine", "timestamp": "time"}, error_levels=["error"])
    lines = spark.createDataFrame([("f", 1, '{"level":"ERROR","msg":"boom","goroutine":7}'), ("f", 2, "not json")], "file string, line_no bigint, line string")
    rows = logs.parsed(lines.select("line", F.col("line").alias("first"), F.col("line").alias("raw_text")), p).collect()
    assert (rows[0].level, rows[0].static_text, rows[0].thread_id, rows[0].is_error) == ("error", "boom", "7", True) and rows[1].level == "info"


def test_lines_are_numbered_by_file(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.log").write_text("\n".join(f"{n}{i}" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        rows = read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.line[0], r.line_no, r.line) for r in rows) == sorted((n, i + 1, f"{n}{i}") for n in "ab" for i in range(500))


def _model(message, rows):
    """What a message matches, by hand: the longest key that it starts with, then fragments in order."""
    keys = {}
    for fid, frags in rows:
        key = frags[0].strip()
        if len(key) >= 3 and (len(frags) > 1 or len(key) >= 10 or re.search(fn.SYMBOLS, key)):
            keys.setdefault(key, []).append((fid, frags))
    best = max((k for k in keys if message.startswith(k)), key=len, default=None)
    out = set()
    for fid, frags in keys.get(best, []):
        at = len(frags[0])
        for f in frags[1:]:
            k = message.find(f, at)
            if k < 0:
                break
            at = k + len(f)
        else:
            out.add(fid)
    return out


def test_templates_against_a_model(spark):
    import random

    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("ab=") for _ in range(rnd.randint(1, 4)))
    rows = [(i, [word() + word(), *[word() for _ in range(rnd.randint(0, 2))]]) for i in range(200)]
    messages = list({"".join(word() for _ in range(6)) for _ in range(1500)})
    got = {m: set() for m in messages}
    frame = spark.createDataFrame(rows, "fid bigint, frags array<string>")
    for r in templates.matched(spark.createDataFrame([(m,) for m in messages], "static_text string"), frame).collect():
        got[r.static_text].add(r.fid)
    assert got == {m: _model(m, rows) for m in messages} and any(got.values())


def test_first_pass_statuses(spark):
    rows = [(0, "user logged in as 7"), (1, "abc"), (2, "nothing like it"), (3, "two ways here"), (4, "trace")]
    known = [(1, ["user logged in as "], "f", 1), (2, ["two ways", "re"], "g", 1), (3, ["two ways", "here"], "h", 2), (4, ["two ways "], "k", 3)]
    entries = spark.createDataFrame(rows, "entry_idx bigint, static_text string")
    got = resolve.first_pass(entries, spark.createDataFrame(known, "fid bigint, frags array<string>, fname string, line int"), spark.createDataFrame([(4,)], "entry_idx bigint"))
    told = {r.entry_idx: (r.status, r.tier, r.fid) for r in got.collect()}
    assert told[0] == ("hit", 2, 1) and told[1][0] == "skip" and told[2][0] == "miss" and told[3][0] == "ambiguous" and told[4][:2] == ("stack_trace", 1)


def test_ambiguous_entries_follow_the_thread(spark):
    rows = [("t", 1, "hit", 10, None), ("t", 2, "ambiguous", None, [10, 20]), ("t", 3, "ambiguous", None, [30, 40]), ("u", 1, "ambiguous", None, [10, 20])]
    entries = spark.createDataFrame(rows, "thread_id string, entry_idx bigint, status string, fid bigint, candidates array<bigint>")
    hops = spark.createDataFrame([(10, 30, 1)], "src bigint, dst bigint, hops int")
    got = {(r.entry_idx, r.decision, r.fid) for r in resolve.ambiguous_on_thread(entries, hops).collect()}
    assert got == {(2, "resolved", 10), (3, "resolved", 30), (1, "branch", 10)}


def test_frames_of_the_application(spark):
    frames = ["java.util.X", "app.A", "app.B", "app.C", "app.D", "app.E"]
    one = spark.createDataFrame([(frames,), (["java.util.X"],)], "f array<string>").select(resolve.app_frames(F.col("f"), ["java."]).alias("f")).collect()
    assert [r.f for r in one] == [["app.A", "app.B", "app.D", "app.E"], ["java.util.X"]]


def test_resolved_neighbours(spark):
    rows = [(0, "a", 2), (3, "a", 4), (4, "a", 4), (2, "b", 4)]
    e = spark.createDataFrame(rows, "entry_idx bigint, t string, tier int")
    assert sorted(r.entry_idx for r in resolve.near_resolved(e, "entry_idx", "tier", "t").collect()) == [3]
    assert sorted(r.entry_idx for r in resolve.near_resolved(e, "entry_idx", "tier").collect()) == [2, 3]


def test_threads_are_walked_alike_in_blocks_of_any_size(spark):
    import random

    draw = random.Random(3)
    rows, known = [], {(a, b): draw.randint(1, 6) for a in range(8) for b in range(8) if a != b and draw.random() < 0.5}
    for i in range(120):
        if draw.random() < 0.2:
            rows.append((draw.choice(["t", None]), i, "stack_trace", draw.randrange(8), None))
        else:
            rows.append((draw.choice(["t", None]), i, "ambiguous", None, draw.sample(range(8), draw.randint(1, 4))))
    last, want = {}, set()
    for thread, i, status, fid, options in rows:
        if status != "ambiguous":
            last[thread] = fid
            continue
        before = last.get(thread)
        score = lambda c: 0.4 if before is None else 0.9 if c == before else 0.4 + 0.5 / known[before, c] if (before, c) in known else 0.4  # noqa: E731, B023
        best = sorted(options, key=lambda c: (-score(c), c))
        gap = score(best[0]) - (score(best[1]) if len(best) > 1 else 0)
        last[thread] = best[0]
        want.add((i, "resolved" if score(best[0]) > 0.5 and gap > 0.2 else "branch", best[0]))
    entries = spark.createDataFrame(rows, "thread_id string, entry_idx bigint, status string, fid bigint, candidates array<bigint>")
    hops = spark.createDataFrame([(a, b, h) for (a, b), h in known.items()], "src bigint, dst bigint, hops int")
    for block in (7, 50_000):
        got = resolve.ambiguous_on_thread(entries, hops, block=block).collect()
        assert {(r.entry_idx, r.decision, r.fid) for r in got} == want and len(got) == len(want)
