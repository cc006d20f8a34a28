"""From raw lines to functions, substring joins, numbering and classes."""

import random

from logloom.config import LogProfile
from logloom.operators import analysis, logs, resolve, substrings

PROFILE = LogProfile(
    line_pattern=r"^(?P<timestamp>\S+ \S+) \[(?P<thread>\w+)\] (?P<level>[A-Z]+) (?P<logger>[\w.]*) : (?P<message>.*)",
    continuation_patterns=[r"^\s", r"^\w+\.\w"], ignore_patterns=["heartbeat"], known_errors=[{"pattern": "KNOWN-\\d+"}], framework_markers=["org.fw"],
)
LOG = """2024-01-01 10:00:00 [a] INFO shop.Cart : add item 12 to cart
2024-01-01 10:00:01 [a] INFO shop.Cart : add item 13 to cart
2024-01-01 10:00:02 [a] INFO shop.Beat : heartbeat
2024-01-01 10:00:03 [a] ERROR shop.Cart : cannot pay
pay.PayError: no money
\tat org.fw.Proxy.call(Proxy.java:1)
\tat shop.Cart.pay(Cart.java:7)
\tat shop.Web.post(Web.java:3)
\tat java.util.List.get(List.java:1)
Caused by: io.NetError: down
\tat shop.Net.send(Net.java:9)
2024-01-01 10:00:04 [b] ERROR shop.Cart : cannot pay
2024-01-01 10:00:05 [a] INFO org.fw.Pool : pool is idle
2024-01-01 10:00:06 [a] INFO other.deep.Shelf : the shelf was emptied by sweep
2024-01-01 10:00:07 [a] ERROR shop.Cart : KNOWN-7
2024-01-01 10:00:08 [a] INFO shop.Cart : order done"""
FUNCTIONS = [(1, "Cart", "shop.Cart", "add", "x", ["add item "]), (2, "Cart", "shop.Cart", "pay", "x", []), (3, "ShelfBox", "my.deep.Shelf", "sweep", "x", []), (4, "Web", "shop.Web", "order", "x", [])]


def _tables(spark):
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(LOG.split("\n"), 1)] + [("g", 1, "2024-01-01 10:00:09 [a] INFO shop.Cart : order done")], "file string, line_no bigint, line string")
    functions = spark.createDataFrame(FUNCTIONS, "fid bigint, class_name string, qualified_name string, name string, source string, templates array<string>")
    templates = spark.createDataFrame([(1, ["add item ", " to cart"], "Cart.add", 5), (2, ["order done"], "Cart.pay", 6), (4, ["order done"], "Web.order", 7)], "fid bigint, frags array<string>, fname string, line int")
    return lines, templates, functions, spark.createDataFrame([(2, 4)], "src bigint, dst bigint")


def test_lines_become_resolved_entries(spark):
    lines, *rest = _tables(spark)
    got = {(r.file, r.line_number): r for r in analysis.resolved(lines, PROFILE, *rest).collect()}
    told = {k: (r.tier, r.fid, r.status) for k, r in got.items()}
    assert told == {
        ("f", 1): (2, 1, "hit"), ("f", 2): (2, 1, "hit"), ("f", 4): (1, None, "stack_trace"), ("f", 12): (3, 2, "miss"), ("f", 13): (4, None, "miss"),
        ("f", 14): (3, 3, "miss"), ("f", 16): (3, 2, "ambiguous"), ("g", 1): (3, 2, "ambiguous"),
    }
    error = got["f", 4]
    assert error.line_end == 11 and error.trace == ["shop.Cart.pay", "shop.Web.post"] and error.is_error and error.confidence == 0.95
    assert (got["f", 1].line, got["f", 1].origin_class, got["f", 1].thread_id) == (5, "Cart", "a")
    assert got["f", 13].framework and not got["f", 12].framework and got["f", 14].origin_class == "Shelf"
    # a sweep that leads nowhere came before the order of f, and nothing before that of g
    assert got["f", 16].decision == "branch" and got["f", 16].fids == [2, 4] and got["f", 16].confidence == 0.4 == got["g", 1].confidence
    numbers = sorted(r.entry_idx for r in got.values())
    assert numbers == [0, 1, 2, 3, 4, 5, 6, 17]


def test_signature_groups_are_mapped_back(spark):
    lines, *rest = _tables(spark)
    told = analysis.resolved(lines, PROFILE, *rest, deduplicate=True)
    rows = {(r.file, r.line_number): r.repeat_count for r in told.collect()}
    assert rows == {("f", 1): 2, ("f", 4): 1, ("f", 12): 1, ("f", 13): 1, ("f", 14): 1, ("f", 16): 1, ("g", 1): 1}
    every = logs.kept(logs.parsed(logs.entries(lines, PROFILE), PROFILE), PROFILE)
    back = {(r.file, r.entry_id): (r.tier, r.fid) for r in analysis.spread(told, every).collect()}
    assert len(back) == 8 and back["f", 1] == back["f", 2] == (2, 1) and back["f", 4] == (1, None)


def test_numbers_do_not_depend_on_blocks(spark):
    rows = [(f, i) for f in "ab" for i in range(1, 40) if i % 7]
    df = spark.createDataFrame(rows, "file string, entry_id bigint")
    small, large = ([(r.file, r.entry_id, r.entry_idx) for r in analysis.numbered(df, block=b).orderBy("entry_idx").collect()] for b in (4, 1000))
    assert small == large and [r[:2] for r in small] == rows and small[-1][2] == len(rows) - 1 + analysis.BETWEEN


def test_logs_without_traces_or_threads(spark):
    lines, *rest = _tables(spark)
    bare = LogProfile(line_pattern=PROFILE.line_pattern, language="go", group_by_thread=False)
    got = analysis.resolved(lines.filter("line_no = 1"), bare, *rest).collect()
    assert [(r.file, r.tier, r.trace) for r in sorted(got)] == [("f", 2, []), ("g", 3, [])]
    assert analysis.resolved(lines.limit(0), PROFILE, *rest).count() == 0


def test_needles_in_texts(spark):
    draw = random.Random(5)
    word = lambda n: "".join(draw.choice("abcé") for _ in range(n))
    texts = [(draw.choice("xy"), word(draw.randrange(30))) for _ in range(200)] + [("x", None), ("x", "")]
    needles = [(draw.choice("xy"), word(draw.randrange(7))) for _ in range(60)] + [("y", None), ("y", "")]
    for by in ([], ["k"]):
        want = {((k,) if by else ()) + (t, n, t.index(n) + 1) for k, t in texts for j, n in needles if t and n and n in t and (k == j or not by)}
        got = substrings.contained(spark.createDataFrame(texts, "k string, t string"), spark.createDataFrame(needles, "k string, n string"), "t", "n", by).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want) > 50
    none = spark.createDataFrame([], "n string")
    assert substrings.contained(spark.createDataFrame(texts, "k string, t string"), none, "t", "n").count() == 0


def test_loggers_and_their_classes(spark):
    f = spark.createDataFrame([("Cart", "a.Cart"), ("Inner", "a.b.Outer")], "class_name string, qualified_name string")
    names = spark.createDataFrame([("x.Cart",), ("z.b.Outer",), ("b.Outer",), ("z.c.Outer",), (None,)], "logger string")
    assert {tuple(r) for r in analysis.classes(names, f).collect()} == {("x.Cart", "Cart"), ("z.b.Outer", "Inner")}
    assert {tuple(r) for r in analysis.classes(names, f.select("class_name")).collect()} == {("x.Cart", "Cart")}
    line = spark.createDataFrame([("INFO  : said",), ("[t] x.Y : said",)], "l string")
    assert [r[0] for r in line.select(resolve.logger_class(line["l"], [r"(?P<level>[A-Z]+) (?P<logger>\w*) : .*"])).collect()] == [None, "x.Y"]
