"""Statements, node classes, control-flow edges, function ends and closures."""

import pytest

from logloom.functions import languages
from logloom.operators import flows, templates

JAVA = """void run(Order x) {
    log.info("start job {}", x);
    // log.info("not this")
    if (x.size() > 1) {
        helper.call(x);
        if (x == null) {
            throw new Missing("throw {")
        }
    } else {
        log.warn("small " + x + " of " +
            total)
    }
    try {
        store.save(x,
            true);
    } catch (IOException e) {
        log.error('failed')
        return
    } finally { cache.drop(x) }
    println("done")
}"""
PYTHON = """def run(x):
    logger.info("start %s", x)
    if x:
        helper.call(x)
        for y in x:
            store.save(
                y,
            )
    else:
        logger.warning("none")
    try:
        a.b(x)
    except OSError:
        raise
    # a remark

    log.info('end')
    return x"""


def _nodes(spark, source, language):
    f = spark.createDataFrame([(1, source)], "fid bigint, source string")
    found = flows.nodes(f, language=language)
    rows = found.orderBy("node_id").collect()
    links = sorted((r.src, r.dst, r.edge_type) for r in flows.edges(found).collect())
    return rows, links


def test_flow_of_braces(spark):
    rows, links = _nodes(spark, JAVA, "java")
    assert [(r.type, r.line, r.branch_type or r.call_target or r.log_text, r.branch_depth) for r in rows] == [
        ("log", 2, "start job", 0), ("branch", 4, "if", 0), ("call", 5, "helper.call", 1), ("branch", 6, "if", 1), ("throw", 7, None, 2),
        ("branch", 9, "else", 1), ("log", 10, "smallxof", 0), ("branch", 13, "try", 0), ("call", 14, "store.save", 1),
        ("log", 17, "failed", 0), ("return", 18, None, 0), ("call", 19, "cache.drop", 0), ("log", 20, "done", 0),
    ]
    assert rows[1].condition == "x.size() > 1" and rows[0].frags == ["start job "] and rows[12].log_level == "println" and rows[7].statement == 12
    # the else belongs to the outer if, whose block ends there; nothing leads on from throw and return
    assert links == [
        (0, 1, "next"), (1, 2, "next"), (1, 5, "branch_false"), (1, 6, "branch_false"), (2, 3, "next"), (3, 4, "next"), (5, 6, "next"),
        (6, 7, "next"), (7, 8, "next"), (7, 9, "branch_false"), (8, 9, "next"), (9, 10, "next"), (11, 12, "next"),
    ]


def test_flow_of_indentation(spark):
    rows, links = _nodes(spark, PYTHON, "python")
    assert [(r.type, r.line, r.branch_type or r.call_target or r.log_text, r.branch_depth) for r in rows] == [
        ("log", 2, "start", 0), ("branch", 3, "if", 0), ("call", 4, "helper.call", 1), ("branch", 5, "for", 1), ("call", 6, "store.save", 2), ("branch", 9, "else", 1), ("log", 10, "none", 0),
        ("branch", 11, "try", 0), ("call", 12, "a.b", 1), ("branch", 13, "catch", 1), ("throw", 14, None, 0), ("log", 17, "end", 0), ("return", 18, None, 0),
    ]
    assert links == [
        (0, 1, "next"), (1, 2, "next"), (1, 5, "branch_false"), (1, 6, "branch_false"), (2, 3, "next"), (3, 4, "next"), (5, 6, "next"),
        (6, 7, "next"), (7, 8, "next"), (7, 9, "exception"), (7, 10, "branch_false"), (9, 10, "next"), (11, 12, "next"),
    ]


def test_blocks_meet_behind_them(spark):
    rows, links = _nodes(spark, "a.one()\nif (x) {\n  b.two()\n  if (y) {\n    return\n  }\n  c.three()\n}\nd.four()\ncatch (E e) {\ne.five()\n}", "java")
    assert [r.call_target for r in rows if r.type == "call"] == ["a.one", "b.two", "c.three", "d.four", "e.five"]
    # the inner if is passed by where its block returned; a catch without an open branch has no edge
    assert links == [(0, 1, "next"), (1, 2, "next"), (1, 6, "branch_false"), (2, 3, "next"), (3, 4, "next"), (3, 5, "next"), (5, 6, "next"), (7, 8, "next")]


def test_functions_keep_apart_whatever_the_batches(spark):
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    f = spark.createDataFrame([(1, JAVA), (2, None), (3, ""), (4, JAVA), (4, PYTHON)], "fid bigint, source string").coalesce(1)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        small = sorted(map(str, flows.nodes(f).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert small == sorted(map(str, flows.nodes(f).collect()))
    ids = [r.fid for r in flows.nodes(f).collect()]
    assert ids.count(1) == 13 and 2 not in ids and 3 not in ids and ids.count(4) > 13


def test_statements_go_on(spark):
    source = "a(1,\n\n  2)\nb +\n  c\nd\n\nx = [\n 1]"
    f = spark.createDataFrame([(1, source)], "fid bigint, source string")
    assert [(r.n, r.number, r.line) for r in flows.statements(f).collect()] == [(0, 0, "a(1, 2)"), (3, 1, "b + c"), (5, 2, "d"), (6, 3, ""), (7, 4, "x = [ 1]")]
    python = spark.createDataFrame([(1, "a = b \\\n  + c\nd")], "fid bigint, source string")
    assert [r.line for r in flows.statements(python, language="python").collect()] == ["a = b  + c", "d"]


@pytest.mark.parametrize(
    ("source", "language", "end"),
    [
        ("void a() {\n  if (x) { y() }\n}\nvoid b() {\n}", "java", 3), ("void a() {\n  s = \"}\";\n  c = '}'\n}\n", "java", 4), ("one\ntwo", "java", 1), ("void a() { x() }\nb", "java", 1),
        ("def a():\n\n  x\n\n  y\ndef b():\n  z", "python", 5), ("def a():\n  x", "python", 2), ("def a(): x\ny", "python", 1), ("def a():", "python", 1),
    ],
)
def test_function_ends(spark, source, language, end):
    f = spark.createDataFrame([(source,)], "source string")
    assert f.select(flows.function_end(f["source"], language)).first()[0] == end


def test_sources_are_bounded(spark):
    rows = [(1, "f {\n}\nmore\nlast", None, None), (2, "f {\n}\nmore\nlast", 5, 7), (3, "one\ntwo", 3, 3), (4, "\n".join(["x"] * 3000), None, None)]
    got = {r.fid: r for r in flows.bounded(spark.createDataFrame(rows, "fid bigint, source string, start_line int, end_line int")).collect()}
    assert (got[1].bounded, got[1].trimmed) == ("f {\n}", "f {\n}\nmore") and got[2].bounded == got[2].trimmed == "f {\n}\nmore"
    assert got[3].bounded == got[3].trimmed == "one\ntwo"
    assert got[4].bounded.count("\n") == 2999 and got[4].trimmed.count("\n") == flows.MOST_LINES - 1


def test_closures(spark):
    text = "class A {\n  def one = {\n    def inner = {\n    }\n    log.info(\"a }\")\n  }\n  def open = { x }\n  def two = {\n  }\n}\ndef never = {"
    got = [(r.name, r.start_line, r.source.count("\n")) for r in flows.closures(spark.createDataFrame([("a.groovy", text)], "path string, text string")).orderBy("start_line").collect()]
    # a block on one line ends where its depth comes back on a later line
    assert got == [("one", 2, 4), ("open", 7, 2)]


def test_templates_of_sources(spark):
    f = spark.createDataFrame([(1, 'log.info("a {} of {}", x)\nlogger.warn(\n  "on " + n +\n  " lines");\nlog.error("x")\nlog.debug(m)')], "fid bigint, source string")
    assert [(r.line, r.level, r.frags) for r in templates.scanned(f).orderBy("line").collect()] == [(1, "info", ["a ", " of "])]
    assert [(r.line, r.level, r.frags) for r in templates.extracted(f).orderBy("line").collect()] == [(1, "info", ["a ", " of "]), (2, "warn", ["on", "n", "lines"]), (5, "error", ["x"])]


def test_flow_index(spark):
    rows = [(1, "run", "Job", JAVA), (2, "call", "Helper", "void call(x) {\n  log.warn(\"called\")\n  return\n}"), (3, "save", "Store", "void save() {\n}"), (4, "save", "Other", "x"), (5, "later", "Job", "y")]
    f = spark.createDataFrame(rows, "fid bigint, name string, class_name string, source string")
    found, told = flows.flow_index(f, spark.createDataFrame([(1, 2), (1, 5), (3, 5)], "src bigint, dst bigint"))
    got = {r.fid: r for r in found.collect()}
    assert got.keys() == {1, 2}
    assert {n.call_target: n.call_target_id for n in got[1].nodes if n.type == "call"} == {"helper.call": 2, "store.save": 3, "later": 5}
    assert got[1].entry == 0 and got[1].exits == [4, 10] and (10, 12, "next") not in [tuple(e) for e in got[1].edges]
    assert [tuple(e) for e in got[2].edges] == [(0, 1, "next")] and got[2].exits == [1]
    assert sorted((r.fid, r.line) for r in told.collect()) == [(1, 2), (1, 3), (1, 10), (1, 17), (1, 20), (2, 2)]
    text = {r.fid: r.text for r in flows.flow_text(found).collect()}
    assert text[2] == 'L2: log warn "called"\nL3: return' and "  L5: call helper.call" in text[1].split("\n") and "L4: if (x.size() > 1)" in text[1]


def test_languages_from_files(spark, tmp_path):
    path = tmp_path / "tiny.yaml"
    path.write_text("""
block_style: braces
branches:
  when: {pattern: '\\s*when\\s+', has_condition: true, terminator: '{'}
  else: {pattern: '\\s*\\}?\\s*else', links_to: when}
returns: ['\\s*yield\\b']
log_calls: ['\\bsay\\s+(?=")']
method_calls: {pattern: '(\\w+)!(\\w+)', skip_receivers: [it]}
continuation: {trailing_pipe: true}
""")
    tiny = languages.load_language(path)
    assert tiny.name == "tiny" and tiny.trailing == ("|",) and not tiny.brackets
    rows, links = _nodes(spark, 'when x > 1 {\n  say "hello {}"\n  a |\n  b!go\n} else {\n  it!goes\n  yield\n}', tiny)
    assert [(r.type, r.condition or r.call_target or r.log_text) for r in rows] == [("branch", "x > 1"), ("log", "hello"), ("call", "b.go"), ("branch", None), ("return", None)]
    assert links == [(0, 1, "next"), (0, 3, "branch_false"), (0, 4, "branch_false"), (1, 2, "next"), (3, 4, "next")]
    assert languages.language("cobol") is languages.JAVA and languages.language(None) is languages.JAVA
