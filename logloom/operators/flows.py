"""Flow graphs of functions from their source lines, contraction of noise calls, and merged log sequences."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions import languages
from ..functions import text as fn
from ..functions.languages import Language
from .graph import call_targets, written
from .templates import scanned

DEPTH, NODES = 6, 500
#: Fixed value: a function whose end isn't found has so many lines at most.
MOST_LINES = 2000
EDGES = "array<struct<src:int,edge_type:string>>"


def function_end(source: Column, language: str | Language = "java") -> Column:
    """The number of lines of the function that a source begins with: one fold over its braces, or its indentation.

    Braces: up to the line where the first opened block is closed again, quoted text left out; 1 where it never is.
    Indentation: up to the line that is indented less than the first line of the body, the end of the text without one.
    """
    lang = languages.language(language)
    if lang.style == "indent":
        white = lambda x: F.length(x) - F.length(F.ltrim(x, F.lit(" \t\n\x0b\f\r")))
        told = F.transform(F.split(source, "\n"), lambda x, i: F.struct(i.alias("i"), white(x).alias("indent"), (white(x) == F.length(x)).alias("blank")))
        body = lambda lines: F.get(F.filter(lines, lambda x: (x["i"] > 0) & ~x["blank"]), F.lit(0))
        out = lambda lines, b: F.get(F.filter(lines, lambda x: (x["i"] > b["i"]) & ~x["blank"] & (x["indent"] < b["indent"])), F.lit(0))
        end = lambda lines, b: F.when(b.isNull() | (b["indent"] == 0), F.lit(1)).otherwise(F.coalesce(out(lines, b)["i"], F.size(lines)))
        return fn.bound(told, lambda lines: fn.bound(body(lines), lambda b: end(lines, b)))
    marks = F.split(F.regexp_replace(F.regexp_replace(F.regexp_replace(source, r'"[^"\n]*"', ""), r"'[^'\n]*'", ""), r"[^{}\n]", ""), "")
    start = F.struct(F.lit(1).alias("line"), F.lit(0).alias("depth"), F.lit(False).alias("opened"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        closed = (s["end"] == 0) & s["opened"] & (c == "}") & (depth == 0)
        return F.struct((s["line"] + F.when(c == "\n", 1).otherwise(0)).alias("line"), depth.alias("depth"), (s["opened"] | (c == "{")).alias("opened"), F.when(closed, s["line"]).otherwise(s["end"]).alias("end"))

    return F.aggregate(marks, start, step, lambda s: F.greatest(s["end"], F.lit(1)))


def _known_end(functions: DataFrame) -> Column:
    if not {"start_line", "end_line"} <= set(functions.columns):
        return F.lit(None).cast("int")
    return F.when(F.col("end_line") > F.col("start_line"), F.col("end_line") - F.col("start_line") + 1).cast("int")


def _first_lines(source: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.split(source, "\n"), F.lit(1), n), "\n")


def bounded(functions: DataFrame, language: str | Language = "java", source: str = "source") -> DataFrame:
    """Adds bounded (for templates) and trimmed (for flows): the source up to the function's end.

    The end is told by start_line and end_line where they are there, else by blocks: then `trimmed` has one more line,
    and a source without an end is whole in `bounded` and has MOST_LINES lines in `trimmed`.
    """
    known, text = _known_end(functions), F.coalesce(F.col(source), F.lit(""))
    held = functions.withColumn("_known", known).withColumn("_end", F.when(F.col("_known").isNull(), function_end(text, language)))
    whole = F.when(F.size(F.split(text, "\n")) > MOST_LINES, _first_lines(text, F.lit(MOST_LINES))).otherwise(text)
    return held.withColumns({
        "bounded": F.when(F.col("_known").isNotNull(), _first_lines(text, F.col("_known"))).when(F.col("_end") > 1, _first_lines(text, F.col("_end"))).otherwise(text),
        "trimmed": F.when(F.col("_known").isNotNull(), _first_lines(text, F.col("_known"))).when(F.col("_end") > 1, _first_lines(text, F.col("_end") + 1)).otherwise(whole),
    }).drop("_known", "_end")


def statements(functions: DataFrame, source: str = "source", language: str | Language = "java") -> DataFrame:
    """fid, n (line of the source, from 0), number (of the statement, from 0), line: lines joined with those they go on in.

    Lines of a function stand side by side as they come from its source, so they are streamed where they are: no shuffle.
    """
    lang = languages.language(language)
    lines = functions.select("fid", F.posexplode(F.split(F.coalesce(F.col(source), F.lit("")), "\n")).alias("n", "l"))
    if not lang.trailing and not lang.brackets:
        return lines.select("fid", "n", F.col("n").alias("number"), F.col("l").alias("line"))
    return lines.mapInArrow(_joining(to_arrow_type(lines.schema["fid"].dataType), lang.trailing, lang.brackets), f"fid {lines.schema['fid'].dataType.simpleString()}, n int, number int, line string")


def _joining(key: pa.DataType, trailing: tuple[str, ...], brackets: bool):
    """Puts the lines of a statement together; holds one statement."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fid, first, number, open_, tail, parts = None, 0, 0, 0, "", []

        for batch in batches:
            rows: list[tuple] = []
            for f, n, line in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if n and parts and tail and (tail.endswith(trailing) or open_ > 0):
                    while len(parts) > 1 and not parts[-1]:
                        parts.pop()
                    parts[-1] = parts[-1].rstrip().rstrip("\\")
                    parts.append(line.strip())
                    tail = line.strip() or tail.rstrip("\\").rstrip()
                else:
                    if parts:
                        rows.append((fid, first, number, " ".join(parts)))
                    number = 0 if n == 0 else number + 1
                    fid, first, open_, tail, parts = f, n, 0, line.rstrip(), [line]
                if brackets:
                    open_ += line.count("(") + line.count("[") - line.count(")") - line.count("]")
            yield _rows(key, rows)
        yield _rows(key, [(fid, first, number, " ".join(parts))] if parts else [])

    return run


def _rows(key: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(columns[0], key), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.string())], names=["fid", "n", "number", "line"])


def classified(lines: DataFrame, language: str | Language = "java") -> DataFrame:
    """Statements with type (return, throw, branch, log, call, null), what belongs to it, and the blocks they open and close.

    A return comes before a branch, a branch before a log, a log before a call; blank lines and comments are nothing. What
    comes later is only looked for where nothing came before, and a step at a time: all in one is too much code to be compiled.
    """
    lang = languages.language(language)
    line, none = F.col("line"), lambda *names: reduce(lambda a, b: a & b, [F.col(n).isNull() for n in names])
    once = lambda df, name, cond, value, use: df.withColumn(name, F.when(cond, fn.bound(value, use)))
    ends = lambda l: F.when(languages.starts_with(l, lang.returns), F.when(l.rlike("throw|raise|panic"), "throw").otherwise("return"))
    told = once(lines, "_silent", F.lit(True), line, lambda l: ~l.rlike(r"\S") | l.rlike(languages.COMMENT))
    told = once(told, "_ends", ~F.col("_silent"), line, ends)
    told = once(told, "_branch", ~F.col("_silent") & none("_ends"), line, lambda l: languages.branch(l, lang))
    told = once(told, "_log", ~F.col("_silent") & none("_ends", "_branch"), line, lambda l: languages.log_call(l, lang))
    told = once(told, "_call", ~F.col("_silent") & none("_ends", "_branch", "_log"), line, lambda l: languages.call(l, lang))
    told = told.withColumn("type", F.coalesce("_ends", F.when(F.col("_branch").isNotNull(), "branch").when(F.col("_log").isNotNull(), "log").when(F.col("_call").isNotNull(), "call")))
    only = lambda t, c: F.when(F.col("type") == t, c)
    told = once(told, "_said", F.col("type") == "log", F.col("_log.rest"), languages.quoted)
    told = once(told, "_frags", F.col("_said").isNotNull(), F.col("_said"), lambda said: languages.fragments(said, language))
    told = told.withColumn("_frags", F.coalesce("_frags", F.array().cast("array<string>")))
    frags = F.col("_frags")
    text = F.when(F.size(frags) > 0, F.array_join(frags, "")).otherwise(F.coalesce("_said", F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(line, r'"[^"]*"', ""), "'[^']*'", "")
    blocks = {"braces": F.when(line.rlike("[{}]"), F.regexp_replace(bare, r"[^{}]", "")).otherwise(""), "indent": F.lit(None).cast("int")}
    if lang.style == "indent":
        blocks = {"braces": F.lit(None).cast("string"), "indent": F.when(~F.col("_silent"), F.length(line) - F.length(F.regexp_replace(line, r"\A\s+", "")))}
    return told.select(
        "fid", "n", "number", "type", only("log", F.col("_log.level")).alias("log_level"), only("log", F.regexp_replace(text, r"\A\s+|\s+\z", "")).alias("log_text"), only("log", frags).alias("frags"),
        only("call", F.col("_call")).alias("call_target"), only("branch", F.col("_branch.name")).alias("branch_type"), only("branch", F.col("_branch.condition")).alias("condition"),
        F.coalesce(only("branch", F.col("_branch.links")), F.lit(False)).alias("links"), *[c.alias(k) for k, c in blocks.items()],
    )


class _Flow:
    """The automaton of one function: the node before, a join to come, and the branches whose blocks are open."""

    def __init__(self):
        self.id, self.before, self.join, self.depth = 0, None, None, 0
        self.open: list[tuple[int, int]] = []  # branch, depth or indentation at which its block ends

    def close(self) -> None:
        branch = self.open.pop()[0]
        if self.before is None:
            self.before = branch
        else:
            self.join = branch

    def dedent(self, indent: int, least: int) -> None:
        """Closes the blocks of branches that are indented `indent` + `least` or more."""
        while self.open and self.open[-1][1] >= indent + least:
            self.close()

    def braces(self, marks: str) -> None:
        for c in marks:
            self.depth += 1 if c == "{" else -1
            if c == "}" and self.open and self.open[-1][1] == self.depth:
                self.close()

    def node(self, kind: str, name: str | None, links: bool, at: int) -> tuple[int, int, list[dict]]:
        """(id, open branches, edges to it) of the next node."""
        own, depth = self.id, len(self.open)
        self.id += 1
        edges = []
        if links:
            if self.open:
                edges.append({"src": self.open[-1][0], "edge_type": "exception" if name in languages.EXCEPTIONS else "branch_false"})
        else:
            if self.before is not None:
                edges.append({"src": self.before, "edge_type": "next"})
            if self.join is not None:
                edges.append({"src": self.join, "edge_type": "branch_false"})
            self.join = None
        self.before = None if kind in ("return", "throw") else own
        if kind == "branch" and not links:
            self.open.append((own, at))
        return own, depth, edges


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of functions whose statements stand side by side and in order; holds the state of one function."""
    flow = _Flow()
    for batch in batches:
        column = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
        rows, made = [], []
        for i, (number, kind, name, links, braces, indent) in enumerate(zip(*[column[c].to_pylist() for c in ("number", "type", "branch_type", "links", "braces", "indent")], strict=True)):
            if number == 0:
                flow = _Flow()
            if indent is not None:
                flow.dedent(indent, 1 if links else 0)
            if kind is not None:
                made.append(flow.node(kind, name, links, flow.depth if indent is None else indent))
                rows.append(i)
            if indent is not None and links:  # it ends the block of the branch that it belongs to
                flow.dedent(indent, 0)
            elif braces:
                flow.braces(braces)
        at = pa.array(rows, pa.int64())
        ids, depths, edges = zip(*made, strict=True) if made else ((), (), ())
        kept = [column[c].take(at) for c in _PASSED]
        new = [pa.array(ids, pa.int32()), pa.array(depths, pa.int32()), pa.array(edges, pa.list_(pa.struct([("src", pa.int32()), ("edge_type", pa.string())])))]
        yield pa.RecordBatch.from_arrays([*kept, *new], names=[*_PASSED, "node_id", "branch_depth", "incoming"])


_PASSED = ["fid", "n", "number", "type", "log_level", "log_text", "frags", "call_target", "branch_type", "condition"]


def nodes(functions: DataFrame, source: str = "source", language: str | Language = "java") -> DataFrame:
    """fid, node_id, line (from 1), statement (from 1), type, log_level, log_text, frags, call_target, branch_type, condition, branch_depth, incoming.

    incoming: the edges to the node (src, edge_type). Each function is read by a stack automaton: a branch stays open until its block
    ends, by braces or by a smaller indentation; what follows has an edge from the block's end (`next`) and one from the
    branch (`branch_false`), `else`, `case` and `default` have one from the innermost open branch (`branch_false`), `catch` and
    `finally` too (`exception`); nothing leads on from a return. Sources are exploded, classified by column functions
    and streamed where they are: no shuffle, and no function is held whole. A null or empty source has no node; rows with
    one fid are functions of their own with node ids that repeat.
    """
    told = classified(statements(functions, source, language), language)
    types = {f.name: f.dataType.simpleString() for f in told.schema}
    found = told.mapInArrow(_walked, ", ".join(f"{c} {types[c]}" for c in _PASSED) + f", node_id int, branch_depth int, incoming {EDGES}")
    return found.select("fid", "node_id", (F.col("n") + 1).alias("line"), (F.col("number") + 1).alias("statement"), "type", "log_level", "log_text", "frags", "call_target", "branch_type", "condition", "branch_depth", "incoming")


def edges(found: DataFrame) -> DataFrame:
    """fid, src, dst, edge_type (next, branch_false, exception) of nodes."""
    return found.select("fid", F.col("node_id").alias("dst"), F.explode("incoming").alias("e")).select("fid", "e.src", "dst", "e.edge_type")


def flow_index(functions: DataFrame, calls: DataFrame | None = None, language: str | Language = "java", source: str = "source", shortest: int = 4) -> tuple[DataFrame, DataFrame]:
    """The build of all flow graphs: (flows, templates) of functions (fid, name, class_name, source, may have start_line and end_line).

    flows: fid, nodes, edges, entry, exits of functions with two nodes or more. Sources are cut at the function's end,
    known calls (calls: src, dst) are put in where the text has none, call targets are looked up by name and by
    class.method, and calls of short or unknown names are bridged. templates: fid, line, level, text, frags.
    """
    held = bounded(functions, language, source)
    found = written(nodes(held, "trimmed", language))
    links = edges(found)
    known = functions.select("name").distinct()
    plain = found.withColumn("call_target_id", F.lit(None).cast("bigint"))
    if calls is not None:
        named = calls.join(functions.select(F.col("fid").alias("dst"), F.col("name").alias("callee")), "dst").groupBy(F.col("src").alias("fid"), "callee").agg(F.max("dst").alias("callee_id")).filter("callee IS NOT NULL")
        said = plain.filter("type = 'call'").select("fid", "node_id", fn.method_name(F.col("call_target")).alias("callee"))
        first = said.groupBy("fid", "callee").agg(F.min("node_id").alias("node_id"))
        met = named.join(first, ["fid", "callee"], "left")
        plain = plain.drop("call_target_id").join(met.filter("node_id IS NOT NULL").select("fid", "node_id", F.col("callee_id").alias("call_target_id")), ["fid", "node_id"], "left")
        last = found.groupBy("fid").agg(F.max("node_id").alias("_last"))
        order = Window.partitionBy("fid").orderBy("callee")
        more = met.filter("node_id IS NULL").select("fid", "callee", "callee_id").join(functions.select("fid"), "fid", "left_semi").withColumn("_r", F.row_number().over(order)).join(last, "fid", "left")
        more = written(more.withColumn("node_id", F.coalesce("_last", F.lit(-1)) + F.col("_r")))
        plain = plain.unionByName(more.select("fid", "node_id", F.lit(-1).alias("line"), F.lit("call").alias("type"), F.col("callee").alias("call_target"), F.col("callee_id").alias("call_target_id"), F.lit(0).alias("branch_depth")), allowMissingColumns=True)
        links = links.unionByName(more.filter("node_id > 0").select("fid", (F.col("node_id") - 1).alias("src"), F.col("node_id").alias("dst"), F.lit("next").alias("edge_type")))
    looked = call_targets(plain.withColumnRenamed("call_target_id", "_told"), functions).withColumn("call_target_id", F.coalesce("_told", "call_target_id")).drop("_told")
    stay, bridged = contracted(looked, links, known, shortest)
    row = F.struct(F.col("node_id").alias("id"), "type", "line", "log_level", "log_text", "call_target", "call_target_id", "branch_type", "condition", "branch_depth")
    own = stay.groupBy("fid").agg(F.array_sort(F.collect_list(row)).alias("nodes")).filter(F.size("nodes") >= 2)
    edge = bridged.groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "edge_type"))).alias("edges"))
    exits = F.transform(F.filter("nodes", lambda x: x["type"].isin("return", "throw")), lambda x: x["id"])
    none = F.array().cast("array<struct<src:int,dst:int,edge_type:string>>")
    flows = own.join(edge, "fid", "left").select("fid", "nodes", F.coalesce("edges", none).alias("edges"), F.get("nodes", F.lit(0))["id"].alias("entry"), F.when(F.size(exits) > 0, exits).otherwise(F.array(F.element_at("nodes", -1)["id"])).alias("exits"))
    return flows, scanned(held.withColumn("source", F.col("bounded")), "source", language)


def flow_text(flows: DataFrame, most: int = 15) -> DataFrame:
    """fid, text: the nodes of a flow graph as lines, indented by their open branches, calls and logs with what they say."""
    said = F.when(F.col("x.type") == "log", F.concat_ws(" ", F.lit("log"), "x.log_level", F.concat(F.lit('"'), "x.log_text", F.lit('"')))).when(F.col("x.type") == "call", F.concat_ws(" ", F.lit("call"), "x.call_target")).when(F.col("x.type") == "branch", F.concat_ws(" ", "x.branch_type", F.when(F.col("x.condition") != "", F.concat(F.lit("("), "x.condition", F.lit(")"))))).otherwise(F.col("x.type"))
    line = F.concat(F.repeat(F.lit("  "), F.least(F.coalesce("x.branch_depth", F.lit(0)), F.lit(most))), F.concat(F.lit("L"), F.col("x.line").cast("string"), F.lit(": ")), said)
    lines = flows.select("fid", F.posexplode("nodes").alias("i", "x")).select("fid", "i", line.alias("l"))
    return lines.groupBy("fid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "l"))), lambda s: s["l"]), "\n").alias("text"))


def closures(files: DataFrame, pattern: str = r"^\s*def\s+(\w+)\s*=\s*\{") -> DataFrame:
    """path, name, start_line (from 1), source of `def x = {` blocks of whole files (path, text), inner ones left to the outer.

    A block ends on the first later line where the depth of braces (quoted text left out) is what it was before it.
    Depths are running sums of each file's lines; ends are met by equal depth. A block without an end is none.
    """
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("n", "l"))
    bare = F.regexp_replace(F.regexp_replace("l", r'"[^"]*"', ""), "'[^']*'", "")
    delta = F.length(F.regexp_replace(bare, r"[^{]", "")) - F.length(F.regexp_replace(bare, r"[^}]", ""))
    order = Window.partitionBy("path").orderBy("n")
    deep = lines.select("path", "n", delta.alias("_d"), F.when(F.col("l").rlike(pattern), F.regexp_extract("l", pattern, 1)).alias("name")).withColumn("_depth", F.sum("_d").over(order))
    begins = deep.filter("name IS NOT NULL").select("path", "n", "name", (F.col("_depth") - F.col("_d")).alias("level"), F.lit(None).cast("int").alias("_end"))
    ends = deep.select("path", "n", F.lit(None).cast("string").alias("name"), F.col("_depth").alias("level"), F.col("n").alias("_end"))
    later = Window.partitionBy("path", "level").orderBy("n").rangeBetween(1, Window.unboundedFollowing)
    spans = begins.unionByName(ends).withColumn("end", F.min("_end").over(later)).filter("name IS NOT NULL AND end IS NOT NULL").select("path", "n", "name", "end")
    start = F.struct(F.lit(-1).alias("last"), F.array().cast("array<struct<n:int,name:string,end:int>>").alias("kept"))
    pick = F.aggregate(F.array_sort(F.collect_list(F.struct("n", "name", "end"))), start, lambda s, x: F.when(x["n"] > s["last"], F.struct(x["end"].alias("last"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s), lambda s: s["kept"])
    outer = spans.groupBy("path").agg(pick.alias("kept")).select("path", F.explode("kept").alias("k"))
    return outer.join(files.select("path", "text"), "path").select("path", "k.name", (F.col("k.n") + 1).alias("start_line"), F.array_join(F.slice(F.split("text", "\n"), F.col("k.n") + 1, F.col("k.end") - F.col("k.n") + 1), "\n").alias("source"))


def contracted(found: DataFrame, links: DataFrame, known: DataFrame, shortest: int = 4) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without calls of short or unknown names; edges through dropped nodes are bridged as `next`.

    Chains of dropped nodes are followed a node at a time for all functions at once, until none is left; a node on a cycle of
    dropped ones is passed once for each source.
    """
    name = F.element_at(F.split(F.coalesce("call_target", F.lit("")), r"\."), -1)
    named = found.withColumn("_n", name).join(known.select(F.col("name").alias("_n"), F.lit(True).alias("_k")).distinct(), "_n", "left")
    drop = (F.col("type") == "call") & ((F.length("_n") < shortest) | F.col("_k").isNull())
    gone = named.filter(drop).select("fid", F.col("node_id").alias("x"))
    stay = named.filter(~drop).drop("_n", "_k")
    open_ = links.select("fid", "src", "dst", "edge_type")
    direct = done = seen = None
    while True:
        hits = open_.join(gone, (open_["fid"] == gone["fid"]) & (open_["dst"] == gone["x"]), "left").select(open_["fid"], "src", "dst", "edge_type", "x")
        fine = hits.filter("x IS NULL").drop("x")
        if direct is None:
            direct = fine
        else:
            done = fine if done is None else done.unionByName(fine)
        through = hits.filter("x IS NOT NULL").select("fid", "src", F.col("x").alias("m"))
        on = links.select("fid", F.col("src").alias("m"), "dst")
        new = through.join(on, ["fid", "m"]).select("fid", "src", "dst", F.lit("next").alias("edge_type")).distinct()
        open_ = written(new if seen is None else new.join(seen, ["fid", "src", "dst"], "left_anti"))
        if open_.isEmpty():
            break
        pairs = open_.select("fid", "src", "dst")
        seen = pairs if seen is None else written(seen.unionByName(pairs))
    # a bridge stands only where no edge did
    whole = direct if done is None else direct.unionByName(done.join(direct, ["fid", "src", "dst"], "left_anti").select(direct.columns))
    bridged = whole.join(gone, (whole["fid"] == gone["fid"]) & (whole["src"] == gone["x"]), "left_anti").distinct()
    return stay, bridged


def merged_logs(anchors: DataFrame, found: DataFrame, depth: int = DEPTH, most: int = NODES) -> DataFrame:
    """anchor, seq_no, fid, line, level, text: logs of an anchor function with its callees' logs where they are called.

    found: nodes with call_target_id. Callees are followed level by level to `depth`; the place of a log is the path of
    places that leads to it. A function that several paths lead to counts where it comes first.
    """
    flow = found.select("fid", "node_id", "type", "line", "log_level", "log_text", "call_target_id")
    level = anchors.select(F.col("fid").alias("anchor"), "fid", F.array().cast("array<int>").alias("at"), F.array("fid").alias("way"))
    logs = None
    for k in range(depth + 1):
        here = level.join(flow, "fid")
        own = here.filter("type = 'log'").select("anchor", "fid", "way", F.concat("at", F.array("node_id")).alias("at"), "line", F.col("log_level").alias("level"), F.col("log_text").alias("text"))
        logs = own if logs is None else logs.unionByName(own)
        if k == depth:
            break
        down = here.filter(F.col("call_target_id").isNotNull() & ~F.array_contains("way", F.col("call_target_id")))
        new = down.select("anchor", F.col("call_target_id").alias("fid"), F.concat("at", F.array("node_id")).alias("at"), F.concat("way", F.array("call_target_id")).alias("way"))
        first = new.groupBy("anchor", "fid").agg(F.min_by(F.struct("at", "way"), "at").alias("s"))
        level = written(first.select("anchor", "fid", "s.at", "s.way"))
        if level.isEmpty():
            break
    once = logs.withColumn("_first", F.min(F.slice("at", F.lit(1), F.size("at") - 1)).over(Window.partitionBy("anchor", "fid"))).filter(F.slice("at", F.lit(1), F.size("at") - 1) == F.col("_first"))
    numbered = once.withColumn("seq_no", F.row_number().over(Window.partitionBy("anchor").orderBy("at")))
    return numbered.filter(F.col("seq_no") <= most).select("anchor", "seq_no", "fid", "line", "level", "text")
