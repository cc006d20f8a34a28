"""Flow queries: eight orders in a row are a function, their lines are lines of its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import languages
from ..operators import flows, templates
from ..sources import trees
from .registry import query, table

ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity"
#: The text of a line, in SQL that Spark and DuckDB share.
BRACES = """CASE l_partkey % 16 WHEN 0 THEN '  if (q(' || l_linenumber || ') > 3) {' WHEN 1 THEN '} else {' WHEN 2 THEN '}' WHEN 3 THEN ' } ' WHEN 4 THEN 'try {' WHEN 5 THEN ' catch (Failure e) {'
WHEN 6 THEN 'log.info("part {} of {} for ' || l_linenumber || '", p)' WHEN 7 THEN 'LOG.warn("late %s and " + n + " days")' WHEN 8 THEN CASE WHEN l_quantity > 30 THEN 'store.save(p,' ELSE 'store.load' || l_linenumber || '(p)' END WHEN 9 THEN 'total)' WHEN 10 THEN 'return p'
WHEN 11 THEN 'throw new Failure("x {")' WHEN 12 THEN 'finally { cache.drop(p) }' WHEN 13 THEN '// log.error("no") {' WHEN 14 THEN 'def part' || l_linenumber || ' = {' ELSE 'case 3: print("it is")' END"""
INDENTED = """repeat('    ', (l_suppkey % 4)::INT) || CASE l_partkey % 12 WHEN 0 THEN 'if x:' WHEN 1 THEN 'else:' WHEN 2 THEN 'elif q(' || l_linenumber || '):' WHEN 3 THEN 'try:' WHEN 4 THEN 'except OSError:' WHEN 5 THEN 'finally:'
WHEN 6 THEN 'logger.info("part %s of ' || l_linenumber || '", p)' WHEN 7 THEN 'for y in x:' WHEN 8 THEN 'store.save(p)' WHEN 9 THEN 'raise Missing()' WHEN 10 THEN '# return' ELSE '' END"""


def _lines(form: str) -> str:
    return f"src AS (SELECT l_orderkey // 8 AS fid, row_number() OVER (PARTITION BY l_orderkey // 8 ORDER BY {ORDER}) - 1 AS n, {form} AS l FROM lineitem)"


def _sources(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    """fid, source: lines of eight orders."""
    line = F.expr(form.replace("::INT", "").replace("(l_suppkey % 4)", "cast(l_suppkey % 4 AS int)"))
    items = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 8").alias("fid"), F.struct(*ORDER.split(", "), line.alias("l")).alias("s"))
    return items.groupBy("fid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["l"]), "\n").alias("source"))


# A statement goes on while its text ends like one that does, or has a bracket open.
STATEMENTS = """joined AS (SELECT fid, n, n AS first, 0 AS number, l AS line FROM src WHERE n = 0 UNION ALL
SELECT s.fid, s.n, CASE WHEN c THEN j.first ELSE s.n END, CASE WHEN c THEN j.number ELSE j.number + 1 END, CASE WHEN c THEN rtrim(j.line) || ' ' || trim(s.l) ELSE s.l END
FROM (SELECT *, trim(line) <> '' AND (right(rtrim(line), 1) IN (TRAILING) OR length(regexp_replace(line, '[^(\\[]', '', 'g')) > length(regexp_replace(line, '[^)\\]]', '', 'g'))) AS c FROM joined) j JOIN src s ON s.fid = j.fid AND s.n = j.n + 1),
statements AS (SELECT fid, number, any_value(first) AS n, arg_max(line, n) AS line FROM joined GROUP BY fid, number)"""
JAVA_STATEMENTS = STATEMENTS.replace("TRAILING", "'+', '&', '|', '.', ','")
JAVA_NODES = r"""told AS (SELECT *, trim(line) AS s, trim(line) = '' OR regexp_matches(line, '^\s*(//|/\*|\*/|\*|#)') AS silent, regexp_extract(line, '(?i)\b(?:log|logger)\s*\.\s*(trace|debug|info|warn|error|fatal)\s*\(', 1) AS lvl,
  regexp_extract(line, '(?i)\b(println|print)\s*\(', 1) AS prt, regexp_extract(coalesce(nullif(regexp_extract(line, '(?i)\b(?:log|logger)\s*\.\s*(?:trace|debug|info|warn|error|fatal)\s*\((.*)', 1), ''), regexp_extract(line, '(?i)\b(?:println|print)\s*\((.*)', 1)), '"(.*)"', 1) AS quoted,
  CASE WHEN regexp_matches(line, '^\s*(if|else\s*if)\s*\(') THEN 'if' WHEN regexp_matches(line, '^\s*\}?\s*else\s*\{?') THEN 'else' WHEN regexp_matches(line, '^\s*try') THEN 'try' WHEN regexp_matches(line, '^\s*catch\s*\(') THEN 'catch' WHEN regexp_matches(line, '^\s*finally') THEN 'finally' WHEN regexp_matches(line, '^\s*case\s') THEN 'case' END AS branch,
  regexp_extract(line, '(\w+)\s*\.\s*(\w+)\s*\(', 1) AS receiver, regexp_extract(line, '(\w+)\s*\.\s*(\w+)\s*\(', 2) AS method FROM statements),
kinds AS (SELECT *, CASE WHEN silent THEN NULL WHEN regexp_matches(line, '^\s*(return|throw|break|continue)\b') THEN CASE WHEN regexp_matches(line, 'throw|raise|panic') THEN 'throw' ELSE 'return' END WHEN branch IS NOT NULL THEN 'branch' WHEN lvl <> '' OR prt <> '' THEN 'log'
  WHEN receiver <> '' AND receiver NOT IN ('log', 'logger', 'LOG') AND NOT regexp_matches(s, '^(if|else|for|while|switch|return|throw|try|catch)') THEN 'call' END AS type, regexp_replace(regexp_replace(regexp_replace(line, '"[^"]*"', '', 'g'), '''[^'']*''', '', 'g'), '[^{}]', '', 'g') AS braces FROM told),
frags AS (SELECT *, CASE WHEN contains(quoted, '{}') THEN string_split(quoted, '{}') WHEN regexp_matches(quoted, '%[sd]') THEN regexp_split_to_array(quoted, '%[-+0-9*.]*[sdflxvqweEgGoO]') WHEN contains(quoted, '+') AND contains(quoted, '"') THEN [trim(trim(x), '"') FOR x IN regexp_split_to_array(quoted, '"\s*\+\s*|\s*\+\s*"')] ELSE [quoted] END AS f FROM kinds),
events AS (SELECT fid, number, 0 AS k, type, branch, coalesce(branch NOT IN ('if', 'try'), FALSE) AS links, '' AS c FROM frags WHERE type IS NOT NULL UNION ALL SELECT fid, number, unnest(range(1, length(braces) + 1)), NULL, NULL, FALSE, unnest(string_split(braces, '')) FROM frags WHERE braces <> ''),
steps AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY number, k) AS i FROM events),
walk AS (SELECT fid, 0::BIGINT AS i, 0 AS number, 0 AS id, NULL::INT AS before, NULL::INT AS later, 0 AS depth, []::STRUCT(id INT, lv INT)[] AS st, FALSE AS made, 0 AS open, []::STRUCT(src INT, edge_type VARCHAR)[] AS e FROM (SELECT DISTINCT fid FROM steps) UNION ALL
SELECT w.fid, s.i, s.number, CASE WHEN s.c = '' THEN w.id + 1 ELSE w.id END,
  CASE WHEN s.c = '' THEN CASE WHEN s.type IN ('return', 'throw') THEN NULL ELSE w.id END WHEN s.c = '}' AND len(w.st) > 0 AND w.st[-1].lv = w.depth - 1 THEN coalesce(w.before, w.st[-1].id) ELSE w.before END,
  CASE WHEN s.c = '' THEN CASE WHEN s.links AND s.type = 'branch' THEN w.later END WHEN s.c = '}' AND len(w.st) > 0 AND w.st[-1].lv = w.depth - 1 AND w.before IS NOT NULL THEN w.st[-1].id ELSE w.later END,
  CASE s.c WHEN '{' THEN w.depth + 1 WHEN '}' THEN w.depth - 1 ELSE w.depth END,
  CASE WHEN s.c = '' AND s.type = 'branch' AND NOT s.links THEN list_append(w.st, {'id': w.id, 'lv': w.depth}) WHEN s.c = '}' AND len(w.st) > 0 AND w.st[-1].lv = w.depth - 1 THEN w.st[1 : len(w.st) - 1] ELSE w.st END,
  s.c = '', len(w.st)::INT,
  CASE WHEN s.c <> '' THEN [] WHEN s.links AND s.type = 'branch' THEN CASE WHEN len(w.st) > 0 THEN [{'src': w.st[-1].id, 'edge_type': CASE WHEN s.branch IN ('catch', 'finally') THEN 'exception' ELSE 'branch_false' END}] ELSE [] END
    ELSE list_concat(CASE WHEN w.before IS NOT NULL THEN [{'src': w.before, 'edge_type': 'next'}] ELSE [] END, CASE WHEN w.later IS NOT NULL THEN [{'src': w.later, 'edge_type': 'branch_false'}] ELSE [] END) END
FROM walk w JOIN steps s ON s.fid = w.fid AND s.i = w.i + 1),
nodes AS (SELECT w.fid, w.id - 1 AS node_id, w.number, w.open, w.e, f.n, f.type, f.branch, f.lvl, f.prt, f.line, f.receiver, f.method, list_filter(f.f, lambda x: x <> '') AS f FROM walk w JOIN frags f ON f.fid = w.fid AND f.number = w.number WHERE w.made)"""
FLOWS = f"WITH RECURSIVE {_lines(BRACES)}, {JAVA_STATEMENTS}, {JAVA_NODES}"


def java_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.nodes(_sources(spark, sf_dir, BRACES), language="java")


@query(f"WITH RECURSIVE {_lines(BRACES)}, {JAVA_STATEMENTS} SELECT fid, n::INT AS n, number, line FROM statements")
def q_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.statements(_sources(spark, sf_dir, BRACES))


@query(FLOWS + """ SELECT fid, node_id, (n + 1)::INT AS line, (number + 1)::INT AS statement, type, CASE WHEN type = 'log' THEN lower(CASE WHEN lvl <> '' THEN lvl ELSE prt END) END AS log_level, CASE WHEN type = 'log' THEN trim(array_to_string(f, '')) END AS log_text, CASE WHEN type = 'log' THEN array_to_string(f, '|') END AS frags,
CASE WHEN type = 'call' THEN receiver || '.' || method END AS call_target, CASE WHEN type = 'branch' THEN branch END AS branch_type,
CASE WHEN type = 'branch' THEN CASE WHEN branch IN ('if', 'catch') THEN substr(line[strpos(line, '(') + 1 : length(line) - strpos(reverse(line), ')')], 1, 80) ELSE '' END END AS condition, open AS branch_depth FROM nodes""")
def q_flow_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return java_nodes(spark, sf_dir).drop("incoming").withColumn("frags", F.array_join("frags", "|"))


@query(FLOWS + " SELECT fid, node_id AS dst, unnest(e).src AS src, unnest(e).edge_type AS edge_type FROM nodes")
def q_flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.edges(java_nodes(spark, sf_dir))


@query(f"""WITH RECURSIVE {_lines(INDENTED)}, {STATEMENTS.replace("TRAILING", "chr(92), ','")},
told AS (SELECT *, ltrim(line) AS s, (length(line) - length(ltrim(line)))::INT AS w FROM statements),
kinds AS (SELECT *, trim(s) = '' OR s[1] = '#' AS silent, CASE WHEN regexp_matches(s, '^(if|elif)\\s') THEN 'if' WHEN s = 'else:' THEN 'else' WHEN s = 'try:' THEN 'try' WHEN s LIKE 'except%' THEN 'catch' WHEN s = 'finally:' THEN 'finally' WHEN s LIKE 'for %' THEN 'for' END AS branch FROM told),
nodes0 AS (SELECT *, CASE WHEN silent THEN NULL WHEN s LIKE 'raise%' THEN 'throw' WHEN branch IS NOT NULL THEN 'branch' WHEN s LIKE 'logger%' THEN 'log' WHEN s LIKE 'store%' THEN 'call' END AS type, coalesce(branch IN ('else', 'catch', 'finally'), FALSE) AS links FROM kinds),
steps AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY number) AS i FROM nodes0 WHERE type IS NOT NULL),
walk AS (SELECT fid, 0::BIGINT AS i, 0 AS id, NULL::INT AS before, NULL::INT AS later, []::STRUCT(id INT, lv INT)[] AS st, 0 AS open, []::STRUCT(src INT, edge_type VARCHAR)[] AS e FROM (SELECT DISTINCT fid FROM steps) UNION ALL
SELECT fid, i, id + 1, CASE WHEN type = 'throw' THEN CASE WHEN FALSE THEN 0 END ELSE id END,
  CASE WHEN links THEN coalesce(list_filter(st1, lambda x: x.lv >= w)[1].id, later1) END,
  CASE WHEN links THEN list_filter(st1, lambda x: x.lv < w) WHEN type = 'branch' THEN list_append(st1, {{'id': id, 'lv': w}}) ELSE st1 END, len(st1)::INT,
  CASE WHEN links THEN CASE WHEN len(st1) > 0 THEN [{{'src': st1[-1].id, 'edge_type': CASE WHEN branch IN ('catch', 'finally') THEN 'exception' ELSE 'branch_false' END}}] ELSE [] END
    ELSE list_concat(CASE WHEN before1 IS NOT NULL THEN [{{'src': before1, 'edge_type': 'next'}}] ELSE [] END, CASE WHEN later1 IS NOT NULL THEN [{{'src': later1, 'edge_type': 'branch_false'}}] ELSE [] END) END
FROM (SELECT *, CASE WHEN len(gone) > 0 THEN coalesce(before, gone[-1].id) ELSE before END AS before1, CASE WHEN before IS NOT NULL AND len(gone) > 0 OR len(gone) > 1 THEN gone[1].id ELSE later END AS later1
  FROM (SELECT s.fid, s.i, s.w, s.type, s.branch, s.links, w.id, w.before, w.later, list_filter(w.st, lambda x: x.lv >= s.w + s.links::INT) AS gone, list_filter(w.st, lambda x: x.lv < s.w + s.links::INT) AS st1 FROM walk w JOIN steps s ON s.fid = w.fid AND s.i = w.i + 1)))
SELECT s.fid, w.id - 1 AS node_id, (s.n + 1)::INT AS line, s.type, w.open AS branch_depth, array_to_string([x.src || ' ' || x.edge_type FOR x IN w.e], ',') AS incoming FROM walk w JOIN steps s ON s.fid = w.fid AND s.i = w.i""")
def q_flow_indented(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = flows.nodes(_sources(spark, sf_dir, INDENTED), language="python")
    return found.select("fid", "node_id", "line", "type", "branch_depth", F.array_join(F.transform("incoming", lambda e: F.concat_ws(" ", e["src"].cast("string"), e["edge_type"])), ",").alias("incoming"))


BARE = "regexp_replace(regexp_replace(l, '\"[^\"]*\"', '', 'g'), '''[^'']*''', '', 'g')"


@query(f"""WITH {_lines(BRACES)}, b AS (SELECT fid, n, regexp_replace({BARE}, '[^{{}}]', '', 'g') AS b FROM src), c AS (SELECT fid, n, unnest(range(1, length(b) + 1)) AS k, unnest(string_split(b, '')) AS c FROM b WHERE b <> ''),
d AS (SELECT *, sum(CASE WHEN c = '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY fid ORDER BY n, k) AS depth, max(CASE WHEN c = '{{' THEN 1 ELSE 0 END) OVER (PARTITION BY fid ORDER BY n, k) AS opened FROM c)
SELECT fid, coalesce((SELECT min(n) + 1 FROM d WHERE d.fid = f.fid AND c = '}}' AND depth = 0 AND opened = 1), 1)::INT AS last_line FROM (SELECT DISTINCT fid FROM src) f""")
def q_function_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark, sf_dir, BRACES).select("fid", flows.function_end(F.col("source")).alias("last_line"))


@query(f"""WITH {_lines(INDENTED)}, w AS (SELECT *, length(l) - length(ltrim(l)) AS w, trim(l) = '' AS blank FROM src), body AS (SELECT fid, min(n) FILTER (WHERE NOT blank) AS b, arg_min(w, n) FILTER (WHERE NOT blank) AS bw, count(*) AS size FROM w GROUP BY fid)
SELECT fid, CASE WHEN b IS NULL OR bw = 0 THEN 1 ELSE coalesce((SELECT min(n) + 1 FROM w WHERE w.fid = body.fid AND n > b AND NOT blank AND w.w < bw), size + 1) END::INT AS last_line FROM body""")
def q_function_dedent(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.concat(F.lit("def f():\n"), "source")
    return _sources(spark, sf_dir, INDENTED).select("fid", flows.function_end(whole, "python").alias("last_line"))


@query(f"""WITH RECURSIVE {_lines(BRACES)}, d AS (SELECT fid, n, l, length(regexp_replace({BARE}, '[^{{]', '', 'g')) - length(regexp_replace({BARE}, '[^}}]', '', 'g')) AS d FROM src),
t AS (SELECT *, sum(d) OVER (PARTITION BY fid ORDER BY n) AS depth FROM d),
spans AS (SELECT a.fid, a.n, regexp_extract(a.l, '^\\s*def\\s+(\\w+)\\s*=\\s*\\{{', 1) AS name, min(b.n) AS e FROM t a JOIN t b ON a.fid = b.fid AND b.n > a.n AND b.depth = a.depth - a.d WHERE regexp_matches(a.l, '^\\s*def\\s+(\\w+)\\s*=\\s*\\{{') GROUP BY ALL),
taken AS (SELECT fid, min(n) AS n, arg_min(e, n) AS e FROM spans GROUP BY fid UNION ALL SELECT s.fid, min(s.n), arg_min(s.e, s.n) FROM taken t JOIN spans s ON s.fid = t.fid AND s.n > t.e GROUP BY s.fid)
SELECT fid AS path, name, (n + 1)::INT AS start_line, (SELECT string_agg(l, chr(10) ORDER BY src.n) FROM src WHERE src.fid = taken.fid AND src.n BETWEEN taken.n AND taken.e) AS source FROM taken JOIN spans USING (fid, n)""")
def q_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.closures(_sources(spark, sf_dir, BRACES).select(F.col("fid").alias("path"), F.col("source").alias("text")))


LOGS = r"""SELECT fid, n, lower(CASE WHEN lvl <> '' THEN lvl ELSE prt END) AS level, rest FROM (SELECT *, regexp_extract(l, '(?i)\b(?:log|logger)\s*\.\s*(trace|debug|info|warn|error|fatal)\s*\(', 1) AS lvl, regexp_extract(l, '(?i)\b(println|print)\s*\(', 1) AS prt,
regexp_extract(l, '(?i)(?:\b(?:log|logger)\s*\.\s*(?:trace|debug|info|warn|error|fatal)|\b(?:println|print))\s*\((.*)', 1) AS rest FROM src) WHERE lvl <> '' OR prt <> ''"""
FRAGS = r"list_filter(CASE WHEN contains(q, '{}') THEN string_split(q, '{}') WHEN regexp_matches(q, '%[sd]') THEN regexp_split_to_array(q, '%[-+0-9*.]*[sdflxvqweEgGoO]') WHEN contains(q, '+') AND contains(q, '\"') THEN [trim(trim(x), '\"') FOR x IN regexp_split_to_array(q, '\"\s*\+\s*|\s*\+\s*\"')] ELSE [q] END, lambda x: x <> '')".replace('\\"', '"')
SPLIT = "CASE WHEN l_partkey % 16 = 6 AND l_quantity > 25 THEN 'log.info(' WHEN l_partkey % 16 = 9 THEN '\"number {} of\" + n)' ELSE " + BRACES + " END"


@query(f"WITH {_lines(SPLIT)}, logs AS ({LOGS}), told AS (SELECT *, regexp_extract(rest, '\"(.*)\"', 1) AS q FROM logs), f AS (SELECT *, {FRAGS} AS f FROM told) SELECT fid, (n + 1)::INT AS line, level, array_to_string(f, '') AS text, array_to_string(f, '|') AS frags FROM f WHERE length(array_to_string(f, '')) >= 3")
def q_template_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.scanned(_sources(spark, sf_dir, SPLIT)).withColumn("frags", F.array_join("frags", "|"))


@query(f"""WITH {_lines(SPLIT)}, more AS (SELECT fid, n, [lead(l, 1) OVER w, lead(l, 2) OVER w, lead(l, 3) OVER w] AS m FROM src WINDOW w AS (PARTITION BY fid ORDER BY n)), logs AS ({LOGS}),
ends AS (SELECT *, CASE WHEN regexp_matches(rest, '\\)(;)?\\s*$') THEN 0 WHEN m[1] IS NULL THEN 0 WHEN regexp_matches(m[1], '\\);|\\)\\s*$') OR m[2] IS NULL THEN 1 WHEN regexp_matches(m[2], '\\);|\\)\\s*$') OR m[3] IS NULL THEN 2 ELSE 3 END AS k FROM logs JOIN more USING (fid, n)),
told AS (SELECT *, regexp_extract(rest || array_to_string([' ' || trim(x) FOR x IN m[1:k]], ''), '"(.*)"', 1) AS q FROM ends), f AS (SELECT *, {FRAGS} AS f FROM told)
SELECT fid, (n + 1)::INT AS line, level, array_to_string(f, '') AS text, array_to_string(f, '|') AS frags FROM f WHERE len(f) > 0""")
def q_template_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extracted(_sources(spark, sf_dir, SPLIT)).withColumn("frags", F.array_join("frags", "|"))


@query("""WITH m AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'at $' || '{user} of $name.x ' || event_type WHEN 1 THEN 'of $user and ' || event_type WHEN 2 THEN 'took {} for {}' || props WHEN 3 THEN '%5.2f of ' || event_type || ' %s' WHEN 4 THEN 'has {id} of ' || props ELSE event_type || '" + n + " days' END AS t FROM events),
p AS (SELECT *, contains(t, '{}') AS slf, regexp_matches(t, '%[sdflxvqweEgG]') AS printf FROM m),
q AS (SELECT *, CASE WHEN slf THEN string_split(t, '{}') WHEN printf THEN regexp_split_to_array(t, '%[-+0-9*.]*[sdflxvqweEgGoO]') WHEN contains(t, '+') AND contains(t, '"') THEN [trim(trim(x), '"') FOR x IN regexp_split_to_array(t, '"\\s*\\+\\s*|\\s*\\+\\s*"')] ELSE [t] END AS plain FROM p)
SELECT event_id, array_to_string(list_filter(plain, lambda x: x <> ''), '|') AS java,
array_to_string(list_filter(CASE WHEN slf OR printf OR NOT regexp_matches(t, '\\{[^}]*\\}') THEN plain ELSE regexp_split_to_array(t, '\\{[^}]*\\}') END, lambda x: x <> ''), '|') AS javascript,
array_to_string(CASE WHEN contains(t, '${') THEN list_filter(regexp_split_to_array(t, '\\$\\{[^}]*\\}'), lambda x: trim(x) <> '') WHEN contains(t, '$') THEN list_filter(regexp_split_to_array(t, '\\$[\\w.]+'), lambda x: trim(x) <> '') ELSE list_filter(plain, lambda x: x <> '') END, '|') AS groovy FROM q""")
def q_language_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = """CASE event_id % 6 WHEN 0 THEN 'at $' || '{user} of $name.x ' || event_type WHEN 1 THEN 'of $user and ' || event_type WHEN 2 THEN 'took {} for {}' || props WHEN 3 THEN '%5.2f of ' || event_type || ' %s' WHEN 4 THEN 'has {id} of ' || props ELSE event_type || '" + n + " days' END"""
    e = table(spark, sf_dir, "events").select("event_id", F.expr(said).alias("t"))
    return e.select("event_id", *[F.array_join(languages.fragments(F.col("t"), name), "|").alias(name) for name in ("java", "javascript", "groovy")])


ENDS = f"""b AS (SELECT fid, n, regexp_replace({BARE}, '[^{{}}]', '', 'g') AS b FROM src0), c AS (SELECT fid, n, unnest(range(1, length(b) + 1)) AS k, unnest(string_split(b, '')) AS c FROM b WHERE b <> ''),
d AS (SELECT *, sum(CASE WHEN c = '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY fid ORDER BY n, k) AS depth, max(CASE WHEN c = '{{' THEN 1 ELSE 0 END) OVER (PARTITION BY fid ORDER BY n, k) AS opened FROM c),
ends AS (SELECT fid, min(n) + 1 AS e FROM d WHERE c = '}}' AND depth = 0 AND opened = 1 GROUP BY fid), src AS (SELECT s.* FROM src0 s LEFT JOIN ends USING (fid) WHERE coalesce(e, 1) <= 1 OR n <= e)"""
INDEX = f"""WITH RECURSIVE {_lines(BRACES).replace("src AS", "src0 AS", 1)}, {ENDS}, {JAVA_STATEMENTS}, {JAVA_NODES},
functions AS (SELECT DISTINCT fid, 'load' || (fid % 9) AS name, CASE WHEN fid < 9 THEN 'Store' ELSE 'Other' || fid END AS class_name FROM src0),
named AS (SELECT a.fid, b.name AS callee, max(b.fid) AS callee_id FROM functions a JOIN functions b ON b.fid IN (a.fid + 1, a.fid + 10) GROUP BY a.fid, b.name),
said AS (SELECT fid, method AS callee, min(node_id) AS node_id FROM nodes WHERE type = 'call' GROUP BY fid, method),
more AS (SELECT n.fid, callee, callee_id, coalesce((SELECT max(node_id) FROM nodes x WHERE x.fid = n.fid), -1) + row_number() OVER (PARTITION BY n.fid ORDER BY callee) AS node_id FROM named n ANTI JOIN said USING (fid, callee)),
whole AS (SELECT fid, node_id, type, CASE WHEN type = 'call' THEN method END AS short, CASE WHEN type = 'call' THEN receiver || '.' || method END AS target, callee_id FROM nodes LEFT JOIN (SELECT s.fid, s.node_id, callee_id FROM said s JOIN named USING (fid, callee)) USING (fid, node_id)
  UNION ALL SELECT fid, node_id, 'call', callee, callee, callee_id FROM more),
looked AS (SELECT w.*, coalesce(callee_id, (SELECT min(fid) FROM functions f WHERE f.name = w.short HAVING count(*) = 1), (SELECT min(fid) FROM functions f WHERE lower(class_name[1]) || class_name[2:] || '.' || name = w.target HAVING count(*) = 1)) AS target_id,
  type = 'call' AND (length(short) <= 3 OR short NOT IN (SELECT name FROM functions)) AS gone FROM whole w),
links AS (SELECT fid, unnest(e).src AS src, node_id AS dst, unnest(e).edge_type AS edge_type FROM nodes UNION ALL SELECT fid, node_id - 1, node_id, 'next' FROM more WHERE node_id > 0),
reach AS (SELECT fid, src, dst FROM links UNION SELECT r.fid, r.src, l.dst FROM reach r JOIN looked x ON x.fid = r.fid AND x.node_id = r.dst AND x.gone JOIN links l ON l.fid = r.fid AND l.src = r.dst),
kept AS (SELECT fid, node_id, type, target_id FROM looked WHERE NOT gone),
direct AS (SELECT DISTINCT l.* FROM links l SEMI JOIN kept a ON a.fid = l.fid AND a.node_id = l.src SEMI JOIN kept b ON b.fid = l.fid AND b.node_id = l.dst),
edges AS (SELECT * FROM direct UNION ALL SELECT r.fid, r.src, r.dst, 'next' FROM reach r SEMI JOIN kept a ON a.fid = r.fid AND a.node_id = r.src SEMI JOIN kept b ON b.fid = r.fid AND b.node_id = r.dst ANTI JOIN direct d ON d.fid = r.fid AND d.src = r.src AND d.dst = r.dst)"""


@query(INDEX + """ SELECT fid, count(*) AS n, string_agg(node_id || ' ' || type || coalesce(' ' || target_id, ''), ',' ORDER BY node_id) AS nodes, coalesce((SELECT string_agg(src || ' ' || dst || ' ' || edge_type, ',' ORDER BY src, dst, edge_type) FROM edges WHERE edges.fid = kept.fid), '') AS edges, min(node_id)::INT AS entry,
coalesce(string_agg(node_id, ',' ORDER BY node_id) FILTER (WHERE type IN ('return', 'throw')), max(node_id)::VARCHAR) AS exits FROM kept GROUP BY fid HAVING count(*) >= 2""")
def q_flow_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    fid = F.col("fid")
    functions = _sources(spark, sf_dir, BRACES).withColumns({"name": F.concat(F.lit("load"), (fid % 9).cast("string")), "class_name": F.when(fid < 9, "Store").otherwise(F.concat(F.lit("Other"), fid.cast("string")))})
    calls = functions.select(fid.alias("src"), F.explode(F.array(fid + 1, fid + 10)).alias("dst")).join(functions.select(fid.alias("dst")), "dst", "left_semi")
    found, _ = flows.flow_index(functions, calls)
    told = lambda *c: F.concat_ws(" ", *[x.cast("string") for x in c])
    return found.select(
        "fid", F.size("nodes").cast("long").alias("n"), F.array_join(F.transform("nodes", lambda x: told(x["id"], x["type"], x["call_target_id"])), ",").alias("nodes"),
        F.array_join(F.transform("edges", lambda e: told(e["src"], e["dst"], e["edge_type"])), ",").alias("edges"), "entry", F.array_join(F.transform("exits", lambda x: x.cast("string")), ",").alias("exits"),
    )


METHODS = """CASE l_partkey % 9 WHEN 0 THEN '  public void load' || l_linenumber || '(x) {' WHEN 1 THEN '}' WHEN 2 THEN 'static final List<String> find' || l_partkey % 4 || ' (a) { return b }' WHEN 3 THEN 'x = 5 // }' WHEN 4 THEN 'def run() {} {' WHEN 5 THEN 'abstract int size();' WHEN 6 THEN ' }}' WHEN 7 THEN 'new Load(x) {' ELSE 'some words of text' END"""


@query(rf"""WITH {_lines(METHODS)}, whole AS (SELECT fid, string_agg(l, chr(10) ORDER BY n) AS t FROM src GROUP BY fid), p AS (SELECT *, (sum(length(l) + 1) OVER (PARTITION BY fid ORDER BY n) - length(l))::BIGINT AS a FROM src),
defs AS (SELECT fid, n, a, regexp_extract(l, '(?:void|List<String>|def|int)\s+([a-z]\w*)\s*\(', 1) AS name FROM p WHERE regexp_matches(l, '^[ \t]*(?:(?:public|static|final|abstract)\s+)*(?:void|List<String>|def|int)\s+[a-z]\w*\s*\(')),
c AS (SELECT fid, unnest(range(1, length(t) + 1)) AS ps, unnest(string_split(t, '')) AS c FROM whole), b AS (SELECT fid, ps, c, sum(CASE c WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY fid ORDER BY ps) AS depth FROM c WHERE c IN ('{{', '}}')),
o AS (SELECT d.fid, d.n, d.a, d.name, (SELECT min(ps) FROM b WHERE b.fid = d.fid AND c = '{{' AND ps >= d.a) AS o FROM defs d), e AS (SELECT o.*, (SELECT min(x.ps) FROM b x WHERE x.fid = o.fid AND x.ps > o.o AND x.c = '}}' AND x.depth = (SELECT depth - 1 FROM b y WHERE y.fid = o.fid AND y.ps = o.o)) AS e FROM o),
m AS (SELECT fid, n, name, CASE WHEN o IS NULL THEN '' WHEN e IS NULL THEN substr(t, a, 5000) ELSE substr(t, a, e - a + 1) END AS source FROM e JOIN whole USING (fid))
SELECT fid AS path, name, min(n + 1)::INT AS start_line, arg_min(source, n) AS source FROM m WHERE length(source) >= 20 AND NOT (name = 'load3' AND fid % 2 = 0) GROUP BY fid, name""")
def q_missing_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _sources(spark, sf_dir, METHODS).select(F.col("fid").alias("path"), F.col("source").alias("text"))
    known = files.filter("path % 2 = 0").select("path", F.lit("load3").alias("name"))
    return trees.missing_methods(files, known)


@query("SELECT lang AS folder, count(*) AS lines, sum(length(l))::BIGINT AS chars FROM (SELECT lang, unnest(string_split(text, chr(10))) AS l FROM documents WHERE text IS NOT NULL) WHERE lang <> 'de' GROUP BY lang")
def q_source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files in folders by language, read back as a source tree without one of the folders."""
    import uuid

    from .evidence_queries import _shared

    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    top = f"{_shared(spark, 'tree')}/{uuid.uuid4().hex}"
    docs.select(F.explode(F.split("text", "\n")).alias("value"), F.col("lang").alias("folder")).write.partitionBy("folder").text(top)
    files = trees.read_tree(spark, top, ["txt"], ["folder=de"])
    lines = files.select(F.regexp_extract("path", "/folder=([^/]*)/", 1).alias("folder"), F.explode(F.split(F.regexp_replace("text", "\n\\z", ""), "\n")).alias("l"))
    return lines.groupBy("folder").agg(F.count("*").alias("lines"), F.sum(F.length("l")).alias("chars"))
