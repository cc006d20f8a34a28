"""Graph, selection and retrieval queries: parts are functions, consecutive parts of an order call each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as fn
from ..operators import graph, lookups, retrieval, selection
from ..sources.tables import changed
from .registry import query, table

CALLS = "calls AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL)"
FUNCTIONS = "functions AS (SELECT p_partkey AS fid, p_name AS name, p_brand AS class_name, p_type AS source, p_size FROM part)"
DEGREES = "degrees AS (SELECT fid, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS fid, 0 AS i, 1 AS o FROM calls UNION ALL SELECT dst, 1, 0 FROM calls) GROUP BY fid)"


def calls_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return pairs.filter("dst IS NOT NULL").distinct()


def functions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fid"), F.col("p_name").alias("name"), F.col("p_brand").alias("class_name"), F.col("p_type").alias("source"), "p_size")


@query(f"""WITH {CALLS}, {FUNCTIONS}, {DEGREES}
SELECT fid, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree, CASE WHEN coalesce(in_degree, 0) = 0 THEN 'entry' WHEN coalesce(out_degree, 0) = 0 THEN 'leaf' WHEN in_degree >= 10 THEN 'utility' WHEN in_degree <= 3 AND p_size > 25 THEN 'anchor' ELSE 'internal' END AS node_class
FROM functions LEFT JOIN degrees USING (fid)""")
def q_degree_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.classified(functions_of(spark, sf_dir), calls_of(spark, sf_dir), F.col("p_size") > 25).select("fid", "in_degree", "out_degree", "node_class")


@query(f"""WITH {CALLS}, {FUNCTIONS}
SELECT fid, (SELECT string_agg(src, ',' ORDER BY src) FROM calls WHERE dst = fid) AS callers, (SELECT string_agg(dst, ',' ORDER BY dst) FROM calls WHERE src = fid) AS callees FROM functions""")
def q_func_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = graph.func_map(functions_of(spark, sf_dir), calls_of(spark, sf_dir))
    joined = lambda c: F.when(F.col(c).isNotNull(), F.array_join(F.col(c).cast("array<string>"), ",")).alias(c)
    return m.select("fid", joined("callers"), joined("callees"))


def _neighbours(direction: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = functions_of(spark, sf_dir)
        return graph.neighbours(calls_of(spark, sf_dir), f, f.filter("class_name = 'Brand#11'"), direction)

    run.__name__ = f"q_{direction}"
    return run


for _direction, _here, _there in (("callers", "dst", "src"), ("callees", "src", "dst")):
    query(f"WITH {CALLS}, {FUNCTIONS} SELECT a.fid, b.fid AS other, b.name, b.class_name FROM functions a JOIN calls ON calls.{_here} = a.fid JOIN functions b ON b.fid = calls.{_there} WHERE a.class_name = 'Brand#11'")(_neighbours(_direction))


@query(f"""WITH {CALLS}, {FUNCTIONS}
SELECT class_name, (SELECT count(*) FROM functions f WHERE f.class_name = c.class_name) AS methods, (SELECT count(DISTINCT b.class_name) FROM functions a JOIN calls ON src = a.fid JOIN functions b ON b.fid = dst WHERE a.class_name = c.class_name AND b.class_name <> c.class_name) AS uses
FROM (SELECT DISTINCT class_name FROM functions) c""")
def q_class_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.class_info(functions_of(spark, sf_dir), calls_of(spark, sf_dir))


@query(f"""WITH {FUNCTIONS}, hits AS (SELECT fid, min(prio) AS prio FROM (SELECT fid, 0 AS prio FROM functions WHERE contains(name, 'gear') UNION ALL SELECT fid, 1 FROM functions WHERE contains(source, 'O')) GROUP BY fid)
SELECT fid, prio FROM hits ORDER BY prio, fid LIMIT 200""")
def q_find_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.mentions(functions_of(spark, sf_dir), "O", 200, "gear").select("fid", "prio")


@query("""SELECT DISTINCT p_brand AS class_name, o.fid FROM part JOIN (SELECT p_partkey AS fid, p_type AS path FROM part) o ON p_type = o.path
WHERE (p_brand, o.fid) NOT IN (SELECT p_brand, p_partkey FROM part)""")
def q_missing_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    classes = p.select(F.col("p_brand").alias("class_name"), F.col("p_type").alias("path")).distinct()
    return graph.missing_members(classes, p.select(F.col("p_partkey").alias("fid"), F.col("p_type").alias("path")), p.select(F.col("p_brand").alias("class_name"), F.col("p_partkey").alias("fid")))


@query("""WITH f AS (SELECT doc_id AS fid, regexp_extract(text, '[a-z]{9,}', 0) AS name, text FROM documents),
used AS (SELECT DISTINCT fid AS src, unnest(regexp_extract_all(text, '([a-z]{6,})', 1)) AS name FROM f),
ranked AS (SELECT src, f.fid AS dst, row_number() OVER (PARTITION BY f.fid ORDER BY src) AS r FROM used JOIN f USING (name) WHERE src <> f.fid AND length(name) >= 6 AND NOT regexp_matches(name, '^(get|set)'))
SELECT src, dst FROM ranked WHERE r <= 10""")
def q_token_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fid"), F.regexp_extract("text", "[a-z]{9,}", 0).alias("name"), F.col("text").alias("source"))
    none = spark.createDataFrame([], "src bigint, dst bigint")
    return graph.token_calls(f, none, token="([a-z]{6,})").select("src", "dst")


@query(f"""WITH RECURSIVE {CALLS}, walk AS (SELECT p_partkey AS id, 0 AS hops FROM part WHERE p_size = 50 UNION SELECT dst, hops + 1 FROM walk JOIN calls ON src = id WHERE hops < 6)
SELECT id, min(hops) AS hops FROM walk GROUP BY id""")
def q_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "part").filter("p_size = 50").select(F.col("p_partkey").alias("id"))
    return graph.shortest_paths(seeds, calls_of(spark, sf_dir)).select("id", "hops")


@query(f"""WITH RECURSIVE {CALLS}, walk AS (SELECT min(p_partkey) AS id, 0 AS depth FROM part UNION SELECT dst, depth + 1 FROM walk JOIN calls ON src = id WHERE depth < 3)
SELECT depth, count(*) AS n FROM (SELECT id, min(depth) AS depth FROM walk GROUP BY id) GROUP BY depth""")
def q_khop_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = table(spark, sf_dir, "part").agg(F.min("p_partkey").alias("id"))
    return graph.reach(seed, calls_of(spark, sf_dir), 3).groupBy("depth").agg(F.count("*").alias("n"))


def _levels(most: int) -> str:
    """Levels of a first-visit search along reversed calls, each origin from the smallest predecessor."""
    out = ["l0 AS (SELECT p_partkey AS id, 0 AS depth, p_partkey AS origin FROM part WHERE p_size = 50 AND p_brand = 'Brand#12')"]
    for k in range(1, most + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM l{i}" for i in range(k))
        out.append(f"l{k} AS MATERIALIZED (SELECT src AS id, {k} AS depth, min_by(origin, id) AS origin FROM l{k - 1} JOIN calls ON dst = id WHERE src NOT IN ({seen}) GROUP BY src)")
    return ", ".join(out) + ", found AS (" + " UNION ALL ".join(f"SELECT id AS fid, depth, origin FROM l{k}" for k in range(1, most + 1)) + ")"


def callers_found(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    contacts = table(spark, sf_dir, "part").filter("p_size = 50 AND p_brand = 'Brand#12'").select(F.col("p_partkey").alias("fid"))
    return selection.by_callers(contacts, calls_of(spark, sf_dir), most)


@query(f"WITH {CALLS}, {_levels(4)} SELECT * FROM found")
def q_bfs_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callers_found(spark, sf_dir, 4)


@query(f"""WITH {CALLS}, {_levels(2)}, importers AS (SELECT p_partkey AS fid, (SELECT min(p_partkey) FROM part) AS origin FROM part WHERE p_brand = 'Brand#13'),
both_ AS (SELECT fid, origin, 1 AS c FROM found UNION ALL SELECT fid, origin, 0 FROM importers),
s AS (SELECT count(*) FILTER (WHERE c = 1) AS nc, count(*) FILTER (WHERE c = 0) AS ni, count(DISTINCT fid) AS n FROM both_)
SELECT fid, string_agg(DISTINCT origin, ',' ORDER BY origin) AS origins, any_value(CASE WHEN nc = 0 AND ni = 0 THEN 'manual' WHEN nc >= ni THEN 'callers' ELSE 'imports' END) AS strategy, any_value(n > 100) AS truncated
FROM both_, s GROUP BY fid ORDER BY fid LIMIT 100""")
def q_select_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    importers = part.filter("p_brand = 'Brand#13'").select(F.col("p_partkey").alias("fid")).crossJoin(F.broadcast(part.agg(F.min("p_partkey").alias("origin"))))
    out = selection.union(callers_found(spark, sf_dir, 2), importers, 100)
    return out.withColumn("origins", F.array_join(F.col("origins").cast("array<string>"), ","))


MODULES = "m AS (SELECT page_id, replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '-', '_') AS host, regexp_extract(url, '^https?://[^/?#]+/([a-z]+)', 1) AS lang FROM pages), modules AS (SELECT page_id, host || '.' || lang AS module, host, lead(host) OVER (ORDER BY page_id) AS imported FROM m)"


def modules_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, module, imported: a page imports the host of the next page; ids that follow each other are joined."""
    p = table(spark, sf_dir, "pages").select("page_id", F.replace(F.regexp_extract("url", "^https?://([^/?#]+)", 1), F.lit("-"), F.lit("_")).alias("host"), F.regexp_extract("url", "^https?://[^/?#]+/([a-z]+)", 1).alias("lang"))
    following = p.select((F.col("page_id") - 1).alias("page_id"), F.col("host").alias("imported"))
    return p.join(following, "page_id", "left").select("page_id", F.concat_ws(".", "host", "lang").alias("module"), "imported")


@query(f"WITH {MODULES}, i AS (SELECT DISTINCT imported FROM modules), t AS (SELECT DISTINCT module FROM modules) SELECT imported, count(*) AS n FROM i JOIN t ON module = imported OR starts_with(module, imported || '.') GROUP BY imported")
def q_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = modules_of(spark, sf_dir)
    imports = m.filter("imported IS NOT NULL").select("imported").distinct()
    return selection.prefix_matched(imports, m.select(F.col("module").alias("target")).distinct()).groupBy("imported").agg(F.count("*").alias("n"))


def _import_levels(most: int) -> str:
    out = ["l0 AS (SELECT module, 0 AS depth FROM (SELECT module FROM modules WHERE page_id = (SELECT min(page_id) FROM modules)))"]
    for k in range(1, most + 1):
        seen = " UNION ALL ".join(f"SELECT module FROM l{i}" for i in range(k))
        out.append(f"l{k} AS MATERIALIZED (SELECT DISTINCT a.module, {k} AS depth FROM modules a JOIN l{k - 1} b ON b.module = a.imported OR starts_with(b.module, a.imported || '.') WHERE a.module NOT IN ({seen}))")
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT module, depth FROM l{k}" for k in range(1, most + 1))


@query(f"WITH {MODULES}, {_import_levels(3)}")
def q_import_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = modules_of(spark, sf_dir)
    start = m.join(F.broadcast(m.agg(F.min("page_id").alias("page_id"))), "page_id").select("module")
    imports = m.filter("imported IS NOT NULL").select(F.col("page_id").cast("string").alias("file_path"), "module", "imported")
    return selection.by_imports(start, imports, 3).select("module", "depth")


@query("""WITH e AS (SELECT DISTINCT -1 - l_suppkey AS src, l_partkey AS dst FROM lineitem) SELECT src AS entry, 1 + count(*) AS members FROM e GROUP BY src HAVING count(*) >= 4""")
def q_closure_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select((-1 - F.col("l_suppkey")).alias("src"), F.col("l_partkey").alias("dst"))
    functions = edges.select(F.col("src").alias("fid")).distinct()
    return graph.domains(functions, edges)


SCORES = "q AS (SELECT min(vec_id) AS query_id FROM embeddings GROUP BY label), qs AS (SELECT query_id, embedding AS qvec FROM q JOIN embeddings ON vec_id = query_id), scored AS (SELECT query_id, vec_id, list_dot_product(qvec::DOUBLE[], embedding::DOUBLE[]) AS score FROM embeddings, qs), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)"


def ranked_vectors(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The k nearest vectors for the first vector of each label (a stated few queries)."""
    e = table(spark, sf_dir, "embeddings")
    queries = e.groupBy("label").agg(F.min("vec_id").alias("query_id")).join(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")), "query_id").select("query_id", "qvec")
    return retrieval.top_k(e, queries, k, unique=True)


@query(f"WITH {SCORES} SELECT query_id, vec_id, round(score, 6)::DOUBLE AS score, rank::BIGINT AS rank FROM ranked WHERE rank <= 20")
def q_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_vectors(spark, sf_dir, 20).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {SCORES}, hits AS (SELECT vec_id, rank, query_id FROM ranked WHERE rank <= 50)
SELECT vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 9)::DOUBLE AS rrf, count(*) AS lanes FROM hits GROUP BY vec_id""")
def q_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    lanes = ranked_vectors(spark, sf_dir, 50).select(F.col("query_id").alias("lane"), F.col("vec_id").alias("fid"), "score", "rank")
    return retrieval.fused(lanes, 1_000_000).select(F.col("fid").alias("vec_id"), F.round("rrf", 9).alias("rrf"), "lanes")


TIERED = "candidates AS (SELECT vec_id AS fid, max(score) AS score FROM ranked WHERE rank <= 100 GROUP BY vec_id HAVING max(score) >= 0.35)"


def candidate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_vectors(spark, sf_dir, 100).groupBy(F.col("vec_id").alias("fid")).agg(F.max("score").alias("score"))


@query(f"""WITH {SCORES}, {TIERED}, ran AS (SELECT user_id AS fid, count(*) AS log_count FROM events WHERE event_type <> 'error' GROUP BY 1),
first AS (SELECT fid, CASE WHEN log_count IS NULL THEN 2 ELSE 1 END AS tier, round(score, 6)::DOUBLE AS score, coalesce(log_count, 0) AS log_count FROM candidates LEFT JOIN ran USING (fid))
SELECT * FROM first UNION ALL SELECT DISTINCT user_id, 3, 0.0::DOUBLE, 0 FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT fid FROM candidates)""")
def q_tiering(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "fid")
    out = retrieval.tiered(candidate_vectors(spark, sf_dir), e.filter("event_type <> 'error'"), e.filter("event_type = 'error'"))
    return out.withColumn("score", F.round("score", 6))


@query(f"""WITH {SCORES}, {TIERED}, {CALLS}, {DEGREES}
SELECT c.fid, round(score + CASE WHEN label = 0 THEN 0.05 ELSE 0 END + CASE WHEN in_degree = 0 THEN 0.03 WHEN out_degree = 0 THEN -0.03 ELSE 0 END, 6)::DOUBLE AS score
FROM candidates c LEFT JOIN embeddings ON vec_id = c.fid LEFT JOIN degrees USING (fid)""")
def q_domain_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = candidate_vectors(spark, sf_dir).filter("score >= 0.35")
    members = table(spark, sf_dir, "embeddings").filter("label = 0").select(F.col("vec_id").alias("fid"))
    classes = graph.degrees(calls_of(spark, sf_dir)).withColumn("node_class", graph.node_class(F.col("in_degree"), F.col("out_degree"), F.lit(False)))
    return retrieval.boosted(hits, members, classes).select("fid", F.round("score", 6).alias("score"))


@query("""WITH w AS (SELECT doc_id, text, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents WHERE length(text) >= 20),
c AS (SELECT *, unnest(range(0, 1 + ceil(greatest(len(w) - 256, 0) / 156)::BIGINT)) AS chunk_no FROM w)
SELECT doc_id, chunk_no::INTEGER AS chunk_no, md5(CASE WHEN len(w) <= 256 THEN text ELSE array_to_string(w[chunk_no * 156 + 1 : chunk_no * 156 + 256], ' ') END) AS md5 FROM c""")
def q_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.chunks(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "chunk_no", F.md5("chunk").alias("md5"))


@query("""SELECT doc_id, substr(md5(text), 1, 12) AS md5 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def q_incremental_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = docs.join(table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"), "doc_id").select("doc_id", F.substring(F.md5("text"), 1, 12).alias("md5"))
    return changed(docs, known, "doc_id", "text").select("doc_id", "md5")


@query("""WITH t AS (SELECT doc_id, text, trim(regexp_extract(text, '(?s)^[^.]*\\.(.*)$', 1)) AS rest FROM documents)
SELECT doc_id, CASE WHEN length(text) >= 30 THEN md5(substr(CASE WHEN length(rest) > 20 THEN rest ELSE text END, 1, 500)) END AS md5 FROM t""")
def q_mechanism(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(retrieval.mechanism(F.col("text"))).alias("md5"))


@query("""SELECT p_partkey, lower(regexp_replace(p_brand || '_' || p_type, '[-_.]+', '-', 'g')) AS canonical FROM part
QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY p_partkey) = 1""")
def q_dependency_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.evidence import dependencies

    p = table(spark, sf_dir, "part").withColumn("package", F.concat_ws("_", "p_brand", "p_type"))
    return dependencies(p, "package", "p_partkey").select("p_partkey", "canonical")


@query("""SELECT page_id, replace(regexp_replace(regexp_replace(regexp_replace('src/' || regexp_extract(url, '^https?://[^/?#]+/([^?#]*)', 1) || '.py', '^src/', ''), '\\.py$', ''), '/__init__$', ''), '/', '.') AS module FROM pages""")
def q_module_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("src/"), F.regexp_extract("url", "^https?://[^/?#]+/([^?#]*)", 1), F.lit(".py"))
    return table(spark, sf_dir, "pages").select("page_id", fn.module_name(path).alias("module"))


PLACED = "placed AS (SELECT p_partkey AS fid, 'fn' || p_size AS name, CASE WHEN p_size <= 40 THEN p_brand END AS class_name, '/srv/shop/old/shop/' || lower(replace(p_type, ' ', '/')) || '.py' AS path, lower(replace(p_type, ' ', '/')) || '.py' AS file_path, p_size AS start_line, p_size + 9 AS end_line, p_name AS source FROM part)"


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as functions with paths: the repository's name stands twice in each."""
    path = F.concat(F.lit("/srv/shop/old/shop/"), F.lower(F.replace("p_type", F.lit(" "), F.lit("/"))), F.lit(".py"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fid"), F.expr("'fn' || p_size").alias("name"), F.when(F.col("p_size") <= 40, F.col("p_brand")).alias("class_name"), path.alias("path"), F.col("p_size").alias("start_line"), (F.col("p_size") + 9).alias("end_line"), F.col("p_name").alias("source"))


@query(f"WITH {PLACED} SELECT fid, 'File: ' || path || ' | fid=' || fid || ' | Total: ' || length(source) || ' chars | Showing: 3-' || least(length(source), 9) AS info, substr(source, 4, 6) AS chunk FROM placed")
def q_source_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.source_slice(placed(spark, sf_dir), 6, 3)


@query(f"WITH {PLACED} SELECT fid, name, file_path, class_name, start_line, end_line FROM placed WHERE contains(path, 'promo')")
def q_functions_in_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.functions_in(placed(spark, sf_dir), "promo", "shop")


@query(f"""WITH {PLACED}, hits AS (SELECT *, CASE WHEN contains(name, '1') THEN 0 ELSE 1 END AS prio FROM placed WHERE contains(name, '1') OR contains(source, '1')) SELECT '1' AS symbol, fid, name, file_path FROM hits ORDER BY prio, fid LIMIT 15""")
def q_contact_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.contact_points(placed(spark, sf_dir), "1", "shop", 15)


@query("SELECT regexp_replace(url, '^https?://', '') AS file_path, regexp_extract(url, '^https?://([^/?#]+)', 1) AS imported FROM pages")
def q_import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("/x/repo/"), F.regexp_replace("url", "^https?://", "")).alias("path"), F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("imported"))
    return lookups.import_edges(pages, "repo")


@query("""WITH e AS (SELECT DISTINCT 'S' || s_suppkey AS child, 'N' || s_nationkey AS parent FROM supplier UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation), c AS (SELECT child AS class_name FROM e UNION SELECT parent FROM e)
SELECT class_name, coalesce((SELECT string_agg(parent, ',' ORDER BY parent) FROM e WHERE child = class_name), '') AS parents, coalesce((SELECT string_agg(child, ',' ORDER BY child) FROM e WHERE parent = class_name), '') AS children FROM c""")
def q_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "supplier").select(F.expr("'S' || s_suppkey").alias("child"), F.expr("'N' || s_nationkey").alias("parent")).unionByName(table(spark, sf_dir, "nation").select(F.expr("'N' || n_nationkey").alias("child"), F.expr("'R' || n_regionkey").alias("parent")))
    classes = e.select(F.col("child").alias("class_name")).unionByName(e.select(F.col("parent").alias("class_name")))
    return lookups.inheritance(classes, e).select("class_name", F.array_join("parents", ",").alias("parents"), F.array_join("children", ",").alias("children"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS fid, CASE WHEN l_returnflag = 'R' THEN 'WRITES' ELSE 'READS' END AS kind, 't' || l_partkey % 9 AS t FROM lineitem)
SELECT o_orderkey AS fid, coalesce((SELECT string_agg(t, ',' ORDER BY t) FROM e WHERE fid = o_orderkey AND kind = 'READS'), '') AS reads, coalesce((SELECT string_agg(t, ',' ORDER BY t) FROM e WHERE fid = o_orderkey AND kind = 'WRITES'), '') AS writes FROM orders""")
def q_tables_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fid"), F.when(F.col("l_returnflag") == "R", "WRITES").otherwise("READS").alias("kind"), F.expr("'t' || l_partkey % 9").alias("table"))
    found = lookups.tables_touched(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fid")), e)
    return found.select("fid", F.array_join("reads", ",").alias("reads"), F.array_join("writes", ",").alias("writes"))


def order_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as log templates that customers emit."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("fid"), F.col("o_orderstatus").alias("text"), F.lower("o_orderpriority").alias("level"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 50).alias("line"), F.array(F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).otherwise(""), F.col("o_orderstatus")).alias("frags"))


@query("SELECT c_custkey AS fid, c_mktsegment AS name, o_orderstatus AS text, lower(o_orderpriority) AS level, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 50 END AS line FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def q_function_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("fid"), F.col("c_mktsegment").alias("name")).filter("name = 'BUILDING'")
    return lookups.templates_of(order_templates(spark, sf_dir), functions)


def _trie(qualified: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        functions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("fid"), F.when(F.col("c_nationkey") > 5, F.expr("'C' || c_nationkey")).alias("class_name"), F.col("c_mktsegment").alias("name"))
        return lookups.trie_templates(order_templates(spark, sf_dir), functions, qualified).withColumn("frags", F.array_join("frags", "|"))

    run.__name__ = "q_trie_templates" if qualified else "q_cached_templates"
    return run


for _qualified, _name in ((True, "CASE WHEN c_nationkey > 5 THEN 'C' || c_nationkey || '.' ELSE '' END || c_mktsegment"), (False, "c_mktsegment")):
    query(f"SELECT c_custkey AS fid, o_orderpriority || '|' || o_orderstatus AS frags, {_name} AS fname, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 50 ELSE 0 END AS line FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P'")(_trie(_qualified))


@query(f"""WITH {PLACED}, f AS (SELECT fid, name, CASE WHEN fid % 3 = 0 THEN source END AS flow FROM placed), n AS (SELECT name, min(fid) AS nf, min_by(flow, fid) AS nflow FROM f WHERE flow IS NOT NULL GROUP BY name)
SELECT fid, CASE WHEN flow IS NOT NULL THEN fid ELSE nf END AS flow_fid, coalesce(flow, nflow) AS flow FROM f LEFT JOIN n USING (name)""")
def q_flow_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = placed(spark, sf_dir).withColumn("flow", F.when(F.col("fid") % 3 == 0, F.col("source")))
    return lookups.flows_of(f, f)


@query(f"""WITH {CALLS}, {FUNCTIONS}, {DEGREES}
SELECT CASE WHEN coalesce(in_degree, 0) = 0 THEN 'entry' WHEN coalesce(out_degree, 0) = 0 THEN 'leaf' WHEN in_degree >= 10 THEN 'utility' WHEN in_degree <= 3 AND p_size > 25 THEN 'anchor' ELSE 'internal' END AS node_class, count(*) AS n FROM functions LEFT JOIN degrees USING (fid) GROUP BY 1""")
def q_class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.class_histogram(graph.classified(functions_of(spark, sf_dir), calls_of(spark, sf_dir), F.col("p_size") > 25))


SOURCES = "src AS (SELECT doc_id AS fid, text AS source, lang AS path, regexp_extract(text, '[a-z]{7,}', 0) AS w FROM documents), named AS (SELECT *, CASE WHEN w = '' THEN '' WHEN fid % 2 = 0 THEN 'get' || upper(w[1]) || w[2:] ELSE w END AS name FROM src)"


def sources_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fid"), F.col("text").alias("source"), F.col("lang").alias("path"), F.regexp_extract("text", "[a-z]{7,}", 0).alias("w"))
    return d.withColumn("name", F.when(F.col("w") == "", "").when(F.col("fid") % 2 == 0, F.concat(F.lit("get"), F.initcap("w"))).otherwise(F.col("w")))


@query(f"""WITH {SOURCES}, words AS (SELECT fid AS src, unnest(list_distinct(regexp_extract_all(source, '\\w+'))) AS w FROM src),
ranked AS (SELECT src, n.fid AS dst, row_number() OVER (PARTITION BY n.fid ORDER BY src) AS r FROM words JOIN (SELECT * FROM named WHERE fid % 2 = 0 AND w <> '') n USING (w) WHERE src <> n.fid)
SELECT src, dst FROM ranked WHERE r <= 20""")
def q_property_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "src bigint, dst bigint")
    return graph.property_calls(sources_of(spark, sf_dir), none).select("src", "dst")


@query(f"""WITH {CALLS}, {FUNCTIONS}, k AS (SELECT src AS fid, b.name, min(dst) AS d FROM calls JOIN functions b ON b.fid = dst GROUP BY 1, 2),
n AS (SELECT fid, 0 AS node_id, name AS own FROM functions WHERE fid % 2 = 0), shown AS (SELECT n.fid, 0 AS node_id, 'x.' || n.own AS call_target, k.d AS call_target_id FROM n LEFT JOIN k ON k.fid = n.fid AND k.name = n.own)
SELECT fid, node_id::BIGINT AS node_id, call_target, call_target_id FROM shown UNION ALL
SELECT k.fid, (CASE WHEN n.fid IS NULL THEN -1 ELSE 0 END + row_number() OVER (PARTITION BY k.fid ORDER BY k.name))::BIGINT, k.name, d FROM k LEFT JOIN n ON n.fid = k.fid WHERE n.own IS NULL OR n.own <> k.name""")
def q_injected_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = functions_of(spark, sf_dir)
    nodes = f.filter("fid % 2 = 0").select("fid", F.lit(0).cast("bigint").alias("node_id"), F.lit("call").alias("type"), F.concat(F.lit("x."), "name").alias("call_target"), F.lit(None).cast("bigint").alias("call_target_id"))
    calls = calls_of(spark, sf_dir).join(f.select(F.col("fid").alias("dst"), "name"), "dst")
    return lookups.called(nodes, calls).select("fid", "node_id", "call_target", "call_target_id")
