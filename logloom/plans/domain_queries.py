"""Domains of a call graph and searches routed to them: parts are functions, a part calls a later part of its module that follows it in an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import graph, retrieval
from .registry import query, table

MODULES = """placed AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_type FROM lineitem JOIN part ON p_partkey = l_partkey),
edges AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, p_type AS t, lead(l_partkey) OVER w AS dst, lead(p_type) OVER w AS u FROM placed
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) WHERE src < dst AND t = u),
starts AS (SELECT DISTINCT src AS entry FROM edges WHERE src NOT IN (SELECT dst FROM edges)),
walk(entry, id, depth) AS (SELECT entry, entry, 0 FROM starts UNION SELECT entry, dst, depth + 1 FROM walk JOIN edges ON src = id WHERE depth < 5),
trees AS (SELECT DISTINCT entry, id FROM walk),
domains AS (SELECT entry FROM trees GROUP BY entry HAVING count(*) >= 5)"""


def modules_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(functions, calls): calls stay within a module (a part's type) and lead to larger ids; they are written, as they are read again and again."""
    part = table(spark, sf_dir, "part")
    placed = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(part.select(F.col("p_partkey").alias("l_partkey"), "p_type").hint("merge"), "l_partkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pairs = placed.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), "p_type", F.lead("p_type").over(w).alias("_next"))
    calls = graph.written(pairs.filter("src < dst AND p_type = _next").select("src", "dst").distinct())
    path = F.concat(F.lit("src/"), "p_brand", F.lit("/"), "p_type", F.when(F.col("p_size") > 25, ".java").otherwise(".groovy"))
    return part.select(F.col("p_partkey").alias("fid"), F.col("p_name").alias("name"), path.alias("path")), calls


@query(f"""WITH RECURSIVE {MODULES},
called AS (SELECT src, string_agg(p_name, ' ' ORDER BY dst) AS callees FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM edges) JOIN part ON p_partkey = dst WHERE r <= 5 GROUP BY src)
SELECT entry, p_name || ' (' || p_type || ')' AS label, md5(p_name || ' ' || p_type || ' ' || callees || ' ' || substr(coalesce(text, ''), 1, 200)) AS md5
FROM domains JOIN part ON p_partkey = entry JOIN called ON src = entry LEFT JOIN documents ON doc_id = entry""")
def q_domain_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions, calls = modules_of(spark, sf_dir)
    summaries = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fid"), F.col("text").alias("summary"))
    return graph.domain_index(functions, calls, summaries).select("entry", "label", F.md5("text").alias("md5"))


@query(f"""WITH RECURSIVE {MODULES},
vectors AS (SELECT entry, label, embedding FROM domains JOIN embeddings ON vec_id = entry),
ends AS (SELECT label, min(entry) AS a, max(entry) AS b FROM vectors GROUP BY label),
mixed AS (SELECT 2 * l.label AS query_id, list_transform(list_zip(x.embedding, y.embedding), lambda z: z[1]::DOUBLE + z[2]::DOUBLE) AS v FROM ends l JOIN vectors x ON x.entry = l.a JOIN vectors y ON y.entry = l.b),
alone AS (SELECT 2 * label + 1 AS query_id, embedding::DOUBLE[] AS v FROM (SELECT label, max(vec_id) AS vec_id FROM embeddings GROUP BY label) JOIN embeddings USING (label, vec_id)),
queries AS (SELECT query_id, list_transform(v, lambda z: z / sqrt(list_dot_product(v, v))) AS q FROM (SELECT * FROM mixed UNION ALL SELECT * FROM alone)),
near AS (SELECT query_id, entry, list_dot_product(q, embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(q, embedding::DOUBLE[]) DESC, entry) AS r FROM queries, vectors),
sent AS (SELECT query_id, entry FROM near WHERE r <= 5 AND score >= 0.40),
members AS (SELECT DISTINCT query_id, id AS fid FROM sent JOIN trees USING (entry)),
hits AS (SELECT * FROM (SELECT query_id, vec_id AS fid, list_dot_product(q, embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(q, embedding::DOUBLE[]) DESC, vec_id) AS rank FROM queries, embeddings) WHERE rank <= 40),
degrees AS (SELECT fid, sum(i) AS ins, sum(o) AS outs FROM (SELECT src AS fid, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY fid),
raised AS (SELECT query_id, fid, rank, m.fid IS NOT NULL AS domain_match, score + CASE WHEN query_id NOT IN (SELECT query_id FROM sent) THEN 0 ELSE
  CASE WHEN m.fid IS NOT NULL THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN ins = 0 THEN 0.03::DOUBLE WHEN outs = 0 THEN -0.03::DOUBLE ELSE 0 END END AS score
  FROM hits LEFT JOIN members m USING (query_id, fid) LEFT JOIN degrees USING (fid)),
again AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, rank, fid) AS new FROM raised)
SELECT query_id::BIGINT AS query_id, fid, round(score, 6)::DOUBLE AS score, domain_match, new::BIGINT AS rank FROM again WHERE new <= 20""")
def q_domain_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two queries a label: between its first and last domain, and at its last function (mostly routed to none)."""
    functions, calls = modules_of(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    index = graph.written(graph.domain_index(functions, calls, functions.select("fid", F.lit("").alias("summary"))).select("entry"))
    vectors = e.withColumnRenamed("vec_id", "entry").join(index.hint("merge"), "entry")
    ends = vectors.groupBy("label").agg(F.min_by("embedding", "entry").alias("a"), F.max_by("embedding", "entry").alias("b"))
    mixed = ends.select((F.col("label") * 2).alias("query_id"), F.zip_with("a", "b", lambda x, y: x + y).alias("v"))
    alone = e.groupBy("label").agg(F.max_by("embedding", "vec_id").alias("v")).select((F.col("label") * 2 + 1).alias("query_id"), "v")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    queries = mixed.unionByName(alone).withColumn("_l", length).select(F.col("query_id").cast("bigint").alias("query_id"), F.transform("v", lambda x: x / F.col("_l")).alias("qvec"))
    queries = graph.written(queries)
    hits = retrieval.top_k(e, queries, 40, unique=True).withColumnRenamed("vec_id", "fid")
    domains = graph.written(retrieval.routed(vectors.select("entry", "embedding"), queries))
    classes = graph.degrees(calls).withColumn("node_class", graph.node_class(F.col("in_degree"), F.col("out_degree"), F.lit(False)))
    found = retrieval.domain_search(hits, domains, graph.domain_members(domains, calls), classes, 20)
    return found.select("query_id", "fid", F.round("score", 6).alias("score"), "domain_match", F.col("rank").cast("bigint").alias("rank"))
