"""Retrieval: chunks, vector top-k, rank fusion, boosts and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import dot

# Window and stride in words, rank constant, boosts and thresholds.
CHUNK, STRIDE, SHORTEST = 256, 156, 20
RRF = 60
DOMAIN, DOMAIN_BOOST, ENTRY_BOOST, LEAF_BOOST = 0.40, 0.05, 0.03, -0.03
CANDIDATE = 0.35
#: Queries that are sent to every task have so many bytes at most.
BROADCAST_BYTES = 32 << 20


def chunks(docs: DataFrame, key: str, text: str, size: int = CHUNK, stride: int = STRIDE) -> DataFrame:
    """key, chunk_no, chunk: the text itself if it has at most `size` words, else windows that end with the text."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    told = docs.filter(F.length(text) >= SHORTEST).select(key, F.col(text).alias("_t"), words.alias("_w"))
    last = F.ceil(F.greatest(F.size("_w") - size, F.lit(0)) / stride).cast("int")
    each = told.select(key, "_t", "_w", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    cut = F.array_join(F.slice("_w", F.col("chunk_no") * stride + 1, F.lit(size)), " ")
    return each.select(key, "chunk_no", F.when(F.size("_w") <= size, F.col("_t")).otherwise(cut).alias("chunk"))


def top_k(vectors: DataFrame, query: DataFrame, k: int, key: str = "vec_id", embedding: str = "embedding", unique: bool = False) -> DataFrame:
    """query_id, key, score, rank of the k nearest of all vectors for each query (query_id, qvec); best chunk per key.

    The queries are sent to every task, so they are counted first: more than BROADCAST_BYTES of them are refused, to be
    asked in blocks. With `unique` keys each task ranks its own rows and hands on k for each query; else the scores of a key's chunks meet first.
    """
    size = query.agg(F.coalesce(F.sum(F.size("qvec")), F.lit(0)).alias("n")).first().n * 8
    if size > BROADCAST_BYTES:
        raise ValueError(f"queries hold {size} bytes, more than the {BROADCAST_BYTES} that are sent to every task: ask them in blocks")
    best = vectors.crossJoin(F.broadcast(query)).select("query_id", key, dot(F.col("qvec"), F.col(embedding)).alias("score"))
    if not unique:
        best = best.groupBy("query_id", key).agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key)))
    return ranked.filter(F.col("rank") <= k)


def fused(lanes: DataFrame, k: int, key: str = "fid") -> DataFrame:
    """key, rrf, lanes, best, best_lane of ranked hits (lane, key, score, rank from 1): sum of 1 / (60 + rank)."""
    out = lanes.groupBy(key).agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("rrf"), F.count("*").alias("lanes"), F.max("score").alias("best"), F.max_by("lane", "score").alias("best_lane"), F.min(F.struct("lane", "rank")).alias("_first"))
    return out.orderBy(F.desc(F.round("rrf", 12)), "_first").limit(k).drop("_first")


def boosted(hits: DataFrame, members: DataFrame, classes: DataFrame, key: str = "fid") -> DataFrame:
    """hits with score raised for members of a routed domain and entry or anchor functions, lowered for leaves."""
    known = hits.join(members.select(key).distinct().withColumn("_m", F.lit(DOMAIN_BOOST)), key, "left").join(classes.select(key, "node_class"), key, "left")
    by_class = F.when(F.col("node_class").isin("entry", "anchor"), ENTRY_BOOST).when(F.col("node_class") == "leaf", LEAF_BOOST).otherwise(0.0)
    return known.withColumn("score", F.col("score") + F.coalesce("_m", F.lit(0.0)) + by_class).drop("_m")


def routed(domain_vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, entry, score of at most `k` domains (entry, embedding) for each query (query_id, qvec), scored DOMAIN or more."""
    return top_k(domain_vectors, queries, k, key="entry", unique=True).filter(F.col("score") >= DOMAIN).select("query_id", "entry", "score")


def domain_search(hits: DataFrame, domains: DataFrame, members: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """query_id, fid, score, domain_match, rank: the k best hits of each query after its routing.

    `hits` (query_id, fid, score, rank) come from a search of all functions, at least 2 k of them a query; `domains` and
    `members` from `routed` and `domain_members`. A routed query's hits are raised if they are members, or entries or
    anchors, and lowered if they are leaves, and ranked anew; of equal scores the earlier hit is first. The hits of a
    query without a domain stay as they are. A function without a class, or a query without hits, changes nothing.
    """
    sent = domains.select("query_id").distinct().withColumn("_routed", F.lit(True))
    of = members.select("query_id", "fid").distinct().withColumn("_member", F.lit(True))
    known = hits.join(sent, "query_id", "left").join(of, ["query_id", "fid"], "left").join(classes.select("fid", "node_class").dropDuplicates(["fid"]).hint("merge"), "fid", "left")
    raised = F.when(F.col("_member"), DOMAIN_BOOST).otherwise(0.0) + F.when(F.col("node_class").isin("entry", "anchor"), ENTRY_BOOST).when(F.col("node_class") == "leaf", LEAF_BOOST).otherwise(0.0)
    scored = known.withColumn("_s", F.col("score") + F.when(F.col("_routed"), raised).otherwise(0.0))
    again = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("_s", 12)), "rank", "fid"))
    return scored.select("query_id", "fid", F.col("_s").alias("score"), F.coalesce("_member", F.lit(False)).alias("domain_match"), again.alias("_new")).filter(F.col("_new") <= k).withColumnRenamed("_new", "rank")


def tiered(candidates: DataFrame, executed: DataFrame, errors: DataFrame, key: str = "fid") -> DataFrame:
    """key, tier, score, log_count: candidates that ran (1), candidates that didn't (2), error functions beside them (3)."""
    good = candidates.filter(F.col("score") >= CANDIDATE)
    ran = executed.groupBy(key).agg(F.count("*").alias("log_count"))
    first = good.join(ran, key, "left").select(key, F.when(F.col("log_count").isNotNull(), 1).otherwise(2).alias("tier"), "score", F.coalesce("log_count", F.lit(0)).alias("log_count"))
    third = errors.select(key).distinct().join(good.select(key), key, "left_anti").select(key, F.lit(3).alias("tier"), F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("log_count"))
    return first.unionByName(third)


def merged(a: DataFrame, b: DataFrame, k: int, key: str = "fid") -> DataFrame:
    """The best score of each key of two result lists, the k best."""
    return a.select(key, "score").unionByName(b.select(key, "score")).groupBy(key).agg(F.max("score").alias("score")).orderBy(F.desc("score"), key).limit(k)


def mechanism(summary: Column, most: int = 500) -> Column:
    """What a summary says behind [MECHANISM], else behind its first sentence, else all of it; short summaries give null."""
    marked = F.trim(F.regexp_extract(summary, r"(?s)\[MECHANISM\](.*?)(?:\[TOUCHES\]|\[FAILURES\]|$)", 1))
    rest = F.trim(F.regexp_extract(summary, r"(?s)^[^.]*\.(.*)$", 1))
    text = F.when(marked != "", marked).when(F.length(rest) > 20, rest).otherwise(summary)
    return F.when(F.length(summary) >= 30, F.substring(text, 1, most))


def call_paths(seeds: DataFrame, calls: DataFrame, depth: int = 3, fan: int = 4, most: int = 6) -> DataFrame:
    """seed, path (array of ids): walks along each node's first callees without a repeated node, at most `most` a seed."""
    few = calls.select("src", "dst").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).filter(F.col("_r") <= fan)
    level = seeds.select(F.col("fid").alias("seed"), F.array("fid").alias("path"))
    ended = None
    for _ in range(depth):
        step = level.join(few, F.element_at("path", -1) == F.col("src"), "left")
        on = step.filter(F.col("dst").isNotNull() & ~F.array_contains("path", F.col("dst"))).select("seed", F.concat("path", F.array("dst")).alias("path"))
        grown = on.select("seed", F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).distinct()
        stop = level.join(grown, ["seed", "path"], "left_anti")
        ended = stop if ended is None else ended.unionByName(stop)
        level = on
    ended = ended.unionByName(level)
    return ended.withColumn("_r", F.row_number().over(Window.partitionBy("seed").orderBy("path"))).filter(F.col("_r") <= most).drop("_r")
