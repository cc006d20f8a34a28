"""Clusters of a thread's timeline, alignment with expected sequences, error groups and context windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def thread_clusters(entries: DataFrame, anchors: DataFrame, thread: str, idx: str, function: str) -> DataFrame:
    """Adds cluster_no (from 1 on each thread): a row of an anchor function starts a cluster; earlier rows join the first.

    anchors: the function names. Rows without a function start nothing. Clusters without any function go.
    """
    starts = entries.join(anchors.select(F.col(function)).distinct().withColumn("_a", F.lit(1)), function, "left")
    running = Window.partitionBy(thread).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    numbered = starts.withColumn("cluster_no", F.greatest(F.lit(1), F.coalesce(F.sum("_a").over(running), F.lit(0)))).drop("_a")
    some = Window.partitionBy(thread, "cluster_no")
    return numbered.withColumn("_n", F.count(function).over(some)).filter("_n > 0").drop("_n")


def cluster_summary(clustered: DataFrame, thread: str, idx: str, function: str) -> DataFrame:
    """thread, cluster_no, anchor (its first non-null function), first, last, n."""
    return clustered.groupBy(thread, "cluster_no").agg(F.min_by(function, F.when(F.col(function).isNotNull(), F.col(idx))).alias("anchor"), F.min(idx).alias("first"), F.max(idx).alias("last"), F.count("*").alias("n"))


def error_threads(entries: DataFrame, thread: str, error: str) -> DataFrame:
    """Entries of threads that hold an error; null threads count as one thread, `unknown`."""
    named = entries.withColumn(thread, F.coalesce(F.col(thread).cast("string"), F.lit("unknown")))
    return named.join(named.filter(F.col(error)).select(thread).distinct(), thread, "left_semi")


def aligned(entries: DataFrame, expected: DataFrame, thread: str, idx: str, function: str) -> DataFrame:
    """Adds ord (place in the expected sequence, null if the function isn't in it) and divergence.

    expected: function, ord. Divergences are error_unmapped and unexpected_entry; entries without a function have none.
    """
    first = expected.groupBy(function).agg(F.min("ord").alias("ord"))
    joined = entries.join(first, function, "left")
    return joined.withColumn("divergence", F.when(F.col(function).isNull() | F.col("ord").isNotNull(), F.lit(None)).when(F.col("is_error"), "error_unmapped").otherwise("unexpected_entry"))


def thread_coverage(joined: DataFrame, thread: str, function: str) -> DataFrame:
    """thread, with_function, matched, coverage in hundredths to one place."""
    n = F.count_if(F.col(function).isNotNull())
    hit = F.count_if(F.col("ord").isNotNull())
    return joined.groupBy(thread).agg(n.alias("with_function"), hit.alias("matched"), F.round(100.0 * hit / F.greatest(n, F.lit(1)), 1).alias("coverage"))


def divergence_report(joined: DataFrame, thread: str, idx: str, threads: int = 5, each: int = 8) -> DataFrame:
    """The first divergences of the first threads that have some, in order."""
    odd = joined.filter(F.col("divergence").isNotNull())
    few = odd.select(thread).distinct().orderBy(thread).limit(threads)
    ranked = odd.join(F.broadcast(few), thread).withColumn("r", F.row_number().over(Window.partitionBy(thread).orderBy(idx)))
    return ranked.filter(F.col("r") <= each).drop("r")


def error_clusters(entries: DataFrame, idx: str, fid: str, name: str, text: str, error: str = "is_error", samples: int = 5) -> DataFrame:
    """fid (-1 if unknown), name, error_count, first_idx, samples: errors by function, with their first messages in order.

    Only the first messages of a function are ever gathered: rows are numbered by a window that spills, then cut.
    """
    errors = entries.filter(F.col(error)).withColumn("_f", F.coalesce(F.col(fid), F.lit(-1)))
    counts = errors.groupBy("_f").agg(F.max(name).alias("name"), F.count("*").alias("error_count"), F.min(idx).alias("first_idx"))
    ranked = errors.withColumn("_r", F.row_number().over(Window.partitionBy("_f").orderBy(idx))).filter(F.col("_r") <= samples)
    texts = ranked.groupBy("_f").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(text).alias("t")))), lambda s: s["t"]).alias("samples"))
    return counts.join(texts, "_f").select(F.col("_f").alias("fid"), F.coalesce("name", F.lit("UNMAPPED")).alias("name"), "error_count", "first_idx", "samples")


def related_functions(entries: DataFrame, idx: str, fid: str, function: str, error: str = "is_error", errors: int = 3, reach: int = 3, most: int = 8) -> DataFrame:
    """fid, related: other functions near the first errors of each function, by name, at most `most`."""
    first = entries.filter(F.col(error)).withColumn("_f", F.coalesce(F.col(fid), F.lit(-1)))
    first = first.withColumn("_r", F.row_number().over(Window.partitionBy("_f").orderBy(idx))).filter(F.col("_r") <= errors)
    around = first.select("_f", F.col(function).alias("_own"), F.explode(F.sequence(F.col(idx) - reach, F.col(idx) + reach)).alias(idx))
    near = around.join(entries.select(idx, F.col(function).alias("_o")), idx).filter(F.col("_o").isNotNull() & ~F.col("_o").eqNullSafe(F.col("_own")))
    return near.groupBy(F.col("_f").alias("fid")).agg(F.slice(F.array_sort(F.collect_set("_o")), 1, most).alias("related"))


def windows(entries: DataFrame, centres: DataFrame, idx: str, before: int = 10, after: int = 5) -> DataFrame:
    """Entries within [centre - before, centre + after] of a centre, once each: an equi-join on the positions of the windows."""
    places = centres.select(F.explode(F.sequence(F.col(idx) - before, F.col(idx) + after)).alias(idx)).distinct()
    return entries.join(places, idx, "left_semi")


def owned(entries: DataFrame, functions: DataFrame, idx: str, fid: str, function: str, error: str = "is_error", reach: int = 3) -> DataFrame:
    """idx, how (fid, name, neighbour) of entries that belong to `functions` (fid, name).

    By id, by name (equal, or its last part), and errors without a function near such an entry. The first way counts.
    """
    by_id = entries.join(functions.select(F.col("fid").alias(fid)).distinct(), fid, "left_semi").select(idx, F.lit(0).alias("p"))
    names = functions.select(F.lower("name").alias("_n")).distinct()
    by_name = entries.withColumn("_n", F.lower(F.element_at(F.split(function, r"\."), -1))).join(names, "_n", "left_semi").select(idx, F.lit(1).alias("p"))
    direct = by_id.unionByName(by_name).groupBy(idx).agg(F.min("p").alias("p"))
    near = direct.select(F.explode(F.sequence(F.col(idx) - reach, F.col(idx) + reach)).alias(idx)).distinct()
    lost = entries.filter(F.col(error) & F.col(function).isNull()).select(idx).join(near, idx, "left_semi").select(idx, F.lit(2).alias("p"))
    best = direct.unionByName(lost).groupBy(idx).agg(F.min("p").alias("p"))
    return best.select(idx, F.element_at(F.array(F.lit("fid"), F.lit("name"), F.lit("neighbour")), F.col("p") + 1).alias("how"))


def obvious_cause(errors: DataFrame, tier: str, root: str) -> DataFrame:
    """One row: errors, roots, obvious (all errors in tier 1, one root), confidence (0.9 if obvious), root."""
    out = errors.agg(F.count("*").alias("errors"), F.count_distinct(root).alias("roots"), F.coalesce(F.bool_and(F.col(tier) == 1), F.lit(False)).alias("_all"), F.min(root).alias("_root"))
    obvious = F.col("_all") & (F.col("roots") == 1)
    return out.select("errors", "roots", obvious.alias("obvious"), F.when(obvious, 0.9).otherwise(0.0).alias("confidence"), F.when(obvious, F.col("_root")).alias("root"))


def cluster_id(fid: Column) -> Column:
    return F.concat(F.lit("c_"), F.coalesce(fid, F.lit(-1)).cast("string"))


def selected(entries: DataFrame, selection: str, fid: str, error: str = "is_error") -> DataFrame:
    """The errors of the clusters that a user names: `all`, or ids (c_<fid>, c_-1: without a function) with commas between."""
    errors = entries.filter(F.col(error))
    if selection.strip().lower() == "all":
        return errors
    return errors.filter(cluster_id(F.col(fid)).isin([s.strip() for s in selection.split(",")]))


def choices(clusters: DataFrame, related: DataFrame, summaries: DataFrame, most: int = 5) -> DataFrame:
    """id, function, error_count, summary, related of error clusters: what a user picks from.

    clusters: as of `error_clusters`. related: fid, related. summaries: fid, summary; without one the first two messages count.
    """
    both = clusters.join(related, "fid", "left").join(summaries.select("fid", "summary"), "fid", "left")
    summary = F.coalesce(F.nullif("summary", F.lit("")), F.array_join(F.slice("samples", 1, 2), "; "))
    few = F.slice(F.coalesce("related", F.array().cast("array<string>")), 1, most)
    return both.select(cluster_id(F.col("fid")).alias("id"), F.col("name").alias("function"), "error_count", summary.alias("summary"), few.alias("related"))


def error_flow(entries: DataFrame, idx: str, function: str, error: str = "is_error", before: int = 3, after: int = 2) -> DataFrame:
    """error_idx, idx, function (`?` if unknown), marked: what ran around each error; an equi-join on the positions."""
    around = entries.filter(F.col(error)).select(F.col(idx).alias("error_idx"), F.explode(F.sequence(F.col(idx) - before, F.col(idx) + after)).alias(idx))
    near = around.join(entries.select(idx, F.coalesce(function, F.lit("?")).alias("function")), idx)
    return near.select("error_idx", idx, "function", (F.col(idx) == F.col("error_idx")).alias("marked"))
