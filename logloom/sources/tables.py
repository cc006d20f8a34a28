"""Parquet tables of logs, graph labels and edges, embeddings and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schemas of the engine's own tables.
SCHEMAS = {
    "raw_lines": "file string, line_no bigint, line string",
    "functions": "fid bigint, name string, path string, class_name string, source string, lang string, start_line int, end_line int",
    "calls": "src bigint, dst bigint, synthetic boolean, reason string",
    "imports": "file_path string, imported string",
    "injects": "class_name string, field_name string, injected string",
    "log_templates": "frags array<string>, fname string, fid bigint, line int",
    "flow_nodes": "fid bigint, node_id int, type string, line int, log_level string, log_text string, call_target string, call_target_id bigint, branch_type string, condition string, branch_depth int",
    "flow_edges": "fid bigint, src int, dst int, edge_type string",
    "embeddings": "fid bigint, name string, chunk string, embedding array<float>",
    "test_cases": "report_id string, node_id string, outcome string, duration_s double",
}


def contracts() -> dict[str, str]:
    """The schema of each of the engine's tables as JSON, for other programs."""
    return {name: T.StructType.fromDDL(ddl).json() for name, ddl in SCHEMAS.items()}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """folder/name.parquet; a missing table of a known schema is empty."""
    path = f"{folder}/{name}.parquet"
    schema = SCHEMAS.get(name)
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if schema and not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path)


def write(df: DataFrame, folder: str, name: str, by: str | None = None) -> None:
    """Replaces folder/name.parquet, or only the partitions of `by` that df has."""
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(by)
    writer.parquet(f"{folder}/{name}.parquet")


def changed(new: DataFrame, known: DataFrame, key: str = "fid", source: str = "source") -> DataFrame:
    """Rows of `new` whose source has another hash (first 12 hex digits of its MD5) than in `known` (key, md5)."""
    marked = new.withColumn("md5", F.substring(F.md5(F.coalesce(F.col(source), F.lit(""))), 1, 12))
    return marked.join(known.select(key, "md5"), [key, "md5"], "left_anti")


def stale(stored: DataFrame, current: DataFrame) -> DataFrame:
    """repo, stored and current commit, is_stale: whether a repository's index is of another commit than its head."""
    both = stored.select("repo", F.col("commit_hash").alias("stored")).join(current.select("repo", F.col("commit_hash").alias("current")), "repo", "left")
    return both.withColumn("is_stale", ~F.col("stored").eqNullSafe(F.col("current")))
