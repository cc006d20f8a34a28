"""Raw log lines of text and JSON logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1), line of every line under a path.

    A file's lines are numbered by its splits: each split counts its own lines, offsets of splits are added. So a huge
    file is read by many tasks and none of them sees it whole.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"), F.col("value").alias("line"))
    in_block = Window.partitionBy("file", "block").orderBy("m")
    numbered = lines.withColumn("n", F.row_number().over(in_block))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lines.groupBy("file", "block").agg(F.count("*").alias("lines")).select("file", "block", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("offset"))
    return numbered.join(offsets, ["file", "block"]).select("file", (F.col("offset") + F.col("n")).alias("line_no"), "line")


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 1), line: one row for each line of a text column; null texts have none."""
    return df.select(F.col(key), F.posexplode(F.split(F.col(text), "\n")).alias("p", "line")).select(key, (F.col("p") + 1).cast("bigint").alias("line_no"), "line")


def json_fields(line: Column, field_map: dict[str, str]) -> Column:
    """A struct of the mapped top-level fields as strings; null where a field or valid JSON is missing."""
    parsed = F.try_parse_json(line)
    return F.struct(*[F.try_variant_get(parsed, f"$.{source}" if source.isidentifier() else f"$['{source}']", "string").alias(name) for name, source in field_map.items()])
