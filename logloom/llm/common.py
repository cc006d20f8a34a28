"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word of every operator here: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Texts are handed to numpy in blocks of about this many bytes (a longer text is a block of its own).
BLOCK_BYTES = 4 << 20

#: Spark hands batches of at most about this many bytes to Python (or fewer, where the session says so).
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary())}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local master gets a temporary folder; on a cluster nothing that all could read can be made up.
    """
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"set {key} to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.conf.set(key, found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _release() -> None:
    """Gives back what a task has freed: workers outlive their tasks and lie idle beside the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with batches bounded in bytes, whose workers give memory back at the end of a task."""
    conf = df.sparkSession.conf
    if (now := re.fullmatch(r"(\d+)b?", conf.get(_BATCH))) and int(now[1]) > BATCH_BYTES:  # what a user has set in other units stays
        conf.set(_BATCH, f"{BATCH_BYTES}b")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _release()

    return df.mapInArrow(bounded, schema)


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def blocks(batch: pa.RecordBatch, text: str, most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with their texts as UTF-8 bytes (null: empty), each of at most about `most` bytes."""
    column = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "")
    sizes = pc.binary_length(column).to_pylist()
    values = column.cast(pa.binary())
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield batch.slice(start, i - start), values.slice(start, i - start).to_pylist()
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start), values.slice(start).to_pylist()


def add_columns(df: DataFrame, fields: list[tuple[str, str]], start: Callable[[], Callable[[list[bytes]], list]], text: str = "text", keep: list[str] | None = None, most: int = BLOCK_BYTES) -> DataFrame:
    """df's columns in `keep` (all by default) and the new `fields`.

    `start()` runs once in each task and returns a function from a list of texts (bytes) to one list or array for
    each field. Rows stay where they are: no shuffle. A new field takes the place of a column with its name.
    """
    new = {n.lower() for n, _ in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    inner = list(dict.fromkeys([*keep, text]))
    frame = df.select(*[F.col(f"`{c}`") for c in inner])
    schema = T.StructType([frame.schema[c] for c in keep] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    types = [_ARROW[t] for _, t in fields]
    names = [*keep, *[n for n, _ in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for part, texts in blocks(batch, text, most):
                made = [pa.array(v, type=t) for v, t in zip(work(texts), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in keep] + made, names=names)

    return in_arrow(frame, run, schema)
