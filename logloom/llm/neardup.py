"""Near-duplicate detection (operator 7): SetSketch registers, bands, joint likelihood, exact confirmation, components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, hashing

#: Registers: minima of exponential variables of rate A, spaced by powers of B, as unsigned 16-bit numbers.
B, A, TOP = 1.001, 20.0, 2**16 - 1
#: Registers that a pair's bits are taken from before its rows are put together.
BITS = 2048
#: A pair at the threshold shares no band with at most this probability.
MISS = 1e-6
#: Pairs whose likeliest similarity is this far below the threshold aren't confirmed (about five standard errors).
MARGIN = 0.16


def bands(similarity: float, miss: float = MISS) -> tuple[int, int]:
    """(bands, registers in each) for a threshold."""
    rows = 5 if similarity >= 0.85 else 4 if similarity >= 0.7 else 2
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows)), rows


def minima(grams: np.ndarray, m: int, skip: int = 0) -> np.ndarray:
    a = hashing.multipliers(m, skip)
    least = np.full(m, 2**64 - 1, np.uint64)
    block = max(16, 65536 // m)
    for i in range(0, len(grams), block):
        least = np.minimum(least, (grams[i : i + block, None] * a).min(0))
    return least


def registers(grams: np.ndarray, m: int) -> np.ndarray:
    """SetSketch of a set of hashes. Registers of a union are the larger ones of its parts."""
    h = -np.log1p(-(minima(grams, m).astype(np.float64) + 0.5) / 2**64) / A
    return np.clip(np.floor(1 - np.log(np.maximum(h, 1e-300)) / math.log(B)), 0, TOP).astype("<u2")


def bits(grams: np.ndarray) -> np.ndarray:
    """One bit of each of BITS further registers, as bigints: sets of similarity J differ in about (1 - J) / 2 of them."""
    return np.packbits((hashing.mix(minima(grams, BITS, 1024)) & np.uint64(1)).astype(np.uint8)).view("<i8")


def most_bits(similarity: float) -> int:
    """As many bits as sets at a threshold differ in, and 6.5 standard deviations more."""
    p = (1 - similarity) / 2
    return math.ceil(BITS * p + 6.5 * math.sqrt(BITS * p * (1 - p)))


def merged(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(x, y)


def likeliest(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """The Jaccard similarity under which the registers (pairs, m) of sets of known sizes are likeliest, on a grid."""
    more, less = (x > y).sum(1)[:, None], (x < y).sum(1)[:, None]
    same = x.shape[1] - more - less
    u = (nx / (nx + ny))[:, None]
    v = 1 - u
    j = np.minimum(u / v, v / u) * np.linspace(0, 1, 201)
    p = lambda t: -np.log1p(-np.clip(t, 0, 1) * (B - 1) / B) / math.log(B)
    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    chance = more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, 0) + tiny)
    return np.take_along_axis(j, chance.argmax(1)[:, None], 1)[:, 0]


def sketches(docs: DataFrame, width: int, m: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, digest of the set, registers; one row for each row."""

    def start():
        def work(texts):
            sizes, digests, regs = [], [], []
            for t in texts:
                grams = hashing.shingles(t, width)
                sizes.append(len(grams))
                digests.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                regs.append(registers(grams, m).tobytes() if len(grams) else b"")
            return [sizes, digests, regs]

        return work

    return common.add_columns(docs, [("n_shingles", "long"), ("digest", "binary"), ("registers", "binary")], start, text, [id_column])


def _likely(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, na, nb, ra, rb) that may be linked: by size, then by likelihood."""
    sized = pairs.filter((F.col("na") >= least * F.col("nb") * (1 - 1e-9)) & (F.col("nb") >= least * F.col("na") * (1 - 1e-9)))
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), "<u2").reshape(part.num_rows, -1) for c in (4, 5))
                found = likeliest(x, y, part.column(2).to_numpy(zero_copy_only=False), part.column(3).to_numpy(zero_copy_only=False))
                yield part.select(["a", "b"]).filter(pa.array(found >= least - MARGIN))

    return common.in_arrow(sized.select("a", "b", "na", "nb", "ra", "rb"), run, schema)


def _confirmed(pairs: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs (a, b, ta, tb) of texts whose full sets hold 100 * intersection >= percent * union."""
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, np.ndarray | None] = (None, None)
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                tb = batch.column(3)[i].as_py()
                if last[0] != tb:
                    last = (tb, hashing.shingles(tb, width))
                x, y = hashing.shingles(batch.column(2)[i].as_py(), width), last[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return common.in_arrow(pairs.select("a", "b", "ta", "tb"), run, schema)


def by_merge(df: DataFrame) -> DataFrame:
    """df, never to be joined by sending it or the other side whole through the driver.

    Spark judges by sizes that can be far too low: what is exploded counts as before, an array as one element, and a
    written table as its compressed file, in which a class that stands in many bands is held once.
    """
    return df.hint("merge")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in `edges` (a, b): the smallest id reachable.

    Each round an id takes the smallest label around it, then that label's own label, until nothing changes; edges
    between members and hubs need few rounds. Labels are a written table after each round.
    """
    both = common.written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    state = common.written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        around = both.join(by_merge(state.select(F.col("id").alias("b"), "component")), "b").select(F.col("a").alias("id"), "component", F.lit(None).cast(state.schema["id"].dataType).alias("old"))
        own = state.select("id", "component", F.col("component").alias("old"))
        nearest = around.unionByName(own).groupBy("id").agg(F.min("component").alias("component"), F.max("old").alias("old"))
        further = state.select(F.col("id").alias("_i"), F.col("component").alias("_c"))
        new = nearest.join(by_merge(further), nearest["component"] == further["_i"]).select("id", F.col("_c").alias("component"), "old")
        new = common.written(new, "labels")
        state = new.select("id", "component")
        if not new.filter("component <> old").limit(1).count():
            return state


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept for every row of docs.

    Equal sets become one class, by the smallest id, before anything is compared. Classes meet where they share a band.
    Of these, shingles that no other class holds are counted: if m is the lesser of what two classes hold besides, they
    share at most m shingles, so most pairs that merely have a passage or a template in common are ruled out by
    numbers alone, exactly, and so are classes that can't be linked with any other; one-bit registers rule out most of
    the others that are far below the threshold. In each bucket of a band all are
    compared with one hub, the class with the smallest share of such shingles, so a bucket of n gives n - 1 pairs. Then pairs
    of a bucket that lie in different components and that the numbers allow are compared too: no candidate is left out.
    Links are confirmed on the full sets. Texts without words, and rows without an id, are linked with nothing
    (component_id is their own id, null for null). Rows that share an id are one document.
    """
    least = percent / 100
    number, rows = bands(least)
    docs = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    sketched = common.written(sketches(docs, width, number * rows, "id"), "sketches")
    usable = sketched.filter("n_shingles > 0 AND id IS NOT NULL")
    classes = common.written(usable.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers")), "classes")
    keys = [F.xxhash64(F.lit(i), F.substring("registers", 2 * rows * i + 1, 2 * rows)) for i in range(number)]
    classes = classes.withColumn("keys", F.array(*keys))
    banded = classes.select("rep", F.posexplode("keys").alias("i", "band"))
    several = banded.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1").select("band")
    banded = common.written(banded.join(by_merge(several), "band"), "bands")
    wanted = banded.select(F.col("rep").alias("id")).distinct()
    texts = common.written(docs.join(wanted, "id", "left_semi").select("id", F.coalesce("text", F.lit("")).alias("text")), "texts")
    # classes with the number of their shingles that others of these hold as well
    sets = common.add_columns(texts, [("grams", "array<long>")], lambda: lambda ts: [[hashing.shingles(t, width).view(np.int64) for t in ts]], "text", ["id"])
    lone = sets.select("id", F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("k"), F.min("id").alias("id")).filter("k = 1").groupBy("id").agg(F.count("*").alias("lone"))
    facts = classes.select("rep", "n", "registers", "keys").join(wanted.withColumnRenamed("id", "rep"), "rep").join(lone.withColumnRenamed("id", "rep"), "rep", "left")
    facts = facts.select("rep", "n", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("m"), "registers", "keys")
    facts = facts.filter(100 * F.col("m") >= percent * F.col("n"))
    sketch = common.add_columns(texts, [("s", "array<long>")], lambda: lambda ts: [[bits(hashing.shingles(t, width)) for t in ts]], "text", ["id"])
    facts = common.written(facts.join(by_merge(sketch.withColumnRenamed("id", "rep")), "rep"), "facts")
    members = common.written(banded.join(by_merge(facts), "rep"), "members")
    most = most_bits(least)

    def may(x: str, y: str, first_only: bool):
        """Whether two classes can be linked by their numbers (they share at most the lesser m) and are likely to, by bits."""
        m = F.least(F.col(f"{x}.m"), F.col(f"{y}.m"))
        apart = sum((F.bit_count(F.get(f"{x}.s", F.lit(i)).bitwiseXOR(F.get(f"{y}.s", F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
        # a pair that shares several bands is made in the first of them only
        earlier = F.coalesce(*[F.when(F.get(f"{x}.keys", F.lit(i)) == F.get(f"{y}.keys", F.lit(i)), F.lit(i)) for i in range(number)]) < F.col(f"{x}.i")
        return (100 * m >= percent * (F.col(f"{x}.n") + F.col(f"{y}.n") - m)) & (apart <= most) & (~earlier if first_only else F.lit(True))

    def confirm(pairs: DataFrame, name: str) -> DataFrame:
        """Links among pairs of rows x and y of the same band."""
        column = lambda side, name, out: F.col(f"{side}.{name}").alias(out)
        told = pairs.select(column("x", "rep", "a"), column("y", "rep", "b"), column("x", "n", "na"), column("y", "n", "nb"), column("x", "registers", "ra"), column("y", "registers", "rb"))
        likely = _likely(told, least).distinct()
        read = likely.join(texts.select(F.col("id").alias("a"), F.col("text").cast("binary").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").cast("binary").alias("tb")), "b")
        return common.written(_confirmed(read, percent, width), f"{name}-links")

    first = F.struct(((F.col("n") - F.col("m")) / F.col("n")).alias("share"), F.xxhash64("rep").alias("h"), "rep", "n", "m", "s", "registers", "keys", "i")
    hub = members.groupBy("band").agg(F.min(first).alias("t")).select("band", "t.rep", "t.n", "t.m", "t.s", "t.registers", "t.keys", "t.i")
    links = confirm(members.alias("x").join(by_merge(hub.alias("y")), (F.col("x.band") == F.col("y.band")) & (F.col("x.rep") != F.col("y.rep")) & may("x", "y", False)), "hub")
    state = components(links)
    told = members.join(by_merge(state.withColumnRenamed("id", "rep")), "rep", "left").withColumn("c", F.coalesce("component", "rep"))
    mixed = told.groupBy("band").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x < y").select("band")
    open_ = common.written(told.join(by_merge(mixed), "band").select("band", "i", "rep", "c", "n", "m", "s", "registers", "keys"), "open")
    pairs = open_.alias("x").join(by_merge(open_.alias("y")), (F.col("x.band") == F.col("y.band")) & (F.col("x.c") != F.col("y.c")) & (F.col("x.rep") < F.col("y.rep")) & may("x", "y", True))
    more = confirm(pairs, "rest")
    if more.limit(1).count():
        state = components(links.unionByName(more))
    copies = classes.filter("copies > 1").select("digest", "rep")
    known = sketched.join(copies, "digest", "left").withColumn("rep", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "id")).otherwise(F.col("id")))
    out = known.join(by_merge(state.select(F.col("id").alias("rep"), "component")), "rep", "left")
    out = out.select(F.col("id").alias(id_column), "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True)))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
