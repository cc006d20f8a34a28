"""Document fingerprints (operator 1) by winnowing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, ranges

#: A k-gram is so many words; a window so many k-grams (a power of two). Every passage of K + WINDOW - 1 equal words shares a selected hash.
K, WINDOW = 3, 4
#: Runs without white space are cut into pieces of at most so many code points, so that texts without spaces have words too.
PIECE = 4
_PLACE_BITS = 27
#: Rows of a range of ids that are put in order by one task.
RANGE_ROWS = 2_000


def let(value: Column, then) -> Column:
    """`then(value)`, with the value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def word_pieces(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), F.lit(0))


def _rotated(h: Column, n: int) -> Column:
    return F.shiftleft(h, n).bitwiseOR(F.shiftrightunsigned(h, 64 - n)) if n else h


def fingerprint(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """Selected k-grams of a text (null: empty) as bigints: the upper 36 bits of a hash, then 2^27 - 1 - position.

    A k-gram's hash rolls: each of its words' hashes is rotated by its place and all are joined by exclusive or. As the
    hash comes first and later positions are smaller numbers, the least number of a window is its least hash, and of equal
    ones the rightmost. Texts with fewer than k words have one k-gram of all of their words; texts without words none.
    """
    top = (1 << _PLACE_BITS) - 1
    words = F.transform(word_pieces(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w))

    def selected(h: Column) -> Column:
        def gram(x: Column, i: Column) -> Column:
            out = _rotated(x, k - 1)
            for j in range(1, k):
                out = out.bitwiseXOR(_rotated(F.get(h, i + j), k - 1 - j))
            return F.shiftleft(F.shiftrightunsigned(out, 1 + _PLACE_BITS), _PLACE_BITS).bitwiseOR(F.lit(top).cast("long") - i)

        grams = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (k - 1), F.lit(0))), gram)
        full = let(grams, lambda g: _least(g, 1, window))
        full = F.slice(full, F.lit(1), F.greatest(F.size(h) - (k + window - 2), F.lit(1)))
        short = F.transform(F.slice(h, F.lit(1), F.least(F.size(h), F.lit(1))), lambda x: F.shiftleft(F.shiftrightunsigned(F.aggregate(h, F.lit(0).cast("long"), lambda a, b: _rotated(a, 1).bitwiseXOR(b)), 1 + _PLACE_BITS), _PLACE_BITS).bitwiseOR(F.lit(top).cast("long")))
        return F.when(F.size(h) >= k, F.array_distinct(full)).otherwise(short)

    return let(words, selected)


def _least(values: Column, width: int, window: int) -> Column:
    """From the least of `width` values from each one on to the least of `window`, by doubling."""
    if width >= window:
        return values
    wider = F.transform(values, lambda x, i: F.least(x, F.get(values, i + width)))
    return let(wider, lambda v: _least(v, 2 * width, window))


def hashes(marks: Column) -> Column:
    """The distinct hashes of a fingerprint, without positions."""
    return F.array_distinct(F.transform(marks, lambda m: F.shiftrightunsigned(m, _PLACE_BITS)))


def positions(marks: Column) -> Column:
    """The positions (in words, from 0) of a fingerprint's k-grams."""
    return F.transform(marks, lambda m: F.lit((1 << _PLACE_BITS) - 1) - m.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return let(both, lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n).cast("double")))


def digest(marks: Column) -> Column:
    return F.sha2(F.concat_ws(" ", F.transform(marks, lambda m: F.hex(m))).cast("binary"), 256)


def shared_passages(docs: DataFrame, id_column: str = "doc_id", text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """One row for each selected hash of each document: id, hash, position, for joins on the hash."""
    marks = docs.select(F.col(id_column), F.explode(fingerprint(F.col(text), k, window)).alias("m"))
    top = (1 << _PLACE_BITS) - 1
    return marks.select(id_column, F.shiftrightunsigned("m", _PLACE_BITS).alias("hash"), (F.lit(top) - F.col("m").bitwiseAND(F.lit(top))).cast("long").alias("position"))


def with_next(docs: DataFrame, id_column: str = "doc_id", range_rows: int = RANGE_ROWS, own=lambda t: {}) -> DataFrame:
    """id, text, next_text and, for each column c of `own(text)`, c and next_c; next: the following row by descending id.

    The last row is followed by the first. Ranges of ids with cut points from exact counts are put in order side by side;
    a range's first row is also sent to the range before it, so no task sees more than its range. Null ids come
    last and follow the order of hashes of their texts, as rows with equal ids do. The only row of a table follows itself.
    """
    slim = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    cuts = ranges.cut_points(slim.select("id", F.lit(1).alias("w")), "id", "w", range_rows)
    placed = slim.select("*", ranges.place(F.col("id"), cuts).alias("r"), F.xxhash64("text").alias("h"))
    # the first row of each range, by descending id (nulls last): it stands behind the range that comes before it
    order = F.struct(F.col("id").isNotNull().alias("has"), F.col("id").alias("id"), (-F.shiftrightunsigned("h", 1)).alias("h"))
    heads = placed.groupBy("r").agg(F.max(order).alias("o")).select("r", F.col("o.id").alias("hid"), F.col("o.h").alias("hh"))
    before = Window.orderBy(F.desc("r"))  # a row for each range: at most ranges.MOST
    heads = heads.withColumn("to", F.coalesce(F.lag("r").over(before), F.min("r").over(Window.partitionBy())))
    joined = placed.join(F.broadcast(heads), "r")
    is_head = F.col("id").eqNullSafe(F.col("hid")) & (-F.shiftrightunsigned("h", 1) == F.col("hh"))
    rows = joined.select("id", "text", "h", F.explode(F.when(is_head, F.array(F.struct(F.col("r").alias("at"), F.lit(0).alias("behind")), F.struct(F.col("to").alias("at"), F.lit(1).alias("behind")))).otherwise(F.array(F.struct(F.col("r").alias("at"), F.lit(0).alias("behind"))))).alias("p"))
    rows = rows.select("id", "text", "h", F.col("p.at").alias("at"), F.col("p.behind").alias("behind"))
    dealt = rows.repartition(F.col("at"))
    known = dealt.withColumns(own(F.col("text")))
    w = Window.partitionBy("at").orderBy("behind", F.desc_nulls_last("id"), F.shiftrightunsigned("h", 1))
    names = ["text", *own(F.col("text"))]
    followed = known.withColumns({f"next_{c}": F.lead(c).over(w) for c in names})
    return followed.filter("behind = 0").select("id", *names, *[f"next_{c}" for c in names])


def edited_text(text: Column, following: Column) -> Column:
    """The last third of the code points replaced by as many of the following text's first (or all of them)."""
    n = F.char_length(text)
    return let(F.floor(n / 3).cast("int"), lambda m: F.concat(F.left(text, n - m), F.left(following, m)))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    rows = with_next(docs, own=lambda t: {"marks": fingerprint(t)})
    rows = rows.withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_marks", fingerprint(F.col("edited")))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digest(F.col("marks")).alias("fingerprint"),
        digest(F.col("edited_marks")).alias("edited_fingerprint"),
        let(hashes(F.col("marks")), lambda a: likeness(a, hashes(F.col("edited_marks")))).alias("near_edited"),
        let(hashes(F.col("marks")), lambda a: likeness(a, hashes(F.col("next_marks")))).alias("near_next"),
    )
