"""Byte-level BPE (operator 5): ranked merges folded over byte arrays with higher-order functions and literal tables."""

from __future__ import annotations

import base64
import json

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .winnow import let

#: Distinct pieces of the corpus that are encoded once, the most frequent ones: at most so many.
FREQUENT = 1 << 17
_SEED = 42  # of Spark's xxhash64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def spark_pattern(pattern: str) -> str:
    """The pattern for Java: its white space is that of Unicode, as in the library."""
    return f"(?U){pattern}"


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


class Table:
    """A literal hash table from bytes to small numbers: an array of bigints, looked up by xxhash64 in at most two places.

    An entry holds the upper 44 bits of its key's hash and a number below 2^20; its place comes from the lower bits (or
    from the next ones), so nearly all 64 bits are compared and no key has to be stored.
    """

    def __init__(self, values: dict[bytes, int]):
        bits = max(4, (4 * max(1, len(values)) - 1).bit_length())
        while not self._fill(values, bits):
            bits += 1
        self.bits = bits

    def _fill(self, values: dict[bytes, int], bits: int) -> bool:
        mask = (1 << bits) - 1
        slots: list[tuple[int, int] | None] = [None] * (1 << bits)
        for key, value in values.items():
            item = (xxhash.xxh64_intdigest(key, _SEED), value)
            at = item[0] & mask
            for _ in range(200):
                slots[at], item = item, slots[at]
                if item is None:
                    break
                one, two = item[0] & mask, (item[0] >> 20) & mask
                at = two if at == one else one
            else:
                return False
        self.entries = [0 if s is None else _signed(s[0] & ~0xFFFFF | s[1]) for s in slots]
        return True

    def column(self) -> Column:
        """The table as a literal."""
        return F.from_json(F.lit(json.dumps(self.entries)), "array<bigint>")

    def found(self, table: Column, h: Column) -> Column:
        """The number of the key with a hash, null if it isn't there."""
        mask = (1 << self.bits) - 1
        one = F.get(table, h.bitwiseAND(F.lit(mask)).cast("int"))
        two = F.get(table, F.shiftrightunsigned(h, 20).bitwiseAND(F.lit(mask)).cast("int"))
        same = lambda e: F.shiftrightunsigned(e.bitwiseXOR(h), 20) == 0
        number = lambda e: e.bitwiseAND(F.lit(0xFFFFF)).cast("int")
        return F.when(same(one), number(one)).when(same(two), number(two))


def merges(piece: Column, ranks: Table, table: Column) -> Column:
    """Ids of one piece (binary): the lowest-ranked pair of its parts is merged, the leftmost of equal ones, to the end.

    The fold's state is the parts and the ranks of their pairs (null: no such token). A merge looks up the pairs on its
    two sides only.
    """
    none = F.array().cast("array<int>")
    nothing = F.array().cast("array<bigint>")
    found = lambda h: ranks.found(table, h)

    def step(acc: Column, _: Column) -> Column:
        parts, ranked = acc["parts"], acc["ranks"]
        at = lambda i: F.get(parts, i)

        def merged(i: Column) -> Column:  # place of the lowest pair, from 1
            left = F.when(i > 1, F.array(F.xxhash64(F.concat(at(i - 2), at(i - 1), at(i))))).otherwise(nothing)
            right = F.when(i + 1 < F.size(parts), F.array(F.xxhash64(F.concat(at(i - 1), at(i), at(i + 1))))).otherwise(nothing)
            return F.when(i.isNull(), acc).otherwise(
                F.struct(
                    F.concat(F.slice(parts, F.lit(1), i - 1), F.array(F.concat(at(i - 1), at(i))), F.slice(parts, i + 2, F.size(parts))).alias("parts"),
                    F.concat(F.slice(ranked, F.lit(1), F.greatest(i - 2, F.lit(0))), F.transform(F.concat(left, right), found), F.slice(ranked, i + 2, F.size(ranked) + 1)).alias("ranks"),
                )
            )

        return let(F.array_position(ranked, F.array_min(ranked)).cast("int"), merged)

    def folded(parts: Column) -> Column:
        pairs = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p, i: F.xxhash64(F.concat(p, F.get(parts, i + 1))))
        start = F.struct(parts.alias("parts"), F.transform(pairs, found).alias("ranks"))
        steps = F.when(F.size(parts) > 1, F.sequence(F.lit(2), F.size(parts))).otherwise(none)
        ids = lambda acc: F.transform(F.transform(acc["parts"], lambda p: F.xxhash64(p)), found)
        return F.aggregate(steps, start, step, ids)

    single = F.transform(F.sequence(F.lit(1), F.octet_length(piece)), lambda i: F.substring(piece, i, F.lit(1)))
    return let(single, folded)


def pieces(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(spark_pattern(pattern)), F.lit(0))


def frequent_pieces(docs: DataFrame, pattern: str, text: str, most: int) -> DataFrame:
    """The pieces with at least some count over all rows, as many as are at most `most` (a bounded table)."""
    counts = docs.select(F.explode(pieces(F.col(text), pattern)).alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    counts = common.written(counts.filter("c > 1"), "pieces")
    step = F.floor(F.log2("c") * 16)
    buckets = sorted(((int(r[0]), r[1]) for r in counts.groupBy(step.alias("k")).agg(F.count("*")).collect()), reverse=True)  # some hundreds
    least, held = None, 0
    for k, n in buckets:
        if held + n > most:
            break
        least, held = k, held + n
    return counts.filter(step >= least if least is not None else F.lit(False)).select(F.col("w").cast("binary").alias("w"))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", out: str = "ids", most: int = FREQUENT) -> DataFrame:
    """Adds `out`, the ids of the text (array<int>); null and empty texts give an empty array.

    Frequent distinct pieces are folded once and become a literal table; every other piece is folded where it stands.
    Nothing but counts of pieces is shuffled. Very long pieces (a run of one character, say) take time that grows with the
    square of their length.
    """
    rank_table = Table(ranks)
    known = frequent_pieces(docs, pattern, text, most)
    known = known.repartition(docs.sparkSession.sparkContext.defaultParallelism * 2)
    known = known.select("w", let(rank_table.column(), lambda t: merges(F.col("w"), rank_table, t)).alias("ids")).toArrow()  # at most `most` rows
    coded: dict[bytes, list[int]] = dict(zip(known.column(0).to_pylist(), known.column(1).to_pylist(), strict=True)) | {p: [i] for p, i in ranks.items()}
    word_table = Table({w: i for i, w in enumerate(coded)})
    lists = F.from_json(F.lit(json.dumps(list(coded.values()))), "array<array<int>>")
    tables = F.struct(word_table.column().alias("words"), lists.alias("lists"), rank_table.column().alias("ranks"))

    def all_of(t: Column) -> Column:
        def each(words: Column) -> Column:
            hashes = F.transform(words, lambda w: F.xxhash64(w))
            one = lambda w, h: F.coalesce(F.get(t["lists"], word_table.found(t["words"], h)), merges(w.cast("binary"), rank_table, t["ranks"]))
            return F.flatten(F.zip_with(words, hashes, one))

        return let(pieces(F.col(text), pattern), each)

    return docs.withColumn(out, let(tables, all_of))


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes that an array of ids stands for: their pieces, joined."""
    back = {i: p for p, i in ranks.items()}
    table = F.from_json(F.lit(json.dumps([base64.b64encode(back.get(i, b"")).decode() for i in range(max(back) + 1)])), "array<binary>")
    return let(table, lambda t: F.array_join(F.transform(ids, lambda i: F.get(t, i).cast("string")), "").cast("binary"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, ranks, public_tokenizers.PATTERN)
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"), F.sha2(decode(F.col("ids"), ranks), 256).alias("decoded_sha256"))
