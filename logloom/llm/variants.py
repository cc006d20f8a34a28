"""Spelling variants (operator 12): one-letter neighbours of words by edits that Bloom filters let through, in groups by frequency."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .hashing import mix

LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
#: Filters: bits for each word, and the bytes that are broadcast at once (larger filters are probed in rounds).
BITS, ROUND_BYTES = 32, 64 << 20
#: Words of so many letters or more have one shard together.
LAST_SHARD = 64
SEGMENT = 4096  # blocks of 64 bits that are put together by one group
#: Distinct words that a task holds while it counts.
HELD = 200_000
_LETTERS = bytes([*range(0x61, 0x7B), *range(0xC0, 0x100)])
_ONLY_LETTERS = bytes(c if c in _LETTERS else 0x20 for c in range(256))
Edit = Callable[[bytes, int, bytes], bytes]


def letter_runs(text: bytes) -> list[bytes]:
    """The runs of A-Z, a-z and U+00C0 to U+00FF in order, A-Z in lower case, a byte for each letter (its code point)."""
    return text.decode("utf-8", "replace").encode("latin-1", "replace").lower().translate(_ONLY_LETTERS).split()


def misspelt(word: bytes, doc_id: int, prefix: bytes) -> bytes:
    """The word without one letter where 97 divides crc32 of `<doc_id>:<word>`, as the query states it."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), zlib.crc32(prefix))
    if h % 97:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, edit: Edit | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: the letter runs of all whole texts that are long and frequent enough, counted in tasks before the shuffle.

    `edit` may change a run by the id of its row (`edit(run, id, b"<id>:")`). Null and empty texts have no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            held = [(w.decode("latin-1"), n) for w, n in total.items() if len(w) >= least_length]
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in held], pa.string()), pa.array([n for _, n in held], pa.int64())], names=["word", "n"])

        for batch in batches:
            for part, texts in common.blocks(batch, "text"):
                for t, i in zip(texts, part.column(0).to_pylist(), strict=True):
                    found = Counter(letter_runs(t))
                    if edit is None or i is None:
                        total.update(found)
                    else:
                        prefix = b"%d:" % i
                        for w, n in found.items():
                            total[edit(w, i, prefix)] += n
                    if len(total) > HELD:
                        yield told()
        yield told()

    plain = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return common.in_arrow(plain, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _z(place: np.ndarray | int, letter: np.ndarray) -> np.ndarray:
    """The hash of a letter at a place; a word's hash is the exclusive or of its letters', so an edit changes few of them."""
    return mix(np.asarray(np.int64(place) << np.int64(8) | letter.astype(np.int64)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))


def _hashes(letters: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce(_z(np.arange(letters.shape[1]), letters), axis=1)


def _mask(h: np.ndarray) -> np.ndarray:
    """Five bits of a block."""
    out = np.zeros(len(h), np.uint64)
    for i in range(5):
        out |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
    return out


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their letters, words of one length at a time."""
    raw = [w.encode("latin-1") for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield rows, np.frombuffer(b"".join([raw[i] for i in rows.tolist()]), np.uint8).reshape(-1, size)


class Shards:
    """Where each length's filter lies in one row of 64-bit blocks: sizes come from exact counts by length."""

    def __init__(self, counts: dict[int, int]):
        self.first: dict[int, int] = {}
        self.blocks: dict[int, int] = {}
        self.total = 0
        for shard in sorted(counts):
            self.first[shard], self.blocks[shard] = self.total, -(-counts[shard] * BITS // 64)
            self.total += self.blocks[shard]

    def place(self, length: int, h: np.ndarray) -> np.ndarray | None:
        """The block of each hash among words of this length; None where there are no such words."""
        shard = min(length, LAST_SHARD)
        if shard not in self.first:
            return None
        return (self.first[shard] + ((h >> np.uint64(32)) % np.uint64(self.blocks[shard])).astype(np.int64)).astype(np.int64)


def _filter(words: DataFrame, shards: Shards, low: int, high: int) -> np.ndarray:
    """Blocks low…high of the filters of all words, put together by segments in tasks."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, letters in _by_length(batch.column(0).to_pylist()):
                h = _hashes(letters)
                at = shards.place(letters.shape[1], h)
                here = np.flatnonzero((at >= low) & (at < high))
                at = at[here] - low
                yield pa.RecordBatch.from_arrays([pa.array(at // SEGMENT), pa.array((at % SEGMENT).astype(np.int32)), pa.array(_mask(h[here]).view(np.int64))], names=["segment", "block", "mask"])

    def joined(group: pa.Table) -> pa.Table:
        made = np.zeros(SEGMENT, np.uint64)
        np.bitwise_or.at(made, group.column("block").to_numpy(), group.column("mask").to_numpy().view(np.uint64))
        return pa.table({"segment": pa.array([group.column("segment")[0].as_py()], pa.int64()), "bits": pa.array([made.tobytes()], pa.binary())})

    made = common.in_arrow(words.select("word"), bits, "segment long, block int, mask long").groupBy("segment").applyInArrow(joined, "segment long, bits binary")
    out = np.zeros(-(-(high - low) // SEGMENT) * SEGMENT, np.uint64)
    for segment, held in made.collect():
        out[segment * SEGMENT : (segment + 1) * SEGMENT] = np.frombuffer(held, np.uint64)
    return out


def _edits(letters: np.ndarray, order: np.ndarray, rank: np.ndarray) -> Iterator[tuple[int, np.ndarray, int, np.ndarray | None, np.ndarray]]:
    """(length, rows, place, new letters or None for a deletion, hashes): each neighbouring pair is made from one side only.

    A longer word gives the shorter one (of equal letters in a row the first is deleted), and of two words of one length
    the one with the rarer letter gives the other, so common letters, which stand nearly everywhere, give few edits.
    """
    n, size = letters.shape
    whole = _hashes(letters)
    here = _z(np.arange(size), letters)
    moved = _z(np.arange(size) - 1, letters)  # of letters that stand one place further left
    before = np.zeros(n, np.uint64)
    after = np.bitwise_xor.reduce(moved, axis=1)
    rows = np.arange(n)
    for i in range(size):
        old = letters[:, i]
        after = after ^ moved[:, i]
        distinct = rows if i == 0 else np.flatnonzero(old != letters[:, i - 1])
        yield size - 1, distinct, i, None, (before ^ after)[distinct]
        before = before ^ here[:, i]
        many = rank[old]
        source = np.repeat(rows, many)
        if len(source):
            new = order[np.arange(len(source)) - np.repeat(np.cumsum(many) - many, many)]
            yield size, source, i, new, (whole ^ here[:, i])[source] ^ _z(i, new)


def candidates(words: DataFrame, shards: Shards, order: bytes, low: int, high: int) -> DataFrame:
    """near, word, n: edits of words that blocks low…high of the filters let through."""
    held = words.sparkSession.sparkContext.broadcast(_filter(words, shards, low, high))
    letter = np.frombuffer(order, np.uint8)
    rank = np.zeros(256, np.int64)
    rank[letter] = np.arange(len(letter))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):  # edits of some thousand words at a time
                part = batch.slice(first, 4096)
                for rows, letters in _by_length(part.column(0).to_pylist()):
                    near: list[str] = []
                    owner: list[np.ndarray] = []
                    for length, source, i, new, h in _edits(letters, letter, rank):
                        at = shards.place(length, h)
                        if at is None or not len(h):
                            continue
                        here = np.flatnonzero((at >= low) & (at < high))
                        mask = _mask(h[here])
                        here = here[(held.value[at[here] - low] & mask) == mask]
                        if not len(here):
                            continue
                        made = letters[source[here]]
                        if new is None:
                            made = np.delete(made, i, axis=1)
                        else:
                            made[:, i] = new[here]
                        raw = made.tobytes().decode("latin-1")
                        near += [raw[k : k + length] for k in range(0, len(raw), length)] if length else []
                        owner.append(rows[source[here]])
                    if near:
                        yield pa.RecordBatch.from_arrays([pa.array(near, pa.string()), *[part.column(c).take(pa.array(np.concatenate(owner))) for c in (0, 1)]], names=["near", "word", "n"])

    return common.in_arrow(words.select("word", "n"), run, "near string, word string, n long")


def neighbours(words: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """word, n, near, near_n: each pair of words that differ by one letter inserted, deleted or replaced, once.

    Candidates that the filters let through meet the words themselves, so no false one stays. What is broadcast has at
    most `round_bytes`; a vocabulary with larger filters is probed once for each part of them.
    """
    shard = F.least(F.length("word"), F.lit(LAST_SHARD))
    shards = Shards({r.shard: r.n for r in words.groupBy(shard.alias("shard")).agg(F.count("*").alias("n")).collect()})
    letters = words.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").groupBy("c").count().collect()  # 90 at most
    order = b"".join(r.c.encode("latin-1") for r in sorted(letters, key=lambda r: (-r["count"], r.c)))
    step = max(SEGMENT, round_bytes // 8)
    found = None
    for low in range(0, max(shards.total, 1), step):
        more = candidates(words, shards, order, low, min(low + step, shards.total))
        found = more if found is None else found.union(more)
    exact = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return found.join(exact, "near").select("word", "n", "near", "near_n")


def forms(words: DataFrame, pairs: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n: of a word's near words the most frequent (ties: smallest), if it is `times` as frequent."""
    both = pairs.select(F.inline(F.array(F.struct("word", F.col("near").alias("other"), F.col("near_n").alias("m")), F.struct(F.col("near").alias("word"), F.col("word").alias("other"), F.col("n").alias("m")))))
    top = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("top"))
    most = -F.col("top.m")
    taken = most >= times * F.col("n")
    joined = words.join(top, "word", "left")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("top.other")).alias("form"), F.when(taken, most).alias("form_n"))


def roots(words: DataFrame) -> DataFrame:
    """Adds root to rows (word, form, …): the end of the chain of forms, the word itself without one.

    Each round follows twice as many steps as the one before. Forms are at least twice as frequent as their words, so a
    chain has few steps and never comes back; a round that changes nothing is the last.
    """
    at = common.written(words.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = common.written(at.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variants-roots")
        at = stepped.select("word", "root")
        if stepped.filter("moved").isEmpty():
            break
    return words.join(at, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, edit: Edit | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for each word of the vocabulary, grouped under the root it is a variant of.

    Words are runs of letters up to U+00FF of whole texts. Null and empty texts have none, repeated rows count again, rows
    without an id are never changed by `edit`; other columns, whatever their names, play no part. Equal frequencies are
    decided by the smaller word. An empty table gives no row.
    """
    words = common.written(vocabulary(docs, least_length, least_count, edit, id_column, text), "variants-words")
    held = common.written(forms(words, neighbours(words), times), "variants-forms")
    return roots(held).select("word", "form", "root", "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(common.table(spark, sf_dir, "documents"), edit=misspelt)
