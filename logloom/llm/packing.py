"""Best-fit packing (operator 9): token pieces into sequences of a fixed length by linear grouping."""

from __future__ import annotations

import unicodedata
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

LENGTH = 2048
#: Pieces of at most this many tokens are small: they are placed last, by best fit.
SMALL = 256
#: Groups of equal cardinality that large lengths are rounded up within.
GROUPS = 96
#: About so many bytes of words and ids are remembered by a worker; then it keeps those of the last block only.
MEMO_BYTES = 64 << 20
#: Rows that are numbered by one task.
PART_ROWS = 20_000
#: Strings that the tokenizer takes for tokens of their own wherever they stand.
_SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")


#: ASCII punctuation that never joins a run of letters before it (an apostrophe may).
_TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: First bytes of U+0300 to U+037F, which has all marks that a letter of A-Z is composed with.
_MARKS = (b"\xcc", b"\xcd")
_encoders: dict[str, object] = {}


class _Encoder:
    """Texts to their ids as little-endian unsigned 32-bit bytes, with id 0 at the end.

    The vocabulary's pieces never span white space and never join a run of letters to punctuation other than an
    apostrophe. So a text's ids are those of its words in a row, and each distinct word, or run of letters that are
    letters after the tokenizer's own normal form too, is encoded once while it is remembered. Case goes first only in texts
    without a mark that A-Z could be composed with, as what composes depends on case. Texts that hold a special token's string, in any case, go through the tokenizer as they are.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self, but: set[bytes] = frozenset()) -> None:
        """Drops what is remembered, but for the given words."""
        self.words: dict[bytes, bytes] = {w: self.words[w] for w in but} if but else {}
        self.words[b""] = b""
        self.held = sum(map(self._size, self.words.items()))

    @staticmethod
    def _size(item: tuple[bytes, bytes]) -> int:
        return 190 + len(item[0]) + len(item[1])

    def _plain(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def _remember(self, word: bytes, ids: bytes) -> None:
        self.words[word] = ids
        self.held += self._size((word, ids))

    def _each(self, runs: list[bytes]) -> None:
        for run, found in zip(runs, self.tokenizer.encode_batch_fast([r.decode("utf-8", "replace") for r in runs], add_special_tokens=False), strict=True):
            self._remember(run, np.array(found.ids, "<u4").tobytes())

    def _letters(self, runs: list[bytes]) -> None:
        """Runs of letters, many at a time; each is one word of the tokenizer (or else they are encoded one by one)."""
        for i in range(0, len(runs), 2000):
            part = runs[i : i + 2000]
            found = self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False)
            owner = np.array(found.word_ids, np.int64)
            ends = np.flatnonzero(np.diff(owner, append=-1)) + 1
            if len(ends) != len(part):
                self._each(part)
                continue
            ids = np.array(found.ids, "<u4").tobytes()
            start = 0
            for run, end in zip(part, (ends * 4).tolist(), strict=True):
                self._remember(run, ids[start:end])
                start = end

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        whole = {i: self._plain(t) + b"\0\0\0\0" for i, t in enumerate(texts) if b"<|" in t and any(x in t.lower() for x in _SPECIAL)}
        split = [() if i in whole else (t if any(m in t for m in _MARKS) else t.lower()).split() for i, t in enumerate(texts)]
        used = set().union(*split)
        new = used - self.words.keys()
        if self.held > MEMO_BYTES:
            self.forget(used - new)
        cut = {}
        letters, others = set(), set()
        for w in new:
            head = w.rstrip(_TAIL)
            if head.isalpha() if head.isascii() else unicodedata.normalize("NFC", head.decode("utf-8", "replace")).lower().isalpha():
                if head not in self.words:
                    letters.add(head)
                if head != w:
                    tail = w[len(head) :]
                    if tail not in self.words:
                        others.add(tail)
                    cut[w] = (head, tail)
            else:
                others.add(w)
        self._letters(list(letters))
        self._each(list(others))
        for w, (head, tail) in cut.items():
            self._remember(w, self.words[head] + self.words[tail])
        return [whole.get(i) or b"".join([*map(self.words.__getitem__, words), b"\0\0\0\0"]) for i, words in enumerate(split)]


def _encoder(path: str) -> _Encoder:
    """One for each worker process, which serves several tasks; what it remembers is bounded."""
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32. Texts over `length` tokens are cut, others are whole.

    Null and empty texts are one piece with the closing id alone. Repeated rows, and rows without an id, have pieces of
    their own; an empty table has none. Other columns, whatever their names, are left behind.
    """

    def start():
        encode = _encoder(tokenizer)

        def work(texts):
            sizes, sums = [], []
            for ids in encode(texts):
                cut = [ids[i : i + 4 * length] for i in range(0, len(ids), 4 * length)]
                sizes.append([len(c) // 4 for c in cut])
                sums.append([zlib.crc32(c) for c in cut])
            return [sizes, sums]

        return work

    sized = common.add_columns(docs, [("_sizes", "array<long>"), ("_sums", "array<long>")], start, text, [id_column])
    each = sized.select(F.col(id_column), F.posexplode(F.arrays_zip("_sizes", "_sums")).alias("piece", "p"))
    return each.select(id_column, F.col("piece").cast("int").alias("piece"), (F.col("piece").cast("long") * length).alias("start"), F.col("p._sizes").alias("length"), F.col("p._sums").alias("ids_crc32"))


# -- the plan: from counts of lengths alone, so its size doesn't depend on the number of pieces ------------------------


def linear_groups(counts: np.ndarray, small: int, groups: int) -> list[tuple[int, int, int]]:
    """(lowest, highest length, pieces) of groups of about equal cardinality over the lengths above `small`."""
    lengths = [int(n) for n in np.flatnonzero(counts) if n > small]
    total = sum(int(counts[n]) for n in lengths)
    out: list[tuple[int, int, int]] = []
    low, held, passed = None, 0, 0
    for i, n in enumerate(lengths):
        low = n if low is None else low
        held += int(counts[n])
        passed += int(counts[n])
        if passed * groups >= (len(out) + 1) * total or i == len(lengths) - 1:
            out.append((low, n, held))
            low, held = None, 0
    return out


def _fullest(sizes: list[int], left: list[int], length: int) -> list[int]:
    """How many of each size make the fullest configuration that `left` allows and has the largest open size in it."""
    first = next(i for i, n in enumerate(left) if n)
    room = length - sizes[first]
    take = [0] * len(sizes)
    take[first] = 1
    # reach: sums that can be made; how: the size that was added last, largest sizes first
    how = {0: -1}
    reach = [0]
    for i in range(first, len(sizes)):
        free = left[i] - (i == first)
        if free <= 0 or sizes[i] > room:
            continue
        new = []
        for s in reach:
            at = s
            for _ in range(min(free, (room - s) // sizes[i])):
                at += sizes[i]
                if at in how:
                    break
                how[at] = i
                new.append(at)
        reach += new
        if room in how:
            break
    at = max(how)
    while at:
        take[how[at]] += 1
        at -= sizes[how[at]]
    return take


def configurations(sizes: list[int], counts: list[int], length: int) -> list[tuple[list[int], int]]:
    """(pieces of each size, repetitions): for the largest open size, the fullest configuration, as often as counts allow."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    ordered, left = [sizes[i] for i in order], [counts[i] for i in order]
    out = []
    while any(left):
        take = _fullest(ordered, left, length)
        times = min(n // k for n, k in zip(left, take, strict=True) if k)
        left = [n - k * times for n, k in zip(left, take, strict=True)]
        back = [0] * len(sizes)
        for i, k in zip(order, take, strict=True):
            back[i] = k
        out.append((back, times))
    return out


def large_plan(counts: np.ndarray, length: int, small: int, groups: int) -> tuple[list[tuple], int]:
    """Rows (low, high, first rank in the group, pieces, first bin, slot) and the number of bins, for large pieces."""
    grouped = linear_groups(counts, small, groups)
    used = [0] * len(grouped)
    rows, bins = [], 0
    for take, times in configurations([g[1] for g in grouped], [g[2] for g in grouped], length):
        slot = 0
        for g, k in enumerate(take):
            for _ in range(k):
                rows.append((g, used[g], times, bins, slot))
                used[g] += times
                slot += 1
        bins += times
    return [(grouped[g][0], grouped[g][1], first, times, at, slot) for g, first, times, at, slot in rows], bins


def small_plan(counts: np.ndarray, rooms: dict[int, int], length: int, small: int) -> tuple[list[tuple], list[tuple]]:
    """Best fit of small pieces, longest first, into bins known only by how many have each room.

    Returns (length, first rank, pieces, kind of bin, first bin of that kind, slot) and, for each kind,
    (kind, room at the start, first bin of that room, bins); room `length` means a new bin.
    """
    # state: bins of one history: [room now, room at the start, first, number, placements (length, rank)]
    by_room: dict[int, list[list]] = defaultdict(list)
    for room, n in rooms.items():
        by_room[room].append([room, room, 0, n, []])
    opened = 0
    for n in range(min(small, length), 0, -1):
        left, rank = int(counts[n]) if n < len(counts) else 0, 0
        while left:
            room = next((r for r in range(n, length) if by_room.get(r)), None)
            if room is None:
                # as many new bins as hold them all, each then filled from its room
                number = -(-left // (length // n))
                state = [length, length, opened, number, []]
                opened += number
            else:
                state = by_room[room].pop()
            times = min(left, state[3])
            if times < state[3]:
                # the bins that stay behind hold the later ranks of what was placed before
                rest = [state[0], state[1], state[2] + times, state[3] - times, [(m, first + times) for m, first in state[4]]]
                by_room[rest[0]].append(rest)
            placed = [state[0] - n, state[1], state[2], times, [*state[4], (n, rank)]]
            by_room[placed[0]].append(placed)
            left -= times
            rank += times
    rows, kinds = [], []
    for states in by_room.values():
        for _, origin, first, number, placements in states:
            if placements:
                kind = len(kinds)
                kinds.append((kind, origin, first, number))
                rows += [(n, rank, number, kind, 0, slot) for slot, (n, rank) in enumerate(placements)]
    return rows, kinds


def _by_length(rows: list[tuple], counts: np.ndarray) -> list[tuple]:
    """Rows of large_plan told by single lengths: (length, first rank, end rank, bin of the first rank, slot)."""
    out = []
    for low, high, first, times, at, slot in rows:
        base = 0
        for n in range(low, high + 1):
            lo, hi = max(first, base), min(first + times, base + int(counts[n]))
            if lo < hi:
                out.append((n, lo - base, hi - base, at + lo - first, slot))
            base += int(counts[n])
    return out


_PLAN = "length long, lo long, hi long, kind long, origin long, first long, slot long"


def _numbered(df: DataFrame, by: str, counts: DataFrame, order: list[str], rank: str) -> DataFrame:
    """Adds the row's number from 0 among rows with equal `by`; a common value is numbered in parts and summed up.

    counts: `by`, n. One part has about PART_ROWS rows, so neither a hot value nor the input's size makes a long task.
    """
    parts = df.join(F.broadcast(counts), by).withColumn("_part", F.pmod(F.xxhash64(*order), F.ceil(F.col("n") / PART_ROWS)))
    within = parts.withColumn("_in", F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order)).cast("long") - 1)
    offsets = parts.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return within.join(offsets, [by, "_part"]).withColumn(rank, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before", "n")


def pack(parts: DataFrame, length: int = LENGTH, small: int = SMALL, groups: int = GROUPS, id_column: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to pieces (id, piece, start, length, ids_crc32; lengths from 1 to `length`).

    Linear grouping: lengths over `small` go into `groups` groups of equal cardinality and are rounded up to the
    largest of their group; configurations of these few sizes are filled as full as counts allow; the real pieces take
    the places of the rounded ones; small pieces then go where they fit best, by the room that is really left.
    The driver sees counts by length and by room (at most `length` of each) and makes plans in rank intervals; pieces
    find their interval by joins. An empty table gives an empty result. Equal rows are packed one by one.
    """
    spark = parts.sparkSession
    parts = common.written(parts, "pieces")
    key = [id_column, "piece", "start", "ids_crc32"]
    counts = np.zeros(length + 1, np.int64)
    for row in parts.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[row["length"]] = row["n"]
    by_length = spark.createDataFrame([(int(n), int(counts[n])) for n in np.flatnonzero(counts)], "length long, n long")
    ranked = _numbered(parts, "length", by_length, key, "rank")

    large, bins = large_plan(counts, length, small, groups)
    rows = [(n, lo, hi, -1, -1, first, slot) for n, lo, hi, first, slot in _by_length(large, counts)]
    # the lengths that each bin really holds give its room
    plan = spark.createDataFrame(rows, _PLAN)
    at = lambda frame, plan: frame.alias("p").join(F.broadcast(plan).alias("q"), (F.col("p.length") == F.col("q.length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    big = at(ranked.filter(F.col("length") > small), plan).select("p.*", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "slot").drop("rank")
    big = common.written(big, "large")
    used = common.written(big.groupBy("sequence_id").agg((length - F.sum("length")).alias("room")), "rooms")
    by_room = used.groupBy("room").agg(F.count("*").alias("n"))
    rooms = {row["room"]: row["n"] for row in by_room.collect()}
    placed, kinds = small_plan(counts, rooms, length, small)
    of = {k: (origin, first) for k, origin, first, _ in kinds}
    rows = [(n, rank, rank + times, kind, *of[kind], slot) for n, rank, times, kind, _, slot in placed]
    little = at(ranked.filter(F.col("length") <= small), spark.createDataFrame(rows, _PLAN))
    little = little.select("p.*", F.col("origin").alias("room"), (F.col("first") + F.col("rank") - F.col("lo")).alias("bin_rank"), (F.col("slot") + length).alias("slot")).drop("rank")
    room_counts = spark.createDataFrame([(int(r), int(n)) for r, n in rooms.items()], "room long, n long")
    ranked_bins = _numbered(used, "room", room_counts, ["sequence_id"], "bin_rank")
    columns = [*parts.columns, "sequence_id", "slot"]
    filled = little.filter(F.col("room") < length).join(ranked_bins, ["room", "bin_rank"]).select(columns)
    new = little.filter(F.col("room") == length).withColumn("sequence_id", F.col("bin_rank") + bins).select(columns)
    together = big.select(columns).unionByName(filled).unionByName(new)
    before = Window.partitionBy("sequence_id").orderBy("slot", *key).rowsBetween(Window.unboundedPreceding, -1)
    return together.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("slot")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return pack(pieces(docs, default_tokenizer()))
