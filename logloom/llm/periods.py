"""Periodic runs (operator 11): squares are caught online by blocks of words of power-of-two lengths, and merge into runs."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from .hashing import mix

#: A run has at least so many words (and at least two periods).
LEAST = 12
#: Words that are appended at once, and bytes of texts that one catcher follows (a longer text has one of its own).
PIECE, STREAM_BYTES = 1 << 16, 1 << 20
FIELDS = [("n_runs", "long"), ("start", "long"), ("length", "long"), ("period", "long"), ("exponent_milli", "long"), ("runs_sha256", "string"), ("collapsed_sha256", "string")]
Edit = Callable[[list[bytes], int | None], list[bytes]]


class Catchers:
    """Finds all runs of a growing sequence of numbers; `append` takes any number of them at a time.

    A run of period p repeats p places later for max(least - p, p) places or more. Of those, the largest power of two m
    with 2 m - 1 <= that many always fits as a whole aligned block. So each completed block of m places is a catcher for
    the periods of its level, [2 m - 1, 4 m - 2] apart from the short ones: each appended number completes one suffix of
    m numbers for each level, which is compared with the two or three blocks that can catch it. Catches of one period by
    consecutive blocks are one chain, which stays open while the next block can still catch; a closed one is
    extended by less than m places on both sides, by halves. Hashes of suffixes double from level to level.

    It holds 8 bytes for each number and level (levels: about log2 of a quarter of `longest`); work is O(log) for each.
    """

    def __init__(self, size: int, longest: int | None = None, least: int = LEAST):
        self.least, self.n = least, 0
        longest = size if longest is None else longest
        spans: dict[int, list[list[int]]] = {}
        p = 1
        while 2 * p <= longest:
            stretch = max(least - p, p)
            level = ((stretch + 1) // 2).bit_length() - 1
            last = p if p < least else 4 * (1 << level) - 2  # longer periods of a level are one span
            last = min(last, longest // 2)
            mine = spans.setdefault(level, [])
            if mine and mine[-1][1] == p - 1:
                mine[-1][1] = last
            else:
                mine.append([p, last])
            p = last + 1
        self.spans = spans
        self.levels = [np.empty(size, np.uint64) for _ in range(max(spans, default=0) + 1)]
        none = np.empty(0, np.int64)
        self.open = {k: (none, none, none) for k in spans}  # period, first place, end of the last block
        self.closed: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # first place, length, period

    def append(self, values: np.ndarray) -> None:
        before, self.n = self.n, self.n + len(values)
        self.levels[0][before : self.n] = values
        for k in range(1, len(self.levels)):
            half = 1 << (k - 1)
            a, b = max(0, before - 2 * half + 1), self.n - 2 * half + 1
            if a < b:
                low = self.levels[k - 1]
                self.levels[k][a:b] = mix(low[a:b] * np.uint64(0x9E3779B97F4A7C15) + low[a + half : b + half])
        for k in self.spans:
            self._chain(k, *self._catches(k, before))

    def _catches(self, k: int, before: int) -> tuple[np.ndarray, np.ndarray]:
        """Periods and blocks that the suffixes of level k completed by the last numbers are caught by."""
        m, held = 1 << k, self.levels[k]
        periods, blocks = [], []
        for low, high in self.spans[k]:
            a, b = max(low, before - m + 1), self.n - m + 1
            if a >= b:
                continue
            new = held[a:b]
            base = (np.arange(a, b) - low) // m
            for step in range((high - low) // m + 2):
                block = (base - step) * m
                hit = np.flatnonzero(new == held[block])  # a place before the first one wraps around and is left out
                block = block[hit]
                period = hit + a - block
                fits = (block >= 0) & (period <= high)
                periods.append(period[fits])
                blocks.append(block[fits])
        none = np.empty(0, np.int64)
        return (np.concatenate(periods), np.concatenate(blocks)) if periods else (none, none)

    def _chain(self, k: int, period: np.ndarray, block: np.ndarray) -> None:
        m = 1 << k
        if not len(period) and not len(self.open[k][0]):
            return
        open_period, open_first, open_end = self.open[k]
        p = np.concatenate([open_period, period])
        first = np.concatenate([open_first, self._left(k, period, block)])
        start = np.concatenate([open_end - m, block])  # of the chain's last block
        order = np.lexsort((start, p))
        p, first, start = p[order], first[order], start[order]
        begins = np.ones(len(p), bool)
        begins[1:] = (p[1:] != p[:-1]) | (start[1:] != start[:-1] + m)
        at = np.flatnonzero(begins)
        p, first, end = p[at], first[at], start[np.append(at[1:], len(start)) - 1] + m
        waits = end + p + m > self.n
        self.open[k] = (p[waits], first[waits], end[waits])
        done = ~waits
        self._close(k, self.closed, p[done], first[done], end[done])

    def _close(self, k: int, to: list, p: np.ndarray, first: np.ndarray, end: np.ndarray) -> None:
        length = self._right(k, p, end) - first + p
        fits = length >= np.maximum(self.least, 2 * p)
        if fits.any():
            to.append((first[fits], length[fits], p[fits]))

    def _left(self, k: int, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the matches at distance p that end before `at` begin, fewer than a block away."""
        for half in range(k - 1, -1, -1):
            to = at - (1 << half)
            held = self.levels[half]
            same = to >= 0
            same[same] = held[to[same]] == held[to[same] + p[same]]
            at = np.where(same, to, at)
        return at

    def _right(self, k: int, p: np.ndarray, end: np.ndarray) -> np.ndarray:
        for half in range(k - 1, -1, -1):
            held = self.levels[half]
            same = end + p + (1 << half) <= self.n
            same[same] = held[end[same]] == held[end[same] + p[same]]
            end = np.where(same, end + (1 << half), end)
        return end

    def runs(self) -> np.ndarray:
        """Runs of all numbers so far, as rows (start, length, period) by start, then period; nothing is closed by asking.

        A multiple of a run's period spans the same places, so the least period of a span is the run's own.
        """
        found = list(self.closed)
        for k, chains in self.open.items():
            self._close(k, found, *chains)
        if not found:
            return np.empty((0, 3), np.int64)
        start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((period, length, start))
        start, length, period = start[order], length[order], period[order]
        own = np.ones(len(start), bool)
        own[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
        start, length, period = start[own], length[own], period[own]
        order = np.lexsort((period, start))
        return np.stack([start[order], length[order], period[order]], 1)


def _caught(texts: list[np.ndarray], salt: int, least: int) -> list[np.ndarray]:
    """Runs of each text: they follow each other in one stream, and a word of one text equals no word of another."""
    sizes = np.array([len(t) for t in texts])
    total = int(sizes.sum())
    if not total:
        return [np.empty((0, 3), np.int64)] * len(texts)
    own = mix(np.arange(1, len(texts) + 1, dtype=np.uint64) * np.uint64(2 * salt + 1))
    stream = mix(np.concatenate(texts) ^ np.repeat(own, sizes))
    catchers = Catchers(total, int(sizes.max()), least)
    for i in range(0, total, PIECE):
        catchers.append(stream[i : i + PIECE])
    found = catchers.runs()
    ends = np.cumsum(sizes)
    cuts = np.searchsorted(found[:, 0], ends[:-1])
    parts = np.split(found, cuts)
    return [p - np.array([e - s, 0, 0]) for p, e, s in zip(parts, ends.tolist(), sizes.tolist(), strict=True)]


def find(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each list of words, by start, then period.

    Words are compared by 64-bit hashes; each run is then confirmed on the words themselves. A text for which that fails
    is read again with numbers instead of hashes and another salt.
    """
    hashes = [np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64) for words in texts]
    out = [[tuple(r) for r in runs.tolist()] for runs in _caught(hashes, 0, least)]
    for i, words in enumerate(texts):
        if not _true(words, out[i]):
            number: dict[bytes, int] = {}
            exact = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
            out[i] = next(runs for salt in count(1) if _true(words, runs := [tuple(r) for r in _caught([exact], salt, least)[0].tolist()]))
    return out


def _true(words: list[bytes], runs: list[tuple[int, int, int]]) -> bool:
    return all(words[s : s + n - p] == words[s + p : s + n] for s, n, p in runs)


def longest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    return min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        edge[s + p] += 1
        edge[s + n] -= 1
    dropped = np.cumsum(edge[:-1]) > 0
    return [w for w, gone in zip(words, dropped.tolist(), strict=True) if not gone]


def _row(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    top = longest(runs)
    told = "".join([f"{s},{n},{p}\n" for s, n, p in runs])
    return (len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(collapse(words, runs))).hexdigest())


def _measured(texts: list[list[bytes]], least: int) -> list[tuple]:
    return [_row(words, runs) for words, runs in zip(texts, find(texts, least), strict=True)]


def periodic_runs(docs: DataFrame, least: int = LEAST, edit: Edit | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The id and FIELDS for each row: runs of words and the text without their repetitions, as digests; no shuffle.

    Words are those of common.WORD. `edit` may change a text's words by its id before they are looked at. A run is a
    maximal stretch with smallest period q and at least max(least, 2 q) words; of equally long ones the first, then the
    one of the smaller period is told. Null and empty texts have no run: no numbers, and digests of nothing. Rows, null
    ids and repeated rows stay as they are; other columns, whatever their names, are left behind. A text is held
    whole in its task, with 8 bytes a word for each level (the logarithm of its words).
    """
    at, body = f"`{id_column}`", f"`{text}`"
    plain = docs.selectExpr(f"{at} AS doc_id", f"{body} AS text")

    def run(batches):
        for batch in batches:
            for part, texts in common.blocks(batch, "text", STREAM_BYTES):
                words = [t.split() for t in texts]
                if edit is not None:
                    words = [edit(w, i) for w, i in zip(words, part.column(0).to_pylist(), strict=True)]
                columns = list(zip(*_measured(words, least), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, common._ARROW[t]) for c, (_, t) in zip(columns, FIELDS, strict=True)]], names=["doc_id", *[n for n, _ in FIELDS]])

    schema = f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in FIELDS)
    return common.in_arrow(plain, run, schema)


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a periodic end where crc32 of the id is divisible by ten, as the query states it; without an id as they are."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(common.table(spark, sf_dir, "documents"), edit=planted)
