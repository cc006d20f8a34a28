"""LM scoring (operator 3): a log-bilinear model over words, trained with noise-contrastive estimation in numpy.

log10 P(text) = sum over tokens of log10 P(class | words before) + log10 P(word | class, words before). Both factors are
log-bilinear in the vectors of the words before, normalised over all classes and over all entries of the class by matrix
products. The entries of a class are its frequent words, one by one, and one for all of its other words, which share its
probability by their counts over the whole training corpus (one more share is for words that it doesn't hold).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

END = b""
#: Words whose counts every task knows (the most frequent, at most so many); counts of all others are joined.
HOT = 1 << 17
#: Words that are entries of their own and get a class from the words around them, frequent words that are counted
#: around them, and classes.
CLUSTERED, AROUND, CLASSES = 16_384, 32, 128
#: Classes of the most frequent words hold one word each. So many words have a vector of their own as context, others their class's.
SINGLE, CONTEXT_WORDS = 32, 1024
CONTEXT, DIMENSIONS, NOISE, BATCH, RATE = 4, 24, 48, 2048, 0.1
#: Noise entries of a class, and tokens that its entries are trained on at once.
WORD_NOISE, WORD_BATCH = 24, 1 << 15
#: Documents that the model starts from before it is trained on the whole corpus, and their most tokens.
WARM_DOCUMENTS, WARM_TOKENS, WARM_ROUNDS = 1500, 20_000, 3
#: All training rows are dealt to shards of about so many tokens; each round trains a copy a shard on a part of its rows, then averages.
SHARD_TOKENS, ROUNDS = 2_000_000, 2
#: Different words that a task counts before it hands the counts on.
HELD_WORDS = 300_000


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (binary; the end of a text is empty), c: over all rows, counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for _, texts in common.blocks(b, text):
                for t in texts:
                    held.update(tokens(t))
                held[END] += len(texts)
                if len(held) > HELD_WORDS:
                    yield batch()
        yield batch()

    return common.in_arrow(docs.select(text), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words with at least some count, most frequent first: as many as are at most `most`. The driver sees no others."""
    step = F.floor(F.log2("c") * 16)
    buckets = sorted(((int(r[0]), r[1]) for r in counts.groupBy(step.alias("k")).agg(F.count("*")).collect()), reverse=True)  # some hundreds
    least, held = None, 0
    for k, n in buckets:
        if held + n > most:
            break
        least, held = k, held + n
    if least is None:
        return []
    rows = counts.filter(step >= least).toArrow()
    return sorted(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


class Codes(dict):
    """Words to codes: the rank of a HOT word, or else a group of words with the same last bytes.

    Groups are the last four, or else two, bytes that the first CLUSTERED words have; all other words fall into
    ODD groups by their length.
    """

    ODD = 16

    def __init__(self, ranked: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(ranked))
        self.hot = len(ranked)
        self.groups: dict[bytes, int] = {}
        for n in (4, 2):
            for w in ranked[:CLUSTERED]:
                if w:
                    self.groups.setdefault(w[-n:], self.hot + self.ODD + len(self.groups))
        self.size = self.hot + self.ODD + len(self.groups)

    def group(self, word: bytes) -> int:
        found = self.groups.get(word[-4:])
        if found is None:
            found = self.groups.get(word[-2:])
        return self.hot + len(word) % self.ODD if found is None else found

    def __missing__(self, word: bytes) -> int:
        return self.group(word)


def encode(docs: DataFrame, ranked: list[tuple[bytes, int]], name: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """A written table with a row for each row of docs: id, row, h, n_tokens, seen, sums, codes, rare, times.

    Texts are read and split here only. h: a hash of id and text, the same however rows are dealt; codes: of all tokens, as
    32-bit numbers; seen and sums: how many tokens are HOT words, and the sum of their log10(count + 1); rare and
    times: the other words.
    """
    logs = np.log10(np.array([c + 1 for _, c in ranked] or [1], float))
    words = [w for w, _ in ranked]

    def start():
        code = Codes(words)

        def work(texts):
            split = [[*tokens(t), END] for t in texts]
            size = np.array([len(s) for s in split])
            flat = np.fromiter((c for s in split for c in map(code.__getitem__, s)), np.int32, size.sum())
            ends = np.cumsum(size)
            hot = flat < code.hot
            sums = np.add.reduceat(np.where(hot, logs[np.where(hot, flat, 0)], 0.0), ends - size)
            seen = np.add.reduceat(hot.astype(np.int64), ends - size)
            rare = [Counter() for _ in split]
            at = np.flatnonzero(~hot)
            owner = np.searchsorted(ends, at, "right")
            for o, k in zip(owner.tolist(), (at - (ends - size)[owner]).tolist(), strict=True):
                rare[o][split[o][k]] += 1
            codes = [flat[e - n : e].tobytes() for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
            return [size, seen, sums, codes, [list(x.keys()) for x in rare], [list(x.values()) for x in rare]]

        return work

    h = F.xxhash64(F.col(id_column), F.col(text)).alias("h")
    frame = docs.select(F.col(id_column).alias("id"), h, F.col(text).alias("text")).withColumn("row", F.monotonically_increasing_id())
    fields = [("n_tokens", "long"), ("seen", "long"), ("sums", "double"), ("codes", "binary"), ("rare", "array<binary>"), ("times", "array<long>")]
    return common.written(common.add_columns(frame, fields, start, "text", ["id", "row", "h"]), name)


def _codes(batch: pa.RecordBatch, column: str = "codes") -> list[np.ndarray]:
    return [np.frombuffer(c.as_buffer(), np.int32) for c in batch.column(column)]


def around_counts(encoded: DataFrame, words: int, around: int) -> np.ndarray:
    """(words, around): how often each of the first words has one of the first `around` right before it or two before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((words, around), np.int64)
        flat = total.reshape(-1)
        for b in batches:
            for ids in _codes(b):
                for gap in (1, 2):
                    x, y = ids[gap:], ids[:-gap]
                    keep = (x < words) & (y < around)
                    at, n = np.unique(x[keep].astype(np.int64) * around + y[keep], return_counts=True)
                    flat[at] += n
        rows = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(list(total[rows]), pa.list_(pa.int64()))], names=["w", "n"])

    parts = common.in_arrow(encoded.select("codes"), run, "w long, n array<long>")
    summed = parts.groupBy("w").agg(*[F.sum(F.get("n", F.lit(i))).alias(f"n{i}") for i in range(around)])
    out = np.zeros((words, around))
    for row in summed.collect():  # a row for each of the bounded words
        out[row[0]] = row[1:]
    return out


@dataclass
class Classes:
    """The class of every code, and its entry; the entries of a class stand in a row, the one of its other words last."""

    of: np.ndarray  # class of each code
    entry: np.ndarray  # entry of each code
    first: np.ndarray  # first entry of each class, and the number of entries at the end
    context: np.ndarray  # the vector that each code has as a context
    contexts: int

    @classmethod
    def build(cls, ranked: list[bytes], clustered: np.ndarray, number: int, single: int) -> Classes:
        """clustered: the class of each of the first words. Others get the class that most of these with the same last bytes have."""
        code = Codes(ranked)
        of = single + np.arange(code.size) % max(1, number - single)
        votes: dict[int, Counter] = {}
        for w, c in zip(ranked[single:], clustered[single:].tolist(), strict=False):
            for g in {code.groups.get(w[-4:]), code.groups.get(w[-2:])} - {None}:
                votes.setdefault(g, Counter())[c] += 1
        for g, v in votes.items():
            of[g] = min(v.items(), key=lambda x: (-x[1], x[0]))[0]
        of[len(clustered) : code.hot] = [of[code.group(w)] for w in ranked[len(clustered) :]]
        of[: len(clustered)] = clustered
        # entries: words of their own by class, then one for the others of a class that isn't a single word's
        order = np.argsort(clustered, kind="stable")
        own = np.bincount(clustered, minlength=number)
        several = np.arange(number) >= min(single, len(clustered))
        first = np.concatenate([[0], np.cumsum(own + several)])
        entry = first[of + 1] - 1
        within = np.arange(len(order)) - (np.cumsum(own) - own)[clustered[order]]
        entry[order] = first[clustered[order]] + within
        context = np.where(np.arange(code.size) < min(CONTEXT_WORDS, code.hot), np.arange(code.size), CONTEXT_WORDS + of)
        return cls(of, entry, first, context, CONTEXT_WORDS + number)


def cluster(around: np.ndarray, number: int, single: int, rounds: int = 12) -> np.ndarray:
    """k-means over square roots of the shares of frequent words around each word; the `single` first get their own class."""
    out = np.arange(len(around))
    rest = around[single:]
    if len(rest):
        x = np.sqrt((rest + 0.05) / (rest + 0.05).sum(1, keepdims=True)).astype(np.float32)
        k = max(1, min(number - single, len(rest)))
        centre = x[np.linspace(0, len(rest) - 1, k).astype(int)].copy()
        for _ in range(rounds):
            near = np.concatenate([(x[i : i + 4096] @ centre.T * 2 - (centre * centre).sum(1)).argmax(1) for i in range(0, len(x), 4096)])
            for j in range(k):
                if (near == j).any():
                    centre[j] = x[near == j].mean(0)
        out[single:] = single + near
    return out


@dataclass
class LogBilinear:
    """Scores of the next class: (sum of context vectors, each scaled by its place) times output vectors, plus a bias."""

    R: np.ndarray  # contexts, dimensions
    C: np.ndarray  # places, dimensions
    Q: np.ndarray  # classes, dimensions: of the next class
    b: np.ndarray
    gains: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, prior: np.ndarray, contexts: int | None = None, seed: int = 3) -> LogBilinear:
        rng = np.random.default_rng(seed)
        n = len(prior)
        return cls(rng.normal(0, 0.1, (contexts or n, DIMENSIONS)), np.full((CONTEXT, DIMENSIONS), 1 / CONTEXT) + rng.normal(0, 0.02, (CONTEXT, DIMENSIONS)), rng.normal(0, 0.1, (n, DIMENSIONS)), np.log(prior))

    def summed(self, contexts: np.ndarray) -> np.ndarray:
        """(tokens, dimensions): the context vectors, each scaled by its place, added up."""
        R, C = self.R.astype(np.float32), self.C.astype(np.float32)
        out = np.empty((len(contexts), R.shape[1]), np.float32)
        for i in range(0, len(out), 4096):  # what fits the caches
            x = np.ascontiguousarray(contexts[i : i + 4096].T)
            r = R.take(x[0], 0, mode="clip") * C[0]
            for j in range(1, CONTEXT):
                near = R.take(x[j], 0, mode="clip")
                near *= C[j]
                r += near
            out[i : i + 4096] = r
        return out

    def train(self, contexts: np.ndarray, target: np.ndarray, prior: np.ndarray, rng: np.random.Generator) -> None:
        """One pass of Adagrad steps on the noise-contrastive objective; noise classes are shared by a batch."""
        n = len(self.b)
        R, Q, C, b = (np.ascontiguousarray(v, np.float32) for v in (self.R, self.Q, self.C, self.b))
        if not self.gains:
            self.gains = {k: np.full(v.shape, 1e-2, np.float32) for k, v in (("R", R), ("C", C), ("Q", Q), ("b", b))}
        log_noise = np.log(prior * NOISE).astype(np.float32)
        edges = np.cumsum(prior)
        for i in range(0, len(target), BATCH):
            x, y = np.ascontiguousarray(contexts[i : i + BATCH].T), target[i : i + BATCH]
            size = len(y)
            near = [R.take(x[j], 0, mode="clip") for j in range(CONTEXT)]  # batch, dimensions
            r = sum(near[j] * C[j] for j in range(CONTEXT))
            noise = np.searchsorted(edges, rng.random(NOISE)).clip(0, n - 1)
            q, qn = Q[y], Q[noise]
            own = np.einsum("nd,nd->n", r, q) + b[y] - log_noise[y]
            down = r @ qn.T  # half of the noise's log-odds, then -P(data | noise)
            down += b[noise] - log_noise[noise]
            down *= 0.5
            np.tanh(down, out=down)
            down += 1
            down *= -0.5
            up = 0.5 - 0.5 * np.tanh(0.5 * own)  # 1 - P(data | own)
            dr = (up[:, None] * q + down @ qn) / size
            dR, dQ = np.zeros_like(R), np.zeros_like(Q)
            _add_rows(dR, x.ravel(), np.concatenate([dr * C[j] for j in range(CONTEXT)]))
            _add_rows(dQ, y, up[:, None] * r)
            np.add.at(dQ, noise, down.T @ r)
            db = np.bincount(y, up, n)
            np.add.at(db, noise, down.sum(0))
            dC = np.stack([np.einsum("nd,nd->d", dr, near[j]) for j in range(CONTEXT)])
            for k, v, g in (("R", R, dR), ("C", C, dC), ("Q", Q, dQ / size), ("b", b, (db / size).astype(np.float32))):
                self.gains[k] += g * g
                v += RATE * g / np.sqrt(self.gains[k])
        self.R, self.Q, self.C, self.b = R, Q, C, b

    def log_probabilities(self, contexts: np.ndarray, target: np.ndarray, r: np.ndarray | None = None) -> np.ndarray:
        """Natural logarithms, normalised over all classes."""
        r = self.summed(contexts) if r is None else r
        return _chosen(self.Q.astype(np.float32), self.b.astype(np.float32), r, target)


def _add_rows(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds each row to the row of `total` at its place."""
    order = np.argsort(at.astype(np.int16 if len(total) < 1 << 15 else np.int32), kind="stable")
    sorted_ = at[order]
    first = np.flatnonzero(np.diff(sorted_, prepend=-1))
    total[sorted_[first]] += np.add.reduceat(rows.take(order, 0, mode="clip"), first, 0)


def _chosen(Q: np.ndarray, b: np.ndarray, r: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Logarithms of the softmax of r Q + b at the targets; r: tokens, dimensions."""
    out = np.empty(len(target))
    step = max(256, (1 << 18) // max(1, len(b)))
    turned = np.ascontiguousarray(Q.T)
    for i in range(0, len(target), step):
        y = target[i : i + step]
        z = r[i : i + step] @ turned
        z += b
        chosen = z[np.arange(len(y)), y].astype(np.float64)
        most = float(z.max(initial=0.0))
        if most > 60:  # beyond what single precision can add up
            z -= most
        np.exp(z, out=z)
        out[i : i + step] = chosen - np.log(z.sum(1) + 1e-37) - (most if most > 60 else 0.0)
    return out


@dataclass
class Within:
    """Scores of the entries of each class, by the same context vectors."""

    Q: np.ndarray  # entries, dimensions
    b: np.ndarray
    first: np.ndarray
    gains: dict[str, np.ndarray] = field(default_factory=dict)

    def parts(self, classes: np.ndarray) -> list[tuple[int, int, int]]:
        """(class, first, end) of the runs of equal classes, those with several entries; classes are sorted."""
        edges = np.append(np.flatnonzero(np.diff(classes, prepend=-1)), len(classes)).tolist()
        found = [(int(classes[a]), a, z) for a, z in zip(edges, edges[1:], strict=False)]
        return [x for x in found if self.first[x[0] + 1] - self.first[x[0]] > 1]

    def train(self, r: np.ndarray, classes: np.ndarray, entries: np.ndarray, prior: np.ndarray, rng: np.random.Generator) -> None:
        """An Adagrad step on all tokens; noise entries are drawn from each class's own and shared by its tokens."""
        if not self.gains:
            self.gains = {"Q": np.full(self.Q.shape, 1e-2, np.float32), "b": np.full(self.b.shape, 1e-2, np.float32)}
        order = np.argsort(entries.astype(np.int16 if len(self.b) < 1 << 15 else np.int32), kind="stable")  # and so by class
        order = order[(np.diff(self.first) > 1)[classes[order]]]
        x, k, e = r[order], classes[order], entries[order]
        if not len(e):
            return
        less = np.log(prior * WORD_NOISE).astype(np.float32)
        # the shares of a class's entries add up to 1, so class k's stand between k and k + 1
        above = np.cumsum(prior)
        above = above - np.repeat((above - prior)[self.first[:-1].clip(max=len(prior) - 1)], np.diff(self.first)) + np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        noise = np.searchsorted(above, np.arange(len(self.first) - 1)[:, None] + rng.random((len(self.first) - 1, WORD_NOISE)))
        noise = noise.clip(self.first[:-1, None], (self.first[1:, None] - 1).clip(min=0)).clip(max=len(prior) - 1)
        up = 0.5 - 0.5 * np.tanh(0.5 * (np.einsum("nd,nd->n", x, self.Q[e]) + self.b[e] - less[e]))
        down = np.empty((len(e), WORD_NOISE), np.float32)
        parts = self.parts(k)
        offset = self.b[noise] - less[noise]
        for c, a, z in parts:
            down[a:z] = x[a:z] @ self.Q[noise[c]].T + offset[c]
        down *= 0.5
        np.tanh(down, out=down)
        down += 1
        down *= -0.5
        dQ, db = np.zeros_like(self.Q), np.zeros_like(self.b)
        share = (1 / np.bincount(k, minlength=len(self.first) - 1).clip(1)).astype(np.float32)  # a class's mean
        first = np.flatnonzero(np.diff(e, prepend=-1))
        dQ[e[first]] = np.add.reduceat((up * share[k])[:, None] * x, first, 0)
        db[e[first]] = np.add.reduceat(up * share[k], first)
        for c, a, z in parts:
            np.add.at(dQ, noise[c], down[a:z].T @ x[a:z] * share[c])
            np.add.at(db, noise[c], down[a:z].sum(0) * share[c])
        for name, v, g in (("Q", self.Q, dQ), ("b", self.b, db)):
            self.gains[name] += g * g
            v += RATE * g / np.sqrt(self.gains[name])

    def log_probabilities(self, r: np.ndarray, classes: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Natural logarithms, normalised over the entries of each token's class (0 where that has one entry)."""
        out = np.zeros(len(classes))
        order = np.argsort(classes.astype(np.int16), kind="stable")
        for c, a, z in self.parts(classes[order]):
            at, low, high = order[a:z], self.first[c], self.first[c + 1]
            out[at] = _chosen(self.Q[low:high], self.b[low:high], r[at], entries[at] - low)
        return out


def windows(sequences: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the CONTEXT tokens before, codes) of all tokens of several texts; before a text stand ends of texts."""
    pad = np.full(CONTEXT, end, np.int32)
    flat = np.concatenate([x for s in sequences for x in (pad, s)])
    size = np.array([len(s) for s in sequences])
    first = np.cumsum(size + CONTEXT) - size
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return np.stack([flat[at - 1 - j] for j in range(CONTEXT)], 1), flat[at]


@dataclass
class Model:
    ranked: list[tuple[bytes, int]]
    classes: Classes
    net: LogBilinear
    within: Within
    tokens: int  # N
    distinct: int  # V
    tail_log: np.ndarray  # log10 of the share in its entry of each code, but for the count of words that aren't HOT
    counts: DataFrame  # word, c: all words

    @property
    def hot(self) -> dict[bytes, int]:
        return dict(self.ranked)

    @property
    def base_log(self) -> float:
        return math.log10(self.tokens + self.distinct + 1)

    @property
    def end(self) -> int:
        return Codes([w for w, _ in self.ranked])[END]


@dataclass
class _Copy:
    """A model that is being trained: what a shard takes and gives back."""

    net: LogBilinear
    within: Within
    classes: Classes
    prior: np.ndarray
    entry_prior: np.ndarray
    end: int

    def copy(self) -> _Copy:
        same = lambda g: {k: v.copy() for k, v in g.items()}
        net = LogBilinear(self.net.R.copy(), self.net.C.copy(), self.net.Q.copy(), self.net.b.copy(), same(self.net.gains))
        return _Copy(net, Within(self.within.Q.copy(), self.within.b.copy(), self.within.first, same(self.within.gains)), self.classes, self.prior, self.entry_prior, self.end)

    def train(self, sequences: list[np.ndarray], rng: np.random.Generator) -> None:
        before, code = windows(sequences, self.end)
        order = rng.permutation(len(code))
        x, code = self.classes.context[before[order]], code[order]
        y, e = self.classes.of[code], self.classes.entry[code]
        for i in range(0, len(code), WORD_BATCH):
            part = slice(i, i + WORD_BATCH)
            self.net.train(x[part], y[part], self.prior, rng)
            self.within.train(self.net.summed(x[part]), y[part], e[part], self.entry_prior, rng)

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in (self.net.R, self.net.C, self.net.Q, self.net.b, self.within.Q, self.within.b)]).astype(float)

    def set(self, flat: np.ndarray) -> None:
        shapes = [v.shape for v in (self.net.R, self.net.C, self.net.Q, self.net.b, self.within.Q, self.within.b)]
        parts = np.split(flat, np.cumsum([math.prod(s) for s in shapes])[:-1])
        R, C, Q, b, wQ, wb = (p.reshape(s) for p, s in zip(parts, shapes, strict=True))
        self.net.R, self.net.C, self.net.Q, self.net.b = R, C, Q, b
        self.within.Q, self.within.b = wQ.astype(np.float32), wb.astype(np.float32)


#: Sums of parameters are added up as whole numbers of this fraction, so that their order doesn't matter.
_GRID = 256


def _round(encoded: DataFrame, start: _Copy, shards: int, number: int) -> None:
    """Trains a copy for each shard on the rows of this round and puts their mean, by tokens, in place of `start`.

    A row's shard and round come from its hash alone, and a shard's rows are read in the order of their hashes: the result
    doesn't depend on how rows are dealt to tasks.
    """
    mine = F.pmod(F.shiftrightunsigned("h", 33), F.lit(ROUNDS)) == number
    dealt = encoded.filter(mine).select(F.pmod("h", F.lit(shards)).alias("shard"), "h", "codes")
    tasks = max(1, min(shards, encoded.sparkSession.sparkContext.defaultParallelism * 2))
    dealt = dealt.repartition(tasks, "shard").sortWithinPartitions("shard", "h", "codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen_all = None, 0
        shard, copy, rng, held, size, seen = None, None, None, [], 0, 0

        def train():
            nonlocal held, size, seen
            if held:
                copy.train(held, rng)
                seen += size
            held, size = [], 0

        def close():
            nonlocal total, seen_all, seen
            train()
            if seen:
                own = np.rint(copy.flat() * (seen * _GRID)).astype(np.int64)
                total = own if total is None else total + own
                seen_all += seen
            seen = 0

        for b in batches:
            for at, codes in zip(b.column(0).to_pylist(), _codes(b), strict=True):
                if at != shard:
                    close()
                    shard, copy, rng = at, start.copy(), np.random.default_rng([number, at])
                held.append(codes.copy())
                size += len(codes)
                if size >= 4 * WORD_BATCH:
                    train()
        close()
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total) + 1), pa.int64()), pa.array(np.append(total, seen_all))], names=["i", "x"])

    rows = common.in_arrow(dealt, run, "i long, x long").groupBy("i").agg(F.sum("x").alias("x")).toArrow()  # a row for each parameter
    if rows.num_rows:
        x = np.zeros(rows.num_rows)
        x[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
        start.set(x[:-1] / (x[-1] * _GRID))


def vocabulary(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[tuple[bytes, int]]]:
    """Counts of all words of all rows (a written table: word, c), and the most frequent ones with theirs."""
    counts = common.written(word_counts(docs, text), "words")
    return counts, frequent(counts, HOT)


def fit(encoded: DataFrame, counts: DataFrame, ranked: list[tuple[bytes, int]]) -> Model:
    """Counts and the network cover all rows of `encoded`; what the driver holds is bounded by the parameters above.

    The network starts from a bounded sample, then all rows train copies of it, shard by shard, which are averaged.
    An empty table gives a model by counts alone.
    """
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words = [w for w, _ in ranked]
    several = min(CLUSTERED, len(words))
    single = min(SINGLE, several)
    around = around_counts(encoded, several, min(AROUND, max(1, several))) if several else np.zeros((0, 1))
    classes = Classes.build(words, cluster(around, CLASSES, single), CLASSES, single)
    entries, size = int(classes.first[-1]), len(classes.of)

    def tally(batches):
        code = Codes(words)
        n, v = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for b in batches:
            ids = np.fromiter(map(code.__getitem__, b.column(0).to_pylist()), np.int64, b.num_rows)
            np.add.at(n, ids, b.column(1).to_numpy())
            v += np.bincount(ids, minlength=size)
        at = np.flatnonzero(v[len(words) :]) + len(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(v[at])], names=["k", "n", "v"])

    n, v = np.zeros(size), np.zeros(size)  # of each code
    n[: len(words)], v[: len(words)] = [c for _, c in ranked], 1
    for row in common.in_arrow(counts.select("word", "c"), tally, "k long, n long, v long").groupBy("k").agg(F.sum("n"), F.sum("v")).collect():
        n[row[0]], v[row[0]] = row[1], row[2]
    held, kinds = np.bincount(classes.entry, n, entries), np.bincount(classes.entry, v, entries)
    prior = np.bincount(classes.of, n, CLASSES) + 1
    start_of = classes.first[:-1]
    entry_prior = held + 1
    shares = np.maximum(np.add.reduceat(np.append(entry_prior, 0), np.minimum(start_of, entries)), 1e-9)
    entry_prior = entry_prior / np.repeat(shares, np.diff(classes.first))
    # a word of its own has all of its entry; others share it by their counts, and one part is for words that it doesn't hold
    share = -np.log10(held + kinds + 1)[classes.entry]
    share[: len(words)] += np.log10(np.array([c for _, c in ranked] or [0][:0], float) + 1)
    share[:several] = 0.0
    prior = prior / prior.sum()
    copy = _Copy(LogBilinear.fresh(prior, classes.contexts), Within(np.zeros((entries, DIMENSIONS), np.float32), np.log(entry_prior).astype(np.float32), classes.first), classes, prior, entry_prior, Codes(words)[END])
    sample = [x for b in encoded.filter(F.col("n_tokens") <= WARM_TOKENS).select("h", "codes").orderBy("h", "codes").limit(WARM_DOCUMENTS).toArrow().to_batches() for x in _codes(b)]
    if sample:
        rng = np.random.default_rng(5)
        for _ in range(WARM_ROUNDS):
            copy.train(sample, rng)
        shards = -(-int(total) // SHARD_TOKENS)
        for number in range(ROUNDS):
            _round(encoded, copy, shards, number)
    return Model(ranked, classes, copy.net, copy.within, int(total), int(distinct), share, counts)


def train(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> Model:
    """A model of all rows of docs; see `fit`. Null and empty texts are the end of a text alone; repeated rows count each time."""
    counts, ranked = vocabulary(docs, text)
    return fit(encode(docs, ranked, "encoded", text, id_column), counts, ranked)


def score_encoded(encoded: DataFrame, model: Model, id_column: str = "doc_id") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score of every row that was encoded with the model's vocabulary."""
    net, within, classes, tail_log, end = model.net, model.within, model.classes, model.tail_log, model.end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, first = _codes(b), 0
            sums = np.zeros(len(rows))
            while first < len(rows):  # some tokens at a time; a text is whole
                last, held = first, 0
                while last < len(rows) and (last == first or held + len(rows[last]) <= 8 * WORD_BATCH):
                    held += len(rows[last])
                    last += 1
                before, code = windows(rows[first:last], end)
                r, y = net.summed(classes.context[before]), classes.of[code]
                p = (net.log_probabilities(None, y, r) + within.log_probabilities(r, y, classes.entry[code])) / math.log(10) + tail_log[code]
                size = np.array([len(x) for x in rows[first:last]])
                sums[first:last] = np.add.reduceat(p, np.cumsum(size) - size)
                first = last
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(5)], pa.array(sums)], names=["id", "row", "n_tokens", "seen", "sums", "likely"])

    inner = encoded.select("id", "row", "n_tokens", "seen", "sums", "codes")
    told = common.in_arrow(inner, run, inner.drop("codes").withColumn("likely", F.lit(0.0)).schema)
    rare = encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    held = rare.join(model.counts, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_sum"))
    joined = told.join(held, "row", "left")
    rare_sum = F.coalesce("rare_sum", F.lit(0.0))
    return joined.select(
        F.col("id").alias(id_column),
        "n_tokens",
        (F.col("seen") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("sums") + rare_sum - F.col("n_tokens") * model.base_log).alias("base_score"),
        (F.col("likely") + rare_sum).alias("score"),
    )


def score(docs: DataFrame, model: Model, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score of every row; whole texts.

    Counts of the frequent words are known in every task; other words are joined with their counts. Null and empty texts
    hold the end only. Rows that share an id are scored one by one; an empty table has no scores.
    """
    return score_encoded(encode(docs, model.ranked, "encoded", text, id_column), model, id_column)


def training(column: str = "doc_id") -> Column:
    return F.coalesce(common.fold(column, 7) != 2, F.lit(True))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    counts, ranked = vocabulary(docs.filter(training()))
    encoded = encode(docs, ranked, "encoded")
    model = fit(encoded.filter(training("id")), counts, ranked)
    scored = score_encoded(encoded, model)
    return scored.select("doc_id", (~training()).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
