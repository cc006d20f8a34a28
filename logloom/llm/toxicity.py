"""Toxicity (operator 6): multiple-instance learning of sentence scores from document labels."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The bounded sample that the classifier is fitted on: labelled documents of each class at most, and their longest text in bytes.
SAMPLE_PER_CLASS = {1: 2500, 0: 5000}
SAMPLE_BYTES = 200_000
#: A feature has a weight if toxic documents hold it more often, with a likelihood ratio (twice its logarithm) of at least this.
LEAST_RATIO = 15.0
ROUNDS = 400
#: Weights are pulled towards zero by this share of themselves.
L2 = 1e-4
START_BIAS = -7.0
#: Longer words also count by their first bytes, so that forms which the sample doesn't hold are known by their stem.
STEM = 6

_ENDS = b".!?\n\r"
_TABLE = bytes(10 if c in _ENDS else (c + 32 if 65 <= c <= 90 else (c if c >= 128 or chr(c).isalnum() or c == 39 else 32)) for c in range(256))


def sentences(text: bytes) -> list[list[bytes]]:
    """Lower-cased words of each sentence (ended by . ! ? or a line break) that has one."""
    return [words for s in text.translate(_TABLE).split(b"\n") if (words := s.split())]


def features(words: list[bytes]) -> set[bytes]:
    """Distinct words, and stems of the longer ones (marked by a star, which no word holds)."""
    return {*words, *[b"*" + w[:STEM] for w in words if len(w) > STEM]}


@dataclass
class Model:
    """The log-odds of a sentence with a known feature: bias + the weights of its features. Others are never toxic.

    A text without any known feature has the log-odds `empty`, whatever its length.
    """

    bias: float
    weights: dict[bytes, float]
    empty: float = START_BIAS

    def log_odds(self, words: list[bytes]) -> float:
        known = self.weights.keys() & features(words)
        return self.bias + sum(self.weights[w] for w in known) if known else -np.inf

    def sentence_scores(self, text: bytes) -> np.ndarray:
        """One probability for each sentence; a text without words counts as one empty sentence."""
        z = np.array([self.log_odds(s) for s in sentences(text)] or [-np.inf])
        return 1 / (1 + np.exp(-z))

    def score(self, text: bytes) -> float:
        """Noisy-or: the chance that at least one sentence is toxic."""
        p = self.sentence_scores(text)
        if not p.any():
            return float(1 / (1 + np.exp(-self.empty)))
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def _chosen(texts: list[bytes], labels: list[int], least: float) -> list[bytes]:
    """Features that documents of class 1 hold significantly more often, sorted. One text's features are held at a time."""
    held: list[dict[bytes, int]] = [{}, {}]
    names: dict[bytes, bytes] = {}
    for text, y in zip(texts, labels, strict=True):
        for w in set().union(*map(features, sentences(text))):
            w = names.setdefault(w, w)
            held[y][w] = held[y].get(w, 0) + 1
    n1 = sum(labels)
    n0 = len(labels) - n1
    out = []
    for w, a in held[1].items():
        b = held[0].get(w, 0)
        expect = (a + b) * n1 / (n0 + n1)
        if a > expect:
            ratio = 2 * (a * np.log(a / expect) + (b * np.log(b / (a + b - expect)) if b else 0))
            if ratio >= least:
                out.append(w)
    return sorted(out)


def fit(texts: list[bytes], labels: list[int], rounds: int = ROUNDS, least: float = LEAST_RATIO, l2: float = L2) -> Model:
    """Full-batch Adagrad on the noisy-or log-likelihood of document labels. Only sentences with a feature are rows; a bag without one is a row of its own."""
    names = _chosen(texts, labels, least)
    if not names:
        return Model(START_BIAS, {})
    ids = {w: i for i, w in enumerate(names)}
    bags = [[row for s in sentences(t) if (row := [ids[w] for w in features(s) & ids.keys()])] or [[]] for t in texts]
    rows = [r for bag in bags for r in bag]
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    word = np.fromiter(chain.from_iterable(rows), np.int64, len(row))
    doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    bare = np.array([not r for r in rows])
    y = np.array(labels, np.float64)
    w, b, e = np.full(len(ids), 2.0), START_BIAS, START_BIAS
    gw, gb, ge = np.full(len(ids), 1e-6), 1e-2, 1e-2
    for _ in range(rounds):
        z = np.clip(np.where(bare, e, b) + np.bincount(row, w[word], len(rows)), -30, 12)
        p = 1 / (1 + np.exp(-z))
        none = np.exp(np.bincount(doc, np.log1p(-p), len(bags)))  # no sentence is toxic
        pull = np.where(y == 1, none / np.maximum(1 - none, 1e-9), -1.0)
        g = pull[doc] * p / len(bags)  # of the log-likelihood by each sentence's log-odds
        dw = np.bincount(word, g[row], len(ids)) - l2 * w / len(ids)
        db, de = g[~bare].sum(), g[bare].sum()
        gw += dw * dw
        gb += db * db
        ge += de * de
        w = w + 0.3 * dw / np.sqrt(gw)
        b = min(b + 0.3 * db / np.sqrt(gb), -4.0)
        e = min(e + 0.3 * de / np.sqrt(ge), -4.0)
    return Model(float(b), {n: float(x) for n, x in zip(names, w, strict=True)}, float(e))


def training_sample(docs: DataFrame, labels: DataFrame, column: str = "toxic", most: dict[int, int] = SAMPLE_PER_CLASS, id_column: str = "doc_id", text: str = "text") -> list[tuple[bytes, int]]:
    """(text, label) of a bounded sample of labelled rows, the same in each run: rows with the smallest hashes of their id.

    Rows with a null id, a null label or a text over SAMPLE_BYTES don't take part.
    """
    usable = labels.select(F.col(id_column).alias("_id"), F.col(column).cast("int").alias("_label")).filter("_id IS NOT NULL AND _label IN (0, 1)").dropDuplicates(["_id"])
    out = []
    for label, n in most.items():
        ids = usable.filter(F.col("_label") == label).orderBy(F.xxhash64("_id"), "_id").limit(n)  # at most n ids
        found = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).filter(F.octet_length("_text") <= SAMPLE_BYTES)
        rows = found.join(F.broadcast(ids), "_id").dropDuplicates(["_id"]).orderBy("_id").select(F.col("_text").cast("binary")).toArrow()
        out += [(t, label) for t in rows.column(0).to_pylist()]
    return out


def train(docs: DataFrame, labels: DataFrame, usable=None, id_column: str = "doc_id", text: str = "text") -> Model:
    """Fitted on rows of `labels` for which the condition `usable` holds."""
    labels = labels if usable is None else labels.filter(usable)
    sample = training_sample(docs, labels, id_column=id_column, text=text)
    return fit([t for t, _ in sample], [y for _, y in sample])


def toxicity(docs: DataFrame, model: Model, out: str = "score", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds the document's probability (0 to 1); whole texts, no shuffle. Null or empty texts score as those without a known feature."""
    return common.add_columns(docs, [(out, "double")], lambda: lambda texts: [[model.score(t) for t in texts]], text, keep)


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each sentence whose probability is at least `least`: id, sentence (its number from 0), words, score."""
    schema = T.StructType([docs.schema[id_column], T.StructField("sentence", T.IntegerType()), T.StructField("words", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, texts in common.blocks(batch, text):
                found = [(i, k, b" ".join(s).decode("utf-8", "replace"), float(p)) for i, t in enumerate(texts) for k, (s, p) in enumerate(zip(sentences(t) or [[]], model.sentence_scores(t), strict=True)) if p >= least]
                at, number, words, score = zip(*found, strict=True) if found else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(words, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return common.in_arrow(docs.select(id_column, text), run, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = train(docs, labels, common.fold("doc_id", 5) != 0)
    scored = toxicity(docs, model, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(common.fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
