"""Token counts (operator 13): lengths of encoded texts, without keeping an id."""

from __future__ import annotations

import re

import public_tokenizers
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from . import common

MODEL, LIMIT = "piece_bpe_32k.model", 4096
#: Texts are encoded in units; a unit over LONG characters is cut again, and one over SHORT isn't remembered.
SHORT, LONG = 40, 2048
#: Characters of remembered units in a worker process, after which it starts anew.
MEMO_CHARS = 12 << 20
_SPACE = "▁"  # what sentencepiece writes for a space
_UNIT = re.compile(rf"[ {_SPACE}]+[^ {_SPACE}\n]*|\n[^ {_SPACE}\n]*|[^ {_SPACE}\n]+")
_counters: dict[str, Sentences | Json] = {}


class Sentences:
    """Counts by a sentencepiece BPE model.

    Merging makes pieces of the vocabulary only, so two neighbouring characters that are side by side in no piece are
    never joined, and a text may be cut between them: what is left and right of the cut is encoded alone. With a model
    whose normalizer changes texts, or that joins words, texts are encoded whole.
    """

    def __init__(self, path: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.pairs = {p.piece[i : i + 2] for p in model.pieces for i in range(len(p.piece) - 1)}
        n, t = model.normalizer_spec, model.trainer_spec
        plain = not n.precompiled_charsmap and not n.remove_extra_whitespaces and n.escape_whitespaces and not t.treat_whitespace_as_suffix and t.model_type == t.BPE and t.byte_fallback
        self.cuts = plain and all(p[1] not in f"{_SPACE} \n" or p == _SPACE * 2 for p in self.pairs)
        self.prefix = " " if self.cuts and n.add_dummy_prefix else ""
        if self.cuts:
            n.add_dummy_prefix = False  # given by hand, to the first unit alone
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.forget()

    def forget(self) -> None:
        self.held = 0
        self.words: dict[str, int] = {}  # words after one space, and words after a line end with it
        self.units: dict[str, int] = {}  # units as they stand

    def _parts(self, unit: str) -> list[str]:
        """A long unit cut near each LONG characters, between two characters that no piece has side by side."""
        out, start = [], 0
        at = LONG
        while at < len(unit):
            if unit[at - 1 : at + 1].replace(" ", _SPACE) in self.pairs:
                at += 1
            else:
                out.append(unit[start:at])
                start, at = at, at + LONG
        return [*out, unit[start:]]

    def _encoded(self, units: list[str]) -> list[int]:
        if max(map(len, units)) <= LONG:
            return list(map(len, self.model.encode(units, num_threads=1)))
        return [sum(map(len, self.model.encode(self._parts(u), num_threads=1))) if len(u) > LONG else len(self.model.encode(u)) for u in units]

    def _learn(self, memo: dict[str, int], new: list[str], implied: str) -> list[str]:
        """Remembers the counts of new units; returns the long ones, to be forgotten after use."""
        memo.update(zip(new, self._encoded([w if w[:1] == "\n" else implied + w for w in new]), strict=True))
        self.held += sum(map(len, new)) + 8 * len(new)
        return [w for w in new if len(w) > SHORT]

    def __call__(self, texts: list[bytes]) -> list[int]:
        whole = [t.decode("utf-8", "replace") for t in texts]
        if not self.cuts:
            return [len(self.model.encode(t)) for t in whole]
        if self.held > MEMO_CHARS:
            self.forget()
        by_word, split = [], []
        for t in whole:
            # a text with single spaces alone, and none beside a line end, is cut by str.split
            simple = bool(self.prefix and t) and t[0] not in " \n" and t[-1] != " " and "  " not in t and " \n" not in t and _SPACE not in t
            by_word.append(simple)
            split.append(t.replace("\n", " \n").split(" ") if simple else _UNIT.findall(self.prefix + t) if t else [])
        long = []
        for memo, kind in ((self.words, True), (self.units, False)):
            new = list(set().union(*[s for s, k in zip(split, by_word, strict=True) if k is kind]) - memo.keys())
            if new:
                long += [(memo, w) for w in self._learn(memo, new, " " if kind else "")]
        out = [sum(map((self.words if k else self.units).__getitem__, s)) for s, k in zip(split, by_word, strict=True)]
        for memo, w in long:
            del memo[w]
            self.held -= len(w) + 8
        return out


class Json:
    """Counts by a tokenizer of the tokenizers library: whole texts, which it cuts itself before it merges."""

    def __init__(self, path: str):
        self.model = tokenizers.Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def __call__(self, texts: list[bytes]) -> list[int]:
        return list(map(len, self.model.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)))


def counter(path: str) -> Sentences | Json:
    """One for each worker process, which serves several tasks; what it remembers is bounded."""
    if path not in _counters:
        _counters[path] = Sentences(path) if path.endswith(".model") else Json(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (more than `limit` tokens) to each row; no shuffle, whole texts.

    `path` is a sentencepiece `.model` or a `.json` of the tokenizers library that every executor can read. Arrow batches
    and the blocks that are encoded at once are bounded in bytes. A null or empty text has 0 bytes and 0 tokens. Very long
    texts are cut at boundaries that no piece spans, so counts are those of the whole text. Rows, null ids and repeated
    rows stay as they are; a column that has a new one's name gives way, others in `keep` (all by default) stay.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != "over_limit"]
    counted = common.add_columns(docs, [("n_bytes", "long"), ("n_tokens", "long")], lambda: lambda texts: [list(map(len, texts)), counter(path)(texts)], text, keep)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL), keep=["doc_id"])
