"""A training corpus from raw documents: toxic ones go, then unknown languages, then near-duplicates; the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next one's
docs. Stages before the last keep the columns of `documents`, extra ones included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import common, language, neardup, packing, toxicity

#: Documents go at this toxicity, and below this pooled probability of their language.
TOXIC, LEAST_LANGUAGE = 0.5, 0.4
#: Near-duplicates share so many hundredths of their shingles of so many words.
PERCENT, WIDTH = 80, 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below TOXIC; the model is fitted on `labels` (a bounded sample), the score on every text."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    score = common.fresh(docs, "_toxicity")
    return toxicity.toxicity(docs, model, score).filter(F.col(score) < TOXIC).drop(score)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose likeliest language has a pooled probability of LEAST_LANGUAGE or more.

    Where no row has a language that can be learned, nothing can be judged: every document with a letter stays.
    """
    net = language.train(docs)
    if not net.languages:
        letter = common.fresh(docs, "_letter")
        return common.add_columns(docs, [(letter, "boolean")], lambda: lambda texts: [[language.has_letter(t) for t in texts]]).filter(letter).drop(letter)
    found, score = common.fresh(docs, "_language"), common.fresh(docs, "_certainty")
    told = language.language(docs, net, found, score)
    return told.filter((F.col(found) != language.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE)).drop(found, score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id; documents without an id stay."""
    linked = neardup.near_duplicates(docs, WIDTH, PERCENT)
    gone = linked.filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in sequences of packing.LENGTH tokens: a row for each piece."""
    return packing.pack(packing.pieces(docs, packing.default_tokenizer()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language_id", keep_languages),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack),
]

#: Trained models and a tokenizer stand in the stages: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
