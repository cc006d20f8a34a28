"""Quality rules (operator 4): how much of a text lies inside repeated n-grams and repeated lines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: n-gram lengths in words and the largest share of a text's word characters that duplicated n-grams of that length may hold.
LIMITS = {3: 0.40, 5: 0.35, 8: 0.30, 13: 0.20}
#: The largest share of word characters inside lines that repeat an earlier line.
LINE_LIMIT = 0.30
_SYMBOLS = b"#*$%&|<>"
_BASE = np.uint64(0x9E3779B97F4A7C15)
FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("dup_line_chars", "long"), *[(f"dup_chars_{n}", "long") for n in LIMITS]]


def _code_points(piece: bytes) -> int:
    return len(piece) if piece.isascii() else len(piece.decode("utf-8", "replace"))


def covered(hashes: np.ndarray, n: int, size: int) -> np.ndarray | None:
    """Which of `size` words lie in an n-gram (hash for each start) that occurs twice or more; None if no word does."""
    ordered = np.sort(hashes)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return None
    starts = np.flatnonzero(np.isin(hashes, again))
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: bytes, lengths: tuple[int, ...] = tuple(LIMITS)) -> list[int]:
    """Counts of one text in the order of FIELDS."""
    words = text.split()
    size = len(words)
    joined = b"".join(words)
    chars = _code_points(joined)
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    dup_lines = dup_line_chars = 0
    for line in text.split(b"\n"):
        if line.strip():
            if line in seen:
                dup_lines += 1
                dup_line_chars += _code_points(b"".join(line.split()))
            seen.add(line)
    repeat, dup = 0, [0] * len(lengths)
    if size > min(lengths):
        ids = np.fromiter(map(hash, words), np.int64, size).view(np.uint64)
        weights = None
        gram = ids
        for n in range(2, min(size, max(lengths)) + 1):
            gram = gram[:-1] * _BASE + ids[n - 1 :]  # the hash of n words from that of n - 1
            if n in lengths or n == 8:
                inside = covered(gram, n, size)
                if inside is None:
                    break  # a longer n-gram can't repeat either
                if n == 8:
                    repeat = int(inside.sum())
                if n in lengths:
                    if weights is None:
                        weights = np.fromiter(map(len if joined.isascii() else _code_points, words), np.int64, size)
                    dup[lengths.index(n)] = int(weights[inside].sum())
    return [size, chars, symbols, dup_lines, repeat, dup_line_chars, *dup]


def _start():
    return lambda texts: list(zip(*[measure(t) for t in texts], strict=True))


def repetition(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds the counts of FIELDS to each row; whole texts, row by row, no shuffle.

    n-gram hashes roll from length to length (64 bits, modulo 2^64), and characters are code points of words. A null or
    empty text has zero everywhere. Rows, null ids and repeated rows stay as they are; extra columns follow `keep`.
    """
    return common.add_columns(docs, FIELDS, _start, text, keep)


def verdict(measured: DataFrame, limits: dict[int, float] = LIMITS, line_limit: float = LINE_LIMIT) -> DataFrame:
    """Adds base_failed and kept: kept only where the base rules hold and no coverage is over its limit."""
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    within = F.col("dup_line_chars") <= line_limit * chars
    for n, most in limits.items():
        within = within & (F.col(f"dup_chars_{n}") <= most * chars)
    return measured.withColumns({"base_failed": failed, "kept": ~failed & within})


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict(repetition(common.table(spark, sf_dir, "documents"), keep=["doc_id"]))


def op4_sql() -> str:
    """DuckDB SQL for op4_quality_rules, with n-grams as texts instead of hashes."""
    space = r"[\x20\x09-\x0D]"
    parts = [f"""w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM w),
lines AS (SELECT doc_id, line, count(*) AS k, length(regexp_replace(line, '{space}+', '', 'g')) AS c FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, line),
dups AS (SELECT doc_id, sum(k - 1)::BIGINT AS n_dup_lines, sum((k - 1) * c)::BIGINT AS dup_line_chars FROM lines GROUP BY doc_id),
chars AS (SELECT doc_id, sum(length(word))::BIGINT AS word_chars FROM words GROUP BY doc_id)"""]
    for n in LIMITS:
        parts.append(f"""g{n} AS (SELECT doc_id, pos, array_to_string(w[pos : pos + {n - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n} + 2)) AS pos FROM w)),
c{n} AS (SELECT doc_id, count(*) AS n_words, sum(length(word))::BIGINT AS n_chars FROM (SELECT DISTINCT doc_id, pos + unnest(range({n})) AS pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g{n}) WHERE k > 1) JOIN words USING (doc_id, pos) GROUP BY doc_id)""")
    counts = ", ".join(f"coalesce(c{n}.n_chars, 0)::BIGINT AS dup_chars_{n}" for n in LIMITS)
    joins = " ".join(f"LEFT JOIN c{n} ON c{n}.doc_id = w.doc_id" for n in LIMITS)
    within = " AND ".join(f"dup_chars_{n} <= {most} * greatest(word_chars, 1)" for n, most in LIMITS.items())
    return f"""WITH {', '.join(parts)},
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(c8.n_words, 0)::BIGINT AS n_repeat_words, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars, {counts}
FROM w LEFT JOIN chars ON chars.doc_id = w.doc_id LEFT JOIN dups ON dups.doc_id = w.doc_id {joins}),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND dup_line_chars <= {LINE_LIMIT} * greatest(word_chars, 1) AND {within} AS kept FROM b"""
