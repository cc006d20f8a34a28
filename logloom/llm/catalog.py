"""Queries of the training-data operators and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, counts, language, licenses, lm, neardup, packing, periods, repetition, toxicity, variants, warc, winnow


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": winnow.op1_fingerprints,
        "op2_license_scans": licenses.op2_license_scans,
        "op3_lm_scoring": lm.op3_lm_scoring,
        "op4_quality_rules": repetition.op4_quality_rules,
        "op5_byte_bpe": bpe.op5_byte_bpe,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_near_duplicates": neardup.op7_near_duplicates,
        "op8_language_id": language.op8_language_id,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
        "op10_warc": warc.op10_warc,
        "op11_periodic_runs": periods.op11_periodic_runs,
        "op12_spelling_variants": variants.op12_spelling_variants,
        "op13_token_counts": counts.op13_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scans": licenses.op2_sql(), "op4_quality_rules": repetition.op4_sql()}
