"""The hunk query equals its SQL where ids repeat, texts are empty, or lines look like parts of a patch."""

import collections

import duckdb

from logloom.plans import catalog

ROWS = [
    (0, ""), (1, "\n"), (1, "a\n-- b\nc"), (0, "a\n-- b\nc"), (3, "-- a"), (4, "x\r\nx\nx"), (5, "y\f\ny\nz"), (6, "one\ntwo\n"), (6, "three\nfour\nthree"), (7, "same\nq"), (7, "same\nq"), (None, "n\nm"),
    (-5, "a\nb\nc"), (-4, "a\nb\nc"), (-3, "a\nb\nc\nd"), (-9, "a\nb\nc\nd\ne"), (8, None), (9, "p\n\n"), (9, "+++ b/x\n--- y\n@@ z"), (11, "u\n--- v\n+++ w"), (12, "t \nt\t\ns\nt\nt"), (13, "k\x0b\nk"), (14, "\r\n"), (16, "g\n@@ h"), (18, " \n \n"), (20, "i\r\nj\ni\nj"),
]


def test_odd_documents_as_in_sql(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["q_hunk_anchors"](spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = db.execute(catalog.oracle_sql()["q_hunk_anchors"]).fetchall()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want) and len(want) == 24
