"""Hunk headers from where the lines of a patch stand."""

from logloom.operators import hunks

SOURCE = "one\ntwo  \nsame\nthree\nsame\nfour\n"
DIFF = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@
 two
-same
+other
@@ -1,3 +1,3 @@
 same
+new
@@ garbage
-three
-same

 four
remark
@@ -9 +9 @@
 five
--- a/y.py
+++ b/y.py
@@
-same
+++ z
@@
+only new
"""


def test_hunks_move_to_their_lines(spark):
    patches = spark.createDataFrame([(1, DIFF), (2, ""), (3, None), (4, "no patch")], "id int, diff string")
    sources = spark.createDataFrame([("x.py", SOURCE), ("y.py", "same"), ("z", None)], "path string, text string")
    got = {r.id: r for r in hunks.anchored(patches, sources).collect()}
    before, after = DIFF.split("\n"), got[1].diff.split("\n")
    changed = {i: a for i, (b, a) in enumerate(zip(before, after, strict=True)) if a != b}
    # the blank line of a hunk counts on neither side; ambiguous, absent and new-only hunks keep their headers
    assert changed == {3: "@@ -2,2 +2,2 @@", 10: "@@ -4,3 +4,1 @@", 20: "@@ -1,1 +1,0 @@"} and got[1].moved == 3
    assert (got[2].diff, got[3].diff, got[4].diff) == ("", None, "no patch") and got[3].moved == got[4].moved == 0


def test_lines_in_one_place_only(spark):
    wanted = spark.createDataFrame([(1, 1, "f", ["a", "b"]), (1, 2, "f", ["b"]), (1, 3, "f", ["b", "c", "x"]), (1, 4, "f", []), (1, 5, "g", ["a"]), (1, 6, "f", ["b", "a", "b", "c"])], "id int, hunk int, path string, old array<string>")
    sources = spark.createDataFrame([("f", "a\nb\na \nb\nc"), ("h", "a")], "path string, text string")
    assert {(r.hunk, r.start) for r in hunks.found(wanted, sources, ["id", "hunk"]).collect()} == {(6, 2)}
