"""License windows: the choice among overlapping ones by brute force, and texts that repeat a licence line very often."""

import random

from pyspark.sql import functions as F

from logloom.llm import licenses


def test_best_windows_by_brute_force(spark):
    rng = random.Random(3)
    cases = []
    for i in range(60):
        starts = rng.sample(range(200), rng.randint(1, 120))
        cases.append((i, rng.choice([2, 5, 9, 40]), [(s, rng.choice([0.8, 0.85, 0.9, 1.0])) for s in starts]))
    rows = spark.createDataFrame(cases, "id int, words int, made array<struct<start: int, dice: double>>")
    got = {r.id: sorted((-m.before, m.dice) for m in r.m) for r in rows.select("id", licenses._best("made", F.col("words")).alias("m")).collect()}
    for i, width, made in cases:
        better = lambda y, x: abs(y[0] - x[0]) < width and (y[1], -y[0]) > (x[1], -x[0])
        assert got[i] == sorted(x for x in made if not any(better(y, x) for y in made)), (width, made)


def test_repeated_licence_lines_are_told_one_by_one(spark):
    line = licenses.TEMPLATES["MIT (line)"]
    gap = " ".join(f"word{i}" for i in range(40))
    texts = [f"{gap} {line} " * 300, f"{line} " * 20000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = licenses.scan(rows).filter("license = 'MIT (line)'").collect()
    step = len(licenses.normal_words(f"{gap} {line}"))
    assert sorted(r.place for r in found if r.doc_id == 0 and r.unit == "window") == [41 + step * i for i in range(300)]
    assert [(r.unit, r.place) for r in found if r.doc_id == 1] == [("line", 1)]
