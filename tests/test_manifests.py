"""Versions in their order, requirements, and manifests with what they include."""

import itertools

from pyspark.sql import functions as F

from logloom.functions import versions
from logloom.operators import manifests

ASCENDING = ["1.0.dev1", "1.0a0.dev2", "1.0a", "1.0.a1", "1.0-alpha.2", "1.0b2.post1.dev1", "1.0b2.post345", "1.0rc1", "1", "1.0+abc.5", "1.0+abc.7", "1.0+5", "1.0+5.a", "1.0.post456.dev34", "1.0-456", "1.0.1", "1.1.dev1", "1.10", "v2024.1", "1!0.1"]
EQUAL = [("1", "1.0.0"), ("1.0c1", "1.0rc1"), ("1.0pre1", "1.0-RC.1"), ("1.0.post", "1.0.post0"), ("1.0-r4", "1.0.rev4"), (" v1.0+Ab_1 ", "1+ab.1"), ("1.0a", "1.0alpha0")]


def test_versions_come_in_order(spark):
    df = spark.createDataFrame(list(itertools.product(ASCENDING, ASCENDING)), "a string, b string").select("a", "b", versions.is_newer(F.col("a"), F.col("b")).alias("n"))
    assert all(r.n == (ASCENDING.index(r.b) > ASCENDING.index(r.a)) for r in df.collect())
    same = spark.createDataFrame(EQUAL, "a string, b string").select(versions.key(F.col("a")) == versions.key(F.col("b"))).collect()
    assert all(r[0] for r in same)
    odd = spark.createDataFrame([(x,) for x in ("", "x", "1..2", "1.0.*", "1.0+", "99999999999999999999", None)], "a string")
    assert odd.filter(versions.key(F.col("a")).isNotNull()).count() == 0 and odd.filter(versions.is_newer(F.col("a"), F.lit("1")).isNotNull()).count() == 0


def test_requirements_in_parts(spark):
    texts = ["a==1.0", "b[x, y] >=1,<2 ; python_version < '3.9'", "c @ https://h/x.whl", "d", "e==1.*", "f===1.0", "g ==2.0, !=2.1", "h^1.0", "-x", "i (>=1)", "j==nonsense"]
    got = [r.q and tuple(r.q) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(versions.requirement(F.col("t")).alias("q")).collect()]
    assert got == [
        ("a", None, "==1.0", None, None, "1.0"), ("b", "[x, y]", ">=1,<2", None, "python_version < '3.9'", None), ("c", None, None, "https://h/x.whl", None, None), ("d", None, None, None, None, None), ("e", None, "==1.*", None, None, None),
        ("f", None, "===1.0", None, None, None), ("g", None, "==2.0, !=2.1", None, None, None), None, None, ("i", None, ">=1", None, None, None), ("j", None, "==nonsense", None, None, None),
    ]


PROJECT = """
[project]
dependencies = ["Requests>=2", "python>=3", "pin==1.5", "not a requirement!"]
[dependency-groups]
dev = [{ include-group = "lint" }, "pytest>=8"]
lint = ["ruff>=0.4", "requests==9"]
[tool.poetry.dependencies]
python = "^3.11"
httpx = { version = "^0.27", extras = ["http2"] }
rich = ">=13"
mine = { git = "https://h/m.git", rev = "abc" }
near = { path = "../near" }
far = { url = "https://h/f.whl" }
"""


def test_manifests(spark):
    files = [
        ("a", "PyProject.toml", PROJECT), ("a", "requirements.txt", "unused==1"),
        ("b", "requirements.txt", "# top\none==1.0  # first\n-r more/base.txt\n--requirement missing.txt\n-e .\ntwo \\\n  >=2 --hash=sha256:1\nTwo==3"), ("b", "more/base.txt", "-r other.txt\nthree ; os_name == 'nt'\n-r ../requirements.txt\none==9\n-r Requirements.txt"), ("b", "more/Other.txt", "four==4\n-r base.txt\n"),
        ("c", "requirements.in", "five"), ("c", "sub/requirements.txt", "six"), ("d", "pyproject.toml", "[dependency-groups]\nx = [{include-group = 'y'}]\ny = [{include-group = 'x'}]"), ("e", "pyproject.toml", "= broken"), ("f", "setup.py", "x"), ("g", "requirements.txt", None),
    ]
    rows = manifests.dependencies(spark.createDataFrame(files, "repo string, path string, text string")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.repo, r.n)):
        got.setdefault(r.repo, []).append((r.name, r.spec, r.version))
    assert got["a"] == [("Requests", "Requests>=2", None), ("pin", "pin==1.5", "1.5"), ("pytest", "pytest>=8", None)][:2] + [("ruff", "ruff>=0.4", None), ("pytest", "pytest>=8", None), ("httpx", "httpx[http2]^0.27", None), ("rich", "rich>=13", None), ("mine", "mine @ git+https://h/m.git@abc", None), ("near", "near @ file:../near", None), ("far", "far @ https://h/f.whl", None)]
    assert got["b"] == [("one", "one==1.0", "1.0"), ("four", "four==4", "4"), ("three", "three ; os_name == 'nt'", None), ("two", "two   >=2", None)]
    assert got["c"] == [("five", "five", None)] and "f" not in got and "g" not in got
    errors = {r.repo: r.error for r in rows if r.error}
    assert "cycle" in errors["d"] and errors.keys() == {"d", "e"}
    assert {r.source for r in rows if r.repo == "a"} == {"pyproject.toml", "pyproject.toml:dependency-groups", "pyproject.toml:poetry"}


def test_newest_release(spark):
    rows = [("a", "1.9"), ("a", "1.10"), ("a", "1.10rc1"), ("a", "odd"), ("b", "odd"), ("c", "2.0"), ("c", "2")]
    assert {tuple(r) for r in manifests.newest(spark.createDataFrame(rows, "package string, version string")).collect()} == {("a", "1.10"), ("c", "2.0")}
