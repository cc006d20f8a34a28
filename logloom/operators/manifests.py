"""Dependencies of repositories from their manifest files, includes followed, and releases in order."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as fn
from ..functions import versions
from .graph import written
from .traversal import depth_first

# Manifests in order of preference.
NAMES = ["pyproject.toml", "requirements.txt", "requirements.in"]


def _requirement_lines(files: DataFrame) -> DataFrame:
    """repo, path, n, line, include: logical lines without comments and options; include is the file that a line names."""
    joined = F.regexp_replace("text", r"\\[ \t]*\r?\n", "")
    lines = files.select("repo", "path", F.posexplode(F.split(joined, r"\r?\n")).alias("n", "l"))
    clean = F.trim(F.regexp_replace("l", r"\s+#.*$", ""))
    told = lines.withColumn("line", clean).filter((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    include = r"^(?:-r|--requirement)\s+(.+)$"
    named = F.when(F.col("line").rlike(include), F.trim(F.regexp_extract("line", include, 1)))
    told = told.withColumn("include", named).filter(F.col("include").isNotNull() | ~F.startswith("line", F.lit("-")))
    return told.select("repo", "path", "n", F.trim(F.regexp_replace("line", r"\s--hash=\S+", "")).alias("line"), "include")


def _includes(files: DataFrame, lines: DataFrame) -> DataFrame:
    """node, other, place: which file (repo and path) names which, beside itself first, else from the top; case doesn't count."""
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_extract("path", r"^(.*/)[^/]*$", 1)).otherwise("")
    named = lines.filter("include IS NOT NULL").select("repo", "path", "n", F.explode(F.array(F.struct(F.lit(0).alias("p"), F.lower(F.concat(folder, "include")).alias("low")), F.struct(F.lit(1).alias("p"), F.lower("include").alias("low")))).alias("c"))
    known = files.select("repo", F.lower("path").alias("low"), F.col("path").alias("to"))
    met = named.select("repo", "path", "n", "c.p", "c.low").join(known, ["repo", "low"]).groupBy("repo", "path", "n").agg(F.min(F.struct("p", "to")).alias("m"))
    return met.select(_file("repo", "path").alias("node"), _file("repo", "m.to").alias("other"), F.col("n").alias("place"))


def _file(repo: str, path: str):
    return F.struct(F.col(repo).alias("repo"), F.col(path).alias("path"))


def _expanded(groups: dict, entries: list, seen: tuple[str, ...] = ()) -> Iterator[str]:
    for item in entries:
        name = item.get("include-group") if isinstance(item, dict) else None
        if isinstance(name, str):
            if name in seen:
                raise ValueError(f"cycle in dependency-groups: {name}")
            if isinstance(groups.get(name), list):
                yield from _expanded(groups, groups[name], (*seen, name))
        elif isinstance(item, str):
            yield item


def _poetry(name: str, value: object) -> str | None:
    """A requirement of a name and what stands beside it: a constraint, a version, a repository, a folder or an address."""
    if isinstance(value, str):
        return f"{name}{value.strip()}" if value.strip() else None
    if not isinstance(value, dict):
        return None
    extras = value.get("extras")
    head = name + (f"[{','.join(map(str, extras))}]" if isinstance(extras, list) and extras else "")
    if isinstance(value.get("version"), str) and value["version"].strip():
        return head + value["version"].strip()
    if isinstance(value.get("git"), str):
        return f"{head} @ git+{value['git']}@{value.get('rev') or value.get('tag') or value.get('branch') or 'HEAD'}"
    if isinstance(value.get("path"), str):
        return f"{head} @ file:{value['path']}"
    return f"{head} @ {value['url']}" if isinstance(value.get("url"), str) else None


def _toml_rows(text: str) -> Iterator[tuple[str, str | None, str]]:
    """(source, name of poetry's, requirement) of a pyproject file in order; raises ValueError where it is broken."""
    import tomllib

    data = tomllib.loads(text)
    part = lambda d, k: d.get(k) if isinstance(d, dict) else None
    plain = part(data.get("project"), "dependencies")
    yield from (("pyproject.toml", None, str(x)) for x in (plain if isinstance(plain, list) else []))
    groups = data.get("dependency-groups")
    for entries in groups.values() if isinstance(groups, dict) else []:
        if isinstance(entries, list):
            yield from (("pyproject.toml:dependency-groups", None, x) for x in _expanded(groups, entries))
    table = part(part(data.get("tool"), "poetry"), "dependencies")
    for name, value in table.items() if isinstance(table, dict) else []:
        spec = _poetry(name, value)
        if spec is not None:
            yield "pyproject.toml:poetry", name, spec


def _toml(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, error = [], []
        for text in batch.column("text").to_pylist():
            try:
                out.append(json.dumps(list(_toml_rows(text or ""))))
                error.append(None)
            except ValueError as e:
                out.append("[]")
                error.append(str(e))
        yield pa.RecordBatch.from_arrays([batch.column("repo"), pa.array(out, pa.string()), pa.array(error, pa.string())], names=["repo", "rows", "error"])


def dependencies(files: DataFrame) -> DataFrame:
    """repo, n (from 1), name, canonical, spec, version, source, error: what each repository depends on (files: repo, path, text).

    A repository's pyproject.toml counts, else its requirements.txt, else its requirements.in, whatever the case, at the
    top. Requirement files are read with those that they include, in place and once (so circles end); dependency groups
    with those that they include. The first of a package counts; spec is the whole requirement, version what it pins.
    What is no requirement is left out, but for poetry's own constraints. A pyproject file that is broken, or whose groups
    include themselves, gives one row with its error.
    """
    low = F.lower("path")
    rank = F.array_position(F.array(*[F.lit(n) for n in NAMES]), low)
    top = files.filter(low.isin(NAMES)).groupBy("repo").agg(F.min(F.struct(rank.alias("r"), "path")).alias("m")).select("repo", F.col("m.path").alias("path"), F.col("m.r").alias("r"))
    toml = files.join(top.filter("r = 1").select("repo", "path"), ["repo", "path"]).select("repo", "text")
    read = toml.mapInArrow(_toml, f"repo {files.schema['repo'].dataType.simpleString()}, rows string, error string")
    rows = read.select("repo", "error", F.posexplode_outer(F.from_json("rows", "array<array<string>>")).alias("i", "x"))
    wrong = rows.filter("error IS NOT NULL").select("repo", F.array(F.lit(0)).alias("at"), F.lit(None).cast("string").alias("spec"), F.lit(None).cast("string").alias("own"), F.lit("pyproject.toml").alias("source"), "error")
    fine = rows.filter("x IS NOT NULL").select("repo", F.array("i").alias("at"), F.trim(F.col("x")[2]).alias("spec"), F.col("x")[1].alias("own"), F.col("x")[0].alias("source"), "error")
    roots = top.filter("r > 1").select("repo", "path")
    lines = written(_requirement_lines(files.join(roots.select("repo"), "repo", "left_semi")))
    places = depth_first(roots.select(_file("repo", "path").alias("root")), _includes(files, lines))
    placed = places.select(F.col("node.repo").alias("repo"), F.col("node.path").alias("path"), "at", F.col("root.path").alias("source"))
    listed = lines.filter("include IS NULL").join(placed, ["repo", "path"]).select("repo", F.concat("at", F.array(F.col("n").cast("int"))).alias("at"), F.col("line").alias("spec"), F.lit(None).cast("string").alias("own"), "source", F.lit(None).cast("string").alias("error"))
    told = written(listed.unionByName(fine))
    # requirements are much the same everywhere: each distinct one is read once
    specs = written(told.select("spec").distinct()).withColumn("q", versions.requirement(F.col("spec")))
    told = told.join(written(specs).withColumnRenamed("spec", "_s"), F.col("spec").eqNullSafe(F.col("_s")), "left").drop("_s")
    name = F.coalesce("q.name", "own")
    told = told.select("repo", "at", name.alias("name"), fn.canonical_package(name).alias("canonical"), "spec", F.col("q.version").alias("version"), "source", "error").filter("name IS NOT NULL").filter(~F.col("canonical").isin(versions.NO_PACKAGES))
    first = told.withColumn("_r", F.row_number().over(Window.partitionBy("repo", "canonical").orderBy("at"))).filter("_r = 1").drop("_r")
    whole = first.unionByName(wrong.select("repo", "at", *[F.lit(None).cast("string").alias(c) for c in ("name", "canonical", "spec", "version")], "source", "error"))
    return whole.withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy("at"))).select("repo", "n", "name", "canonical", "spec", "version", "source", "error")


def newest(releases: DataFrame, package: str = "package", version: str = "version") -> DataFrame:
    """package, version: the newest sound version of each package (of equal ones the text that comes last)."""
    # each distinct version's key once: the optimizer takes a distinct away below max, and moves filters below it, so neither is used
    known = releases.select(package, version).distinct().withColumn("_k", versions.key(F.col(version)))
    best = known.groupBy(package).agg(F.max_by(version, F.when(F.col("_k").isNotNull(), F.struct("_k", version))).alias("_m"))
    return best.filter("_m IS NOT NULL").select(package, F.col("_m").alias(version))
