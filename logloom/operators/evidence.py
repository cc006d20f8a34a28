"""Evidence: test reports, collector health, findings, verdicts, patches and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as fn
from .substrings import contained

# Patterns of a test report, statuses and thresholds.
RULE = r"^=+ (.+?) =+$"
BLOCK_RULE = r"^_+ (.+?) _+$"
END_OF_SUMMARY = r"^(=|!){5,}"
ENTRY = r"^(PASSED|FAILED|ERROR|SKIPPED|XFAIL|XPASS)\b[ \t]*(.*)$"
DURATION = r"^(\d+(?:\.\d+)?)s\s+(call|setup|teardown)\s+(\S+)$"
COUNTS = r"(\d+)\s+(passed|failed|error|errors|skipped|xfailed|xpassed)"
WALL = r"\bin\s+(\d+(?:\.\d+)?)s\b"
INTERRUPTED = r"(?i)Interrupted:\s*(\d+)\s+error"
STATUSES = ["confirmed", "unreproduced", "uncovered", "unlocatable", "inconclusive"]
MIN_ROWS, MAX_MISSING = 5, 0.2
RAW_TAIL = 2000


def report_lines(reports: DataFrame, key: str, text: str) -> DataFrame:
    """key, n, line (without colours and trailing blanks), section (title of the last rule above)."""
    lines = reports.select(key, F.posexplode(F.split(fn.ansi_free(F.col(text)), "\n")).alias("n", "l")).select(key, "n", F.rtrim("l").alias("line"))
    title = F.when(F.col("line").rlike(RULE), F.trim(F.regexp_extract("line", RULE, 1)))
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(title, ignorenulls=True).over(w))


def summary_cases(lines: DataFrame, key: str) -> DataFrame:
    """key, node_id, outcome, n: entries of the short summary, once for each outcome and node."""
    w = Window.partitionBy(key)
    start = F.min(F.when(F.col("line").rlike(RULE) & (F.trim(F.regexp_extract("line", RULE, 1)) == "short test summary info"), F.col("n"))).over(w)
    marked = lines.withColumn("_s", start).filter(F.col("n") > F.col("_s"))
    marked = marked.withColumn("_e", F.min(F.when(F.col("line").rlike(END_OF_SUMMARY), F.col("n"))).over(w)).filter(F.col("_e").isNull() | (F.col("n") < F.col("_e")))
    word = F.regexp_extract("line", ENTRY, 1)
    rest = F.regexp_replace(F.trim(F.regexp_extract("line", ENTRY, 2)), r"^\[\d+\]\s*", "")
    node = F.trim(F.split(rest, " - ", 2)[0])
    node = F.when(node.rlike(r"^\S+\.py:\d+:"), F.regexp_extract(node, r"^(\S+\.py):\d+:", 1)).otherwise(node)
    outcome = F.when(word == "XFAIL", "skipped").when(word == "XPASS", "passed").otherwise(F.lower(word))
    cases = marked.filter(F.col("line").rlike(ENTRY)).select(key, node.alias("node_id"), outcome.alias("outcome"), "n").filter("node_id <> ''")
    return cases.groupBy(key, "node_id", "outcome").agg(F.min("n").alias("n"))


def durations(lines: DataFrame, key: str) -> DataFrame:
    """key, node_id, duration_s: call, setup and teardown together."""
    return lines.filter(F.col("line").rlike(DURATION)).groupBy(key, F.regexp_extract("line", DURATION, 3).alias("node_id")).agg(F.sum(F.regexp_extract("line", DURATION, 1).cast("double")).alias("duration_s"))


def blocks(lines: DataFrame, key: str, section: str) -> DataFrame:
    """key, n, title, text: blocks under `___ title ___` rules in the first section of a title; lines before them belong to none."""
    first = lines.filter(F.col("line").rlike(RULE) & (F.col("section") == section)).groupBy(key).agg(F.min("n").alias("_from"))
    rules = lines.filter(F.col("line").rlike(RULE)).join(first, key).filter(F.col("n") > F.col("_from")).groupBy(key).agg(F.min("n").alias("_to"))
    body = lines.filter(F.col("section") == section).join(first, key).join(rules, key, "left").filter((F.col("n") > F.col("_from")) & (F.col("_to").isNull() | (F.col("n") < F.col("_to"))))
    rule = F.col("line").rlike(BLOCK_RULE)
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    told = body.withColumn("_start", F.last(F.when(rule, F.col("n")), ignorenulls=True).over(w)).filter("_start IS NOT NULL")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~rule, F.struct("n", "line")))), lambda s: s["line"]), "\n")
    title = F.max(F.when(rule, F.trim(F.regexp_extract("line", BLOCK_RULE, 1))))
    return told.groupBy(key, F.col("_start").alias("n")).agg(title.alias("title"), F.regexp_replace(joined, r"^\s+|\s+$", "").alias("text"))


def tracebacks(lines: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, node_id, traceback) and (key, test, traceback): of errors by node and by name, of failures by name; the first wins."""
    errors = blocks(lines, key, "ERRORS").filter("text <> ''").withColumn("node_id", F.element_at(F.split("title", r"\s+"), -1))
    failures = blocks(lines, key, "FAILURES").filter("text <> ''").withColumn("test", F.trim(F.element_at(F.split("title", "::"), -1)))
    by_node = errors.groupBy(key, "node_id").agg(F.min_by("text", "n").alias("traceback"))
    named = errors.select(key, F.lit(0).alias("_s"), "n", F.element_at(F.split("node_id", "::"), -1).alias("test"), "text").unionByName(failures.select(key, F.lit(1).alias("_s"), "n", "test", "text"))
    return by_node, named.groupBy(key, "test").agg(F.min_by("text", F.struct("_s", "n")).alias("traceback"))


def cases(lines: DataFrame, key: str) -> DataFrame:
    """key, node_id, outcome, duration_s, traceback: summary entries; failed and errored ones with their traceback, by node, then by name."""
    by_node, by_name = tracebacks(lines, key)
    found = summary_cases(lines, key).join(durations(lines, key), [key, "node_id"], "left").withColumn("test", F.element_at(F.split("node_id", "::"), -1))
    both = found.join(by_node.withColumnRenamed("traceback", "_node"), [key, "node_id"], "left").join(by_name.withColumnRenamed("traceback", "_name"), [key, "test"], "left")
    traceback = F.when(F.col("outcome").isin("failed", "error"), F.coalesce("_node", "_name"))
    return both.select(key, "node_id", "outcome", F.coalesce("duration_s", F.lit(0.0)).alias("duration_s"), traceback.alias("traceback"))


def raw_tail(text: Column) -> Column:
    """The last characters of a report, without colours."""
    plain = fn.ansi_free(text)
    return F.substring(plain, F.greatest(F.length(plain) - RAW_TAIL + 1, F.lit(1)), F.lit(RAW_TAIL))


def totals(lines: DataFrame, key: str) -> DataFrame:
    """key, passed, failed, errors, skipped, wall_s, interrupted: of the last rule with counts."""
    rules = lines.filter(F.col("line").rlike(r"^=") & F.col("line").rlike(COUNTS))
    last = rules.groupBy(key).agg(F.max_by("line", "n").alias("line"))
    count = lambda word: F.coalesce(F.nullif(F.regexp_extract("line", rf"(\d+)\s+{word}\b", 1), F.lit("")).cast("int"), F.lit(0))
    counted = last.select(key, count("passed").alias("passed"), count("failed").alias("failed"), count("errors?").alias("errors"), count("skipped").alias("skipped"), F.nullif(F.regexp_extract("line", WALL, 1), F.lit("")).cast("double").alias("wall_s"))
    broken = lines.withColumn("_i", F.nullif(F.regexp_extract("line", INTERRUPTED, 1), F.lit("")).cast("int")).groupBy(key).agg(F.max("_i").alias("interrupted"))
    return broken.join(counted, key, "left")


def reports(raw: DataFrame, key: str, text: str, exit_code: str) -> DataFrame:
    """key, exit_code, passed, failed, errors, wall_s and flags; each count is the worse of cases, totals and interruption."""
    lines = report_lines(raw, key, text)
    cases = summary_cases(lines, key).groupBy(key).agg(*[F.count_if(F.col("outcome") == o).alias(f"c_{o}") for o in ("passed", "failed", "error", "skipped")])
    both = raw.select(key, F.col(exit_code).alias("exit_code")).join(totals(lines, key), key, "left").join(cases, key, "left").fillna(0)
    out = both.select(key, "exit_code", F.greatest("passed", "c_passed").cast("int").alias("passed"), F.greatest("failed", "c_failed").cast("int").alias("failed"), F.greatest("errors", "c_error", "interrupted").cast("int").alias("errors"), F.greatest("skipped", "c_skipped").cast("int").alias("skipped"), "wall_s")
    out = out.withColumn("errors", F.when((F.col("exit_code") != 0) & (F.col("failed") + F.col("errors") == 0), 1).otherwise(F.col("errors")))
    return flagged(out)


def flagged(out: DataFrame) -> DataFrame:
    """Adds is_green, is_execution_failure, ran_nothing, is_broken to counted reports."""
    return out.withColumns({
        "is_green": (F.col("exit_code") == 0) & (F.col("failed") + F.col("errors") == 0) & (F.col("passed") > 0),
        "is_execution_failure": ~F.col("exit_code").isin(0, 1),
        "ran_nothing": F.col("passed") + F.col("failed") + F.col("errors") == 0,
        "is_broken": F.col("failed") + F.col("errors") > 0,
    })


def missing(value: Column, text: bool = True) -> Column:
    """Null, or blank text; 0 and false are content."""
    return value.isNull() | (F.trim(value) == "") if text else value.isNull()


def health(rows: DataFrame, required: list[str], min_rows: int = MIN_ROWS, most: float = MAX_MISSING, by: str | None = None) -> DataFrame:
    """rows, worst_field, worst_ratio, healthy, symptom: too few rows, or one field missing in more than `most` of them."""
    n = F.count("*")
    ratios = [F.round(F.count_if(missing(F.col(c).cast("string"))) / F.greatest(n, F.lit(1)), 6).alias(c) for c in required]
    counted = rows.groupBy(*([by] if by else [])).agg(n.alias("rows"), F.array_max(F.array(*[F.struct(r.alias("ratio"), F.lit(c).alias("field")) for c, r in zip(required, ratios, strict=True)])).alias("w"))
    few, bad = F.col("rows") < min_rows, F.col("worst_ratio") > most
    symptom = F.concat_ws("; ", F.when(few, F.concat(F.lit("too few rows: "), F.col("rows").cast("string"))), F.when(bad, F.concat(F.lit("missing "), F.col("worst_field"))))
    return counted.select(*([by] if by else []), "rows", F.col("w.field").alias("worst_field"), F.col("w.ratio").alias("worst_ratio")).withColumns({"healthy": ~few & ~bad, "symptom": symptom})


def located(findings: DataFrame, functions: DataFrame, key: str = "id", bin_lines: int = 64) -> DataFrame:
    """key, fid, span: functions of a finding's file whose span holds its line, the tightest (ties stay); else all of the file.

    Spans are spread over bins of lines, so that findings meet functions of their bin and not all of their file.
    """
    spans = functions.withColumn("span", F.col("end_line") - F.col("start_line"))
    binned = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start_line") / bin_lines), F.floor(F.col("end_line") / bin_lines))))
    marked = findings.withColumn("_bin", F.floor(F.col("line") / bin_lines))
    both = marked.join(binned, (marked["file_path"] == binned["path"]) & (marked["_bin"] == binned["_bin"]))
    inside = both.filter((F.col("line") >= F.col("start_line")) & (F.col("line") <= F.col("end_line"))).select(key, "fid", "span")
    best = inside.groupBy(key).agg(F.min("span").alias("span"))
    tight = inside.join(best, [key, "span"]).select(key, "fid", "span").distinct()
    lost = findings.join(best.select(key), key, "left_anti")
    rest = lost.join(spans, lost["file_path"] == spans["path"]).select(key, "fid", "span")
    return tight.unionByName(rest)


def verdict(locatable: Column, tests: Column, report: Column, execution_failure: Column, nothing: Column, broken: Column, related: Column) -> Column:
    """The status of a finding: the first rung of the ladder that holds."""
    return (
        F.when(~locatable, "unlocatable").when(tests == 0, "uncovered").when(~report, "uncovered").when(execution_failure, "inconclusive").when(nothing, "inconclusive")
        .when(broken & related, "confirmed").when(broken, "inconclusive").otherwise("unreproduced")
    )


def related(cases: Column, needles: Column) -> Column:
    """Whether a failing case (outcome, node_id, traceback) mentions one of the needles (file, module, function name)."""
    failing = F.filter(cases, lambda c: c["outcome"].isin("failed", "error"))
    hay = lambda c: F.concat_ws("\n", c["node_id"], c["traceback"])
    return F.exists(failing, lambda c: F.exists(needles, lambda n: (n != "") & F.contains(hay(c), n)))


def verified(findings: DataFrame, functions: DataFrame, tests: DataFrame, reported: DataFrame, told: DataFrame) -> DataFrame:
    """id, tests, status: findings from place to verdict.

    findings: id, file_path, line. functions: fid, path, name, start_line, end_line. tests: fid, node_id (selected for a
    function). reported: one row (or none) of `reports`. told: cases of that report (node_id, outcome, traceback). A finding is
    located in functions, their tests are counted, and failing cases that mention its file or a function relate to it.
    Distinct needles, not findings, are looked for in failing cases, by their rarest three characters: a join, whatever
    the number of either.
    """
    places = located(findings, functions)
    spots = findings.select("id", "file_path").join(places.select("id", "fid"), "id", "left")
    counted = spots.join(tests.select("fid", "node_id").distinct(), "fid", "left").groupBy("id").agg(F.count("fid").alias("_places"), F.count_distinct("node_id").alias("tests"))
    named = spots.join(functions.select("fid", "name"), "fid", "left")
    needles = named.select("id", F.explode(F.array("file_path", fn.module_name(F.col("file_path")), "name")).alias("needle")).filter("needle <> ''").distinct()
    failing = told.filter(F.col("outcome").isin("failed", "error")).select(F.concat_ws("\n", "node_id", "traceback").alias("_hay"))
    heard = contained(failing, needles.select("needle").distinct(), "_hay", "needle").select("needle").distinct()
    hit = needles.join(heard, "needle", "left_semi").select("id").distinct().withColumn("_related", F.lit(True))
    one = reported.agg(F.count("*").alias("_n"), F.bool_or("is_execution_failure").alias("_f"), F.bool_or("ran_nothing").alias("_o"), F.bool_or("is_broken").alias("_b"))  # a row
    both = counted.join(hit, "id", "left").crossJoin(F.broadcast(one))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    return both.select("id", "tests", verdict(F.col("_places") > 0, F.col("tests"), F.col("_n") > 0, no("_f"), no("_o"), no("_b"), no("_related")).alias("status"))


def pinned(spec: Column) -> Column:
    """The version of a requirement that is pinned: one `==` without a wildcard."""
    return F.nullif(F.regexp_extract(spec, r"^\s*==\s*([^\s,;*=]+)\s*$", 1), F.lit(""))


def tally(verdicts: DataFrame, status: str = "status") -> DataFrame:
    """status, n for every status there is, zero included."""
    spark = verdicts.sparkSession
    every = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    return every.join(verdicts.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n")), "status", "left").fillna(0, ["n"])


def diff_files(patches: DataFrame, key: str, diff: str) -> DataFrame:
    """key, path, first (line number): files that a diff touches on either side, in order of first sight."""
    lines = patches.select(key, F.posexplode(F.split(diff, "\n")).alias("n", "l"))
    header = r"^(?:---|\+\+\+) (?:[ab]/)?(\S+)"
    git = r"^diff --git a/(\S+) b/(\S+)$"
    paths = F.when(F.col("l").rlike(git), F.array(F.regexp_extract("l", git, 1), F.regexp_extract("l", git, 2))).when(F.col("l").rlike(header), F.array(F.regexp_extract("l", header, 1)))
    return lines.select(key, "n", F.explode(paths).alias("path")).filter("path <> '/dev/null'").groupBy(key, "path").agg(F.min("n").alias("first"))


def patch_allowed(files: Column, allowed: Column) -> Column:
    """Whether a patch touches something, no test file, and only what is allowed."""
    test = F.exists(files, lambda p: F.element_at(F.split(p, "/"), -1).rlike(r"^(test_.+\.py|.+_test\.py)$"))
    return (F.size(files) > 0) & ~test & (F.size(F.array_except(files, allowed)) == 0)


def carries(branch_files: Column, patch_files: Column) -> Column:
    """Whether two lists hold the same files."""
    return F.array_sort(F.array_distinct(branch_files)) == F.array_sort(F.array_distinct(patch_files))


def proven(before_broken: Column, after_green: Column) -> Column:
    return F.coalesce(before_broken & after_green, F.lit(False))


def dependencies(rows: DataFrame, name: str, order: str) -> DataFrame:
    """The first row, by `order`, of each canonical package name."""
    keyed = rows.withColumn("canonical", fn.canonical_package(F.col(name)))
    return keyed.withColumn("_r", F.row_number().over(Window.partitionBy("canonical").orderBy(order))).filter("_r = 1").drop("_r")


def requirements(text: DataFrame, key: str, column: str) -> DataFrame:
    """key, n, name, spec of requirement lines: continuations joined, comments, hashes and options left out."""
    lines = text.select(key, F.posexplode(F.split(F.regexp_replace(column, r"\\\n", " "), "\n")).alias("n", "l"))
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("l", r"(^|\s+)#.*$", ""), r"\s--hash=\S+", ""), r"\s*;.*$", ""))
    pattern = r"^([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*(.*)$"
    told = lines.withColumn("c", clean).filter((F.col("c") != "") & ~F.startswith("c", F.lit("-")))
    return told.select(key, "n", fn.canonical_package(F.regexp_extract("c", pattern, 1)).alias("name"), F.trim(F.regexp_extract("c", pattern, 2)).alias("spec")).filter("name <> ''")
