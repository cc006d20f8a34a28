"""Column functions over log lines, messages, names and report text."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that results depend on.
LEVELS = r"(?i)\b(TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL)\b"
SIGNATURE = r"""[0-9a-fA-F]{4,}|\d{4}-\d{2}-\d{2}[T_][\d:.]+Z?|\d+|"[^"]*"|'[^']*'|\s+"""
SECRET = r"(?<![A-Za-z0-9_])(?:dtn_|nvapi-|sk-|ghp_)[A-Za-z0-9_\-]{3,}"
SENSITIVE_KEYS = ["authorization", "api_key", "token", "bearer", "connection_string"]
ANSI = r"\x1b\[[0-9;?]*[ -/]*[@-~]"
SYMBOLS = r"[=:/\-#@]"


def bound(value: Column, use) -> Column:
    """use(value), with the value worked out once: what a lambda captures is evaluated anew for every element it is called with."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def level(line: Column) -> Column:
    """The first level word in lower case, warning as warn; info where there is none."""
    found = F.lower(F.regexp_extract(line, LEVELS, 1))
    return F.when(found == "", F.lit("info")).when(found == "warning", F.lit("warn")).otherwise(found)


def message(line: Column, entry_start: str, separators: list[str]) -> Column:
    """What follows the first separator behind the last ], else one from the 21st character on, else the entry's start."""
    bracket = F.when(F.instr(line, "]") > 0, F.length(line) - F.instr(F.reverse(line), "]") + 1).otherwise(F.lit(0))
    options = []
    for start, usable in ((F.greatest(bracket, F.lit(1)), bracket > 1), (F.lit(21), F.lit(True))):
        for sep in separators:
            at = F.call_function("locate", F.lit(sep), line, start)
            options.append(F.when(usable & (at > 1), F.trim(F.call_function("substring", line, at + len(sep)))))
    rest = F.trim(F.regexp_replace(line, rf"\A(?:{entry_start.removeprefix('^')})", ""))
    return F.coalesce(*options, rest)


def signature(text: Column) -> Column:
    """Hex words, times, numbers, quoted strings and white space each as a space, trimmed: equal where only these differ."""
    return F.trim(F.regexp_replace(text, SIGNATURE, " "))


def redacted(text: Column, mask: str = "[REDACTED]") -> Column:
    """Tokens with a known secret prefix and 3 characters or more behind it, where no word character stands before, as a mask."""
    return F.regexp_replace(text, SECRET, mask)


def redacted_json(text: Column, mask: str = "[REDACTED]") -> Column:
    """JSON text with the plain values (strings, numbers, true, false, null) of SENSITIVE_KEYS masked at any depth, and secrets elsewhere."""
    value = r"""("(?:[^"\\]|\\.)*"|[-+.\w]+)"""
    return redacted(F.regexp_replace(text, rf"""(?i)("(?:{"|".join(SENSITIVE_KEYS)})"\s*:\s*){value}""", f'$1"{mask}"'), mask)


def matches_any(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns], F.lit(False))


def quoted_any(text: Column, markers: list[str]) -> Column:
    """Whether one of the markers occurs, whatever the case."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(m.lower())) for m in markers], F.lit(False))


def ansi_free(text: Column) -> Column:
    return F.regexp_replace(text, ANSI, "")


def method_name(name: Column) -> Column:
    """What stands behind the last :: or else . or else /."""
    last = lambda sep: F.element_at(F.split(name, re.escape(sep)), -1)
    return F.when(F.contains(name, F.lit("::")), last("::")).when(F.contains(name, F.lit(".")), last(".")).when(F.contains(name, F.lit("/")), last("/")).otherwise(name)


def fragments(text: Column) -> Column:
    """Constant parts of a message template, in order: between ${..}, $name, {..}, printf places and joined expressions."""
    places = r"\$\{[^}]*\}|\$\w+|\{[^}]*\}|%[-+0 #]*\d*(?:\.\d+)?[sdifgxXc]|\"\s*\+\s*[^+\"]+\s*\+\s*\""
    return F.filter(F.transform(F.split(text, places), lambda p: F.trim(p)), lambda p: p != "")


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def module_name(path: Column, root: str = "src/") -> Column:
    """a/b/__init__.py and a/b.py of a source root as a.b."""
    cut = F.regexp_replace(F.regexp_replace(path, f"^{re.escape(root)}", ""), r"\.py$", "")
    return F.replace(F.regexp_replace(cut, "/__init__$", ""), F.lit("/"), F.lit("."))


def dotted_prefixes(name: Column) -> Column:
    """a, a.b and a.b.c of a.b.c: whatever a prefix at a dot can equal."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def canonical_package(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def clean_title(body: Column, most: int = 120) -> Column:
    """The first line of a comment that says something, without tags and markup."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", ""), "[*_`#]+", "")))
    said = F.filter(lines, lambda x: ~x.rlike(r"^[-=_\s]*$"))
    return F.substring(F.coalesce(F.get(said, F.lit(0)), F.lit("")), 1, most)


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays of numbers, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
