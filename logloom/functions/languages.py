"""What source lines of a language look like: patterns of branches, returns, log calls and calls, and its blocks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Branch:
    """`links` marks the other way of the branch around it (else, catch); a condition is what stands between `delimiters`, or ahead of `terminator`."""

    name: str
    pattern: str
    delimiters: tuple[str, str] | None = None
    terminator: str = ""
    links: bool = False


@dataclass(frozen=True)
class Language:
    """`style` is braces or indent. A line goes on in the next one if it ends like `trailing` or, with `brackets`, has one open."""

    name: str
    style: str = "braces"
    branches: tuple[Branch, ...] = ()
    returns: tuple[str, ...] = ()
    logs: tuple[str, ...] = ()
    call: str = ""
    skip_receivers: tuple[str, ...] = ()
    skip_starts: tuple[str, ...] = ()
    trailing: tuple[str, ...] = ()
    brackets: bool = False
    definitions: tuple[str, ...] = field(default=())


# Patterns of four languages, each in order of precedence.
PAREN = ("(", ")")
JAVA = Language(
    "java",
    branches=(
        Branch("if", r"\s*(if|else\s*if)\s*\(", PAREN),
        Branch("else", r"^\s*\}?\s*else\s*[\{]?", links=True),
        Branch("try", r"\s*try\s*[\{\(]?"),
        Branch("catch", r"\s*catch\s*\(", PAREN, links=True),
        Branch("finally", r"\s*finally\s*[\{]?", links=True),
        Branch("switch", r"\s*switch\s*\(", PAREN),
        Branch("case", r"\s*case\s+", links=True),
        Branch("default", r"\s*default\s*:", links=True),
    ),
    returns=(r"\s*return\b", r"\s*throw\s+new\b", r"\s*throw\b", r"\s*break\b", r"\s*continue\b"),
    logs=(
        r"\blog\s*\.\s*(trace|debug|info|warn|error|fatal)\s*[\(]",
        r"\blogger\s*\.\s*(trace|debug|info|warn|error|fatal)\s*[\(]",
        r"\blog\s*\.\s*(trace|debug|info|warn|error|fatal)\s*\"",
        r"\blogger\s*\.\s*(trace|debug|info|warn|error|fatal)\s*\"",
        r"\bLOG\s*\.\s*(trace|debug|info|warn|error|fatal)\s*[\(]",
        r"\b(println|print)\s*\(",
        r"\bSystem\s*\.\s*(out|err)\s*\.\s*(println|print)\s*\(",
        r"\blog\s*\.\s*(trace|debug|info|warn|error|fatal)\s+(?=[\"'])",
        r"\blogger\s*\.\s*(trace|debug|info|warn|error|fatal)\s+(?=[\"'])",
    ),
    call=r"(\w+)\s*\.\s*(\w+)\s*\(",
    skip_receivers=("log", "logger", "LOG", "System", "this", "super", "Math", "Objects", "Arrays", "Collections", "String", "Integer", "Long", "Boolean", "Double"),
    skip_starts=("if", "else", "for", "while", "switch", "return", "throw", "try", "catch", "//", "/*", "*"),
    trailing=("+", "&", "|", ".", ","),
    brackets=True,
    definitions=(
        r"^\s*(?:public|private|protected|static|\s)*\s*(?:void|String|int|long|boolean|Object|List|Map|Set|\w+(?:<[^>]+>)?)\s+(\w+)\s*\(",
        r"^\s*def\s+(\w+)\s*=\s*\{",
        r"^\s*(?:public|private|protected|static|\s)*\s*def\s+(\w+)\s*\(",
    ),
)
PYTHON = Language(
    "python",
    style="indent",
    branches=(
        Branch("if", r"\s*(if|elif)\s+.+:", terminator=":"),
        Branch("else", r"\s*else\s*:", links=True),
        Branch("try", r"\s*try\s*:"),
        Branch("catch", r"\s*except\s*(.*)?:", links=True),
        Branch("finally", r"\s*finally\s*:", links=True),
        Branch("match", r"\s*match\s+.+:"),
        Branch("case", r"\s*case\s+.+:", links=True),
        Branch("with", r"\s*with\s+.+:"),
        Branch("for", r"\s*for\s+.+:"),
        Branch("while", r"\s*while\s+.+:"),
    ),
    returns=(r"\s*return\b", r"\s*raise\b", r"\s*sys\.exit\s*\(", r"\s*exit\s*\(", r"\s*break\b", r"\s*continue\b"),
    logs=(
        r"\blogger\s*\.\s*(debug|info|warning|error|critical|exception)\s*\(",
        r"\blogging\s*\.\s*(debug|info|warning|error|critical)\s*\(",
        r"\blog\s*\.\s*(debug|info|warning|error|critical)\s*\(",
        r"\bprint\s*\(",
    ),
    call=r"(\w+)\s*\.\s*(\w+)\s*\(",
    skip_receivers=("self", "cls", "super", "logger", "logging", "print", "str", "int", "float", "list", "dict", "set", "len", "type", "isinstance", "hasattr", "getattr"),
    skip_starts=("if", "elif", "else", "for", "while", "return", "raise", "import", "from", "#", '"""', "'''", "def", "class", "with", "assert"),
    trailing=("\\", ","),
    brackets=True,
    definitions=(r"^\s*def\s+(\w+)\s*\(", r"^\s*async\s+def\s+(\w+)\s*\("),
)
JAVASCRIPT = Language(
    "javascript",
    branches=(
        Branch("if", r"\s*(if|else\s*if)\s*\(", PAREN),
        Branch("else", r"\s*[\}]?\s*else\s*[\{]?", links=True),
        Branch("try", r"\s*try\s*\{"),
        Branch("catch", r"\s*[\}]?\s*catch\s*\(", PAREN, links=True),
        Branch("finally", r"\s*[\}]?\s*finally\s*\{", links=True),
        Branch("switch", r"\s*switch\s*\(", PAREN),
        Branch("case", r"\s*case\s+.+:", links=True),
        Branch("default", r"\s*default\s*:", links=True),
    ),
    returns=(r"\s*break\b", r"\s*continue\b", r"\s*return\b", r"\s*throw\s+new\b", r"\s*throw\b", r"\s*process\.exit\s*\("),
    logs=(
        r"\bconsole\s*\.\s*(log|debug|info|warn|error|trace)\s*\(",
        r"\blogger\s*\.\s*(log|debug|info|warn|error|trace)\s*\(",
        r"\blog\s*\.\s*(log|debug|info|warn|error|trace)\s*\(",
        r"\bprocess\s*\.\s*(stdout|stderr)\s*\.\s*write\s*\(",
    ),
    call=r"(\w+)\s*\.\s*(\w+)\s*\(",
    skip_receivers=("console", "logger", "log", "Math", "JSON", "Object", "Array", "String", "Number", "Promise", "this", "super"),
    skip_starts=("if", "else", "for", "while", "switch", "return", "throw", "try", "catch", "//", "/*", "*", "const", "let", "var", "import", "export"),
    trailing=("+", "&", "|", ".", ",", "=>"),
    brackets=True,
    definitions=(r"^\s*(?:async\s+)?function\s+(\w+)\s*\(", r"^\s*(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(", r"^\s*(\w+)\s*\(.*\)\s*\{"),
)
GO = Language(
    "go",
    branches=(
        Branch("if", r"\s*if\s+"),
        Branch("else", r"\s*[\}]\s*else\s*[\{]", links=True),
        Branch("switch", r"\s*switch\s*"),
        Branch("case", r"\s*case\s+.+:", links=True),
        Branch("default", r"\s*default\s*:", links=True),
        Branch("select", r"\s*select\s*\{"),
        Branch("defer", r"\s*defer\s+"),
    ),
    returns=(r"\s*break\b", r"\s*continue\b", r"\s*return\b", r"\s*panic\s*\(", r"\s*log\.Fatal", r"\s*os\.Exit\s*\("),
    logs=(
        r"\blog\s*\.\s*(Print|Printf|Println|Fatal|Fatalf|Fatalln)\s*\(",
        r"\b(zap|logrus|zerolog)\s*\.\s*(Info|Debug|Warn|Error|Fatal|Panic)\w*\s*\(",
        r"\b\w+\.(Infof?|Debugf?|Warnf?|Errorf?|Fatalf?)\s*\(",
        r"\bfmt\s*\.\s*(Print|Printf|Println|Errorf|Fprintf)\s*\(",
        r"\bprintln\s*\(",
    ),
    call=r"(\w+)\s*\.\s*(\w+)\s*\(",
    skip_receivers=("log", "fmt", "os", "io", "context", "errors", "strings", "strconv", "math", "time", "sync", "http"),
    skip_starts=("if", "else", "for", "switch", "select", "return", "go", "defer", "//", "/*", "var", "const", "type", "func", "import", "package"),
    trailing=(",",),
    brackets=True,
    definitions=(r"^func\s+(\w+)\s*\(", r"^func\s+\([^)]+\)\s+(\w+)\s*\("),
)
LANGUAGES = {"java": JAVA, "groovy": JAVA, "kotlin": JAVA, "python": PYTHON, "javascript": JAVASCRIPT, "typescript": JAVASCRIPT, "jsx": JAVASCRIPT, "tsx": JAVASCRIPT, "go": GO}
EXCEPTIONS = ("catch", "finally")
COMMENT = r"^\s*(?://|/\*|\*/|\*|#(?!!))"
_TRAILING = {"trailing_backslash": ("\\",), "trailing_operator": ("+", "&", "|", "."), "trailing_comma": (",",), "trailing_pipe": ("|",), "trailing_backtick": ("`",), "trailing_arrow": ("=>",)}


def load_language(path: str | Path) -> Language:
    """A language from YAML: block_style, branches (pattern, condition_delimiters or terminator, links_to), returns, log_calls, method_calls, continuation."""
    import yaml

    path = Path(path)
    data = yaml.safe_load(path.read_text()) or {}
    rules, calls = data.get("continuation") or {}, data.get("method_calls") or {}
    branches = []
    for name, b in (data.get("branches") or {}).items():
        ends = tuple(b.get("condition_delimiters") or ()) if b.get("has_condition") else ()
        branches.append(Branch(name, b["pattern"], (ends[0], ends[1]) if ends else None, "" if ends or not b.get("has_condition") else b.get("terminator") or "", bool(b.get("links_to"))))
    return Language(
        path.stem, "indent" if data.get("block_style") == "indent" else "braces", tuple(branches), tuple(data.get("returns") or ()), tuple(data.get("log_calls") or ()),
        calls.get("pattern") or "", tuple(calls.get("skip_receivers") or ()), tuple(calls.get("skip_starts") or ()),
        tuple(dict.fromkeys(t for rule, ends in _TRAILING.items() if rules.get(rule) for t in ends)), bool(rules.get("trailing_open_paren") or rules.get("unclosed_bracket")), tuple(data.get("function_definitions") or ()),
    )


def language(name: str | Language) -> Language:
    """The patterns of a name; those of Java for an unknown one."""
    return name if isinstance(name, Language) else LANGUAGES.get((name or "java").lower(), JAVA)


def _head(pattern: str) -> str:
    return rf"\A(?:{pattern})"


def _found(line: Column, patterns: list[str], flags: str = "") -> Column:
    """Whether any pattern is found: by one pattern of all of them, unless some refer to groups or name them."""
    if any(re.search(r"\\[1-9k]|\(\?<[A-Za-z]|\(\?[a-zA-Z-]+\)", p) for p in patterns):
        return reduce(lambda a, b: a | b, [line.rlike(f"{flags}{p}") for p in patterns])
    return line.rlike(flags + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def starts_with(line: Column, patterns: tuple[str, ...]) -> Column:
    return _found(line, [_head(p) for p in patterns])


def branch(line: Column, lang: Language) -> Column:
    """name, condition (80 characters at most), links of the first branch pattern that a line starts with; null without one."""
    out = F.lit(None)
    for b in reversed(lang.branches):
        condition = F.lit("")
        if b.delimiters:
            first = F.instr(line, b.delimiters[0])
            last = F.length(line) - F.instr(F.reverse(line), b.delimiters[1]) + 1
            condition = F.when((first > 0) & (F.instr(line, b.delimiters[1]) > 0) & (last > first), F.substring(F.call_function("substring", line, first + 1, F.greatest(last - first - 1, F.lit(0))), 1, 80)).otherwise("")
        elif b.terminator:
            rest = F.regexp_replace(line, _head(b.pattern), "")
            ahead = F.substring_index(rest, b.terminator, -1)
            condition = F.when(F.instr(rest, b.terminator) > 1, F.substring(F.trim(F.call_function("substring", rest, F.lit(1), F.length(rest) - F.length(ahead) - 1)), 1, 80)).otherwise("")
        told = F.struct(F.lit(b.name).alias("name"), condition.alias("condition"), F.lit(b.links).alias("links"))
        out = F.when(line.rlike(_head(b.pattern)), told).otherwise(out)
    return F.when(_found(line, [_head(b.pattern) for b in lang.branches]), out)


def _parts(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern), lambda p: p != "")


def fragments(text: Column, name: str | Language) -> Column:
    """Constant parts of a message by the language's way of filling it in, in order and as they stand."""
    name = name.name if isinstance(name, Language) else name
    bare = lambda c: F.trim(c, F.lit('"'))
    plain = F.trim(F.trim(text, F.lit('"')), F.lit("'"))
    joined = F.filter(F.transform(F.split(text, r"\"\s*\+\s*|\s*\+\s*\""), lambda p: bare(_stripped(p))), lambda p: p != "")
    out = F.when(F.contains(text, F.lit("+")) & F.contains(text, F.lit('"')), joined).otherwise(F.filter(F.array(plain), lambda p: p != ""))
    if name in ("rust", "javascript", "typescript"):
        out = F.when(text.rlike(r"\{[^}]*\}"), _parts(text, r"\{[^}]*\}")).otherwise(out)
    out = F.when(text.rlike("%[sdflxvqweEgG]"), _parts(text, "%[-+0-9*.]*[sdflxvqweEgGoO]")).otherwise(out)
    out = F.when(F.contains(text, F.lit("{}")), _parts(text, r"\{\}")).otherwise(out)
    if name == "groovy":
        said = lambda parts: F.filter(parts, lambda p: _stripped(p) != "")
        names = said(F.split(text, r"\$[\w.]+"))
        out = F.when(F.contains(text, F.lit("${")), said(F.split(text, r"\$\{[^}]*\}"))).when(F.contains(text, F.lit("$")) & (F.size(names) > 0), names).otherwise(out)
    return out


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def log_call(line: Column, name: str | Language) -> Column:
    """level, text, frags, rest of the first log pattern found in a line; null without one. Text and fragments are empty where nothing is quoted."""
    lang = language(name)
    out = F.lit(None)
    for p in reversed(lang.logs):
        whole = rf"(?i)({p})(.*)"
        groups = _groups(p)
        level = F.lower(F.regexp_extract(line, whole, 2)) if groups else F.lit("info")
        met = F.regexp_extract(line, whole, 1)
        rest = F.concat(F.when(F.endswith(met, F.lit('"')), F.lit('"')).otherwise(""), F.regexp_extract(line, whole, groups + 2))
        out = F.when(line.rlike(f"(?i){p}"), F.struct(level.alias("level"), rest.alias("rest"))).otherwise(out)
    return F.when(_found(line, list(lang.logs), "(?i)"), out)


def _groups(pattern: str) -> int:
    return re.compile(pattern).groups


def quoted(text: Column) -> Column:
    """From the first double quote to the last one, else what stands in single quotes first; null without either."""
    return F.when(text.rlike('"[^\n]*"'), F.regexp_extract(text, '"([^\n]*)"', 1)).when(text.rlike("'[^']*'"), F.regexp_extract(text, "'([^']*)'", 1))


def call(line: Column, lang: Language) -> Column:
    """receiver.method of the first call in a line; null where the line starts like something else or the receiver is left out."""
    if not lang.call:
        return F.lit(None).cast("string")
    said = _stripped(line)
    skipped = reduce(lambda a, b: a | b, [F.startswith(said, F.lit(s)) for s in lang.skip_starts], F.lit(False))
    receiver = F.regexp_extract(said, lang.call, 1)
    method = F.regexp_extract(said, lang.call, 2) if _groups(lang.call) > 1 else receiver
    return F.when(~skipped & said.rlike(lang.call) & ~receiver.isin(list(lang.skip_receivers)), F.concat(receiver, F.lit("."), method))
