"""Log profiles: how lines of a service become entries and fields."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

# Defaults of a profile.
ENTRY_START = r"^\d{4}-\d{2}-\d{2}"
CONTINUATIONS = [r"^\s+at\s+", r"^\s+\.\.\.\s+\d+\s+more", r"^Caused by:", r"^\t"]
ERROR_LEVELS = ["error", "fatal"]
SEPARATORS = [" : ", " - "]
#: Stack frames, causes and exceptions of the two languages that have a built-in form.
STACKS = {
    "java": {
        "frame": r"^\s*at\s+(?:[\w.]+/)?([\w.$]+)\.([\w<>]+)\(([^:]+):(\d+)\)",
        "caused_by": r"^Caused by:\s+([\w.$]+):\s*(.*)",
        "exception": r"^([\w.$]+(?:Exception|Error|Throwable)):\s*(.*)",
    },
    "python": {
        "frame": r"^\s+File\s+\"([^\"]+)\",\s+line\s+(\d+),\s+in\s+(\w+)",
        "exception": r"^(\w+(?:Error|Exception)):\s*(.*)",
    },
}


def java(pattern: str, anchored: bool = False) -> str:
    """A Python regular expression for Spark's Java dialect: group names, and the start of the text when `anchored`."""
    pattern = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', 'x5F')}>", pattern)
    pattern = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\k<{m[1].replace('_', 'x5F')}>", pattern)
    return rf"\A(?:{pattern})" if anchored else pattern


def group_names(pattern: str) -> list[str]:
    """Names of a pattern's groups in order; unnamed ones are empty strings."""
    named = {i: n for n, i in re.compile(pattern).groupindex.items()}
    return [named.get(i + 1, "") for i in range(re.compile(pattern).groups)]


@dataclass
class LogProfile:
    """What a log looks like. `language` may be a name or a list of names (the first known one counts)."""

    name: str = ""
    type: str = "text"
    entry_start: str = ENTRY_START
    continuation_patterns: list[str] = field(default_factory=lambda: list(CONTINUATIONS))
    line_pattern: str = ""
    alt_patterns: list[str] = field(default_factory=list)
    field_map: dict[str, str] = field(default_factory=dict)
    message_separators: list[str] = field(default_factory=lambda: list(SEPARATORS))
    error_levels: list[str] = field(default_factory=lambda: list(ERROR_LEVELS))
    error_markers: list[str] = field(default_factory=list)
    ignore_patterns: list[str] = field(default_factory=list)
    known_errors: list[dict[str, str]] = field(default_factory=list)
    group_by_thread: bool = True
    thread_field: str = "thread"
    service: str = ""
    language: Any = "java"
    frame_pattern: str = ""
    caused_by_pattern: str = ""
    exception_pattern: str = ""
    framework_markers: list[str] = field(default_factory=list)

    @property
    def stack(self) -> dict[str, str] | None:
        """Patterns of stack traces: the profile's own, else those of its language."""
        if self.frame_pattern:
            return {k: v for k, v in (("frame", self.frame_pattern), ("caused_by", self.caused_by_pattern), ("exception", self.exception_pattern)) if v}
        names = self.language if isinstance(self.language, list) else [self.language]
        return next((STACKS["java" if n == "groovy" else n] for n in names if n == "groovy" or n in STACKS), None)


def merged(base: dict, over: dict) -> dict:
    """`over` on top of `base`: dictionaries are joined at every depth, anything else, lists too, is replaced."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def load_profile(path: str | Path, _seen: tuple[Path, ...] = ()) -> LogProfile:
    """A profile from YAML; `extends` names a file beside it that it builds on."""
    path = Path(path).resolve()
    if path in _seen:
        raise ValueError(f"{path} extends itself")
    return profile(_read(path, _seen))


def _read(path: Path, seen: tuple[Path, ...]) -> dict:
    import yaml

    if path in seen:
        raise ValueError(f"{path} extends itself")
    data = yaml.safe_load(path.read_text()) or {}
    base = data.pop("extends", None)
    if base:
        parent = path.parent / base
        parent = parent if parent.suffix else parent.with_suffix(".yaml")
        data = merged(_read(parent.resolve(), (*seen, path)), data)
    return data


def profile(data: dict) -> LogProfile:
    """From nested settings (log_format, stack_trace and top-level keys) or flat ones; unknown keys don't matter."""
    flat = {k: v for k, v in data.items() if not isinstance(v, dict)} | data.get("log_format", {}) | data.get("stack_trace", {})
    if "field_map" in data:
        flat["field_map"] = data["field_map"]
    known = {f.name for f in fields(LogProfile)}
    return LogProfile(**{k: v for k, v in flat.items() if k in known})
