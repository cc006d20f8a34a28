"""Package versions as keys that compare as their order is defined, and requirement lines in parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The form of a version and of a requirement, and names that are no packages.
VERSION = (
    r"(?i)^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?(\d*))?"
    r"((?:-\d+)|(?:[-_.]?(?:post|rev|r)[-_.]?\d*))?([-_.]?dev[-_.]?\d*)?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)
REQUIREMENT = r"^\s*([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)\s*(\[[^\]]*\])?\s*(?:@\s*(\S+)|\(?\s*((?:(?:===|==|~=|!=|<=|>=|<|>)\s*[^\s,;()]+\s*(?:,\s*(?=[=~!<>]))?)*)\)?)\s*(?:;\s*(.+))?$"
NO_PACKAGES = ["python", "python-version"]
LAST = 2**63 - 1


def _number(text: Column) -> Column:
    """Digits in a text as a number, 0 without any."""
    digits = F.regexp_replace(text, r"\D", "")
    return F.when(digits == "", F.lit(0)).otherwise(F.expr("1") * digits.try_cast("bigint"))


def key(version: Column) -> Column:
    """A struct that compares as versions do: epoch, release, pre, post, dev, local; null for what is no version.

    Trailing zeros of a release don't count; a development release comes before all pre-releases, these before the
    release, post-releases after it; of local parts numbers come after words. Numbers of over 18 digits make no version.
    """
    part = lambda i: F.regexp_extract(version, VERSION, i)
    release = F.transform(F.split(part(2), r"\."), lambda x: x.try_cast("bigint"))
    last = F.array_max(F.transform(release, lambda x, i: F.when(x != 0, i + 1).otherwise(0)))
    letter = F.lower(F.substring(part(3), 1, 1))
    word = F.lower(part(3))
    kind = F.when(word == "", F.when((part(6) != "") & (part(5) == ""), -1).otherwise(3)).when(letter == "a", 0).when(letter == "b", 1).otherwise(2)
    local = F.transform(F.filter(F.split(F.lower(part(7)), "[-_.]"), lambda x: x != ""), lambda x: F.struct(F.when(x.rlike(r"^\d+$"), 1).otherwise(0).alias("number"), F.coalesce(F.when(x.rlike(r"^\d+$"), x.try_cast("bigint")), F.lit(0)).alias("n"), F.when(x.rlike(r"^\d+$"), "").otherwise(x).alias("word")))
    made = F.struct(
        _number(part(1)).alias("epoch"), F.slice(release, F.lit(1), last).alias("release"), F.struct(kind.alias("kind"), F.when(word == "", 0).otherwise(_number(part(4))).alias("n")).alias("pre"),
        F.when(part(5) == "", F.lit(-1)).otherwise(_number(part(5))).cast("bigint").alias("post"), F.when(part(6) == "", F.lit(LAST)).otherwise(_number(part(6))).alias("dev"), local.alias("local"),
    )
    sound = version.rlike(VERSION) & ~F.exists(release, lambda x: x.isNull()) & made["epoch"].isNotNull() & made["pre"]["n"].isNotNull() & made["post"].isNotNull() & made["dev"].isNotNull()
    return F.when(sound, made)


def is_newer(current: Column, candidate: Column) -> Column:
    """Whether a candidate comes after the current version; null where either is no version."""
    return key(candidate) > key(current)


def requirement(text: Column) -> Column:
    """name, extras, spec, url, marker, version (of one `==` without a wildcard) of a requirement; null for what is none."""
    part = lambda i: F.nullif(F.trim(F.regexp_extract(text, REQUIREMENT, i)), F.lit(""))
    pin = F.nullif(F.regexp_extract(part(4), r"^==\s*([^\s,;*=]+)$", 1), F.lit(""))
    made = F.struct(part(1).alias("name"), part(2).alias("extras"), part(4).alias("spec"), part(3).alias("url"), part(5).alias("marker"), F.when(key(pin).isNotNull(), pin).alias("version"))
    return F.when(text.rlike(REQUIREMENT), made)
