"""Log templates: admission, longest-prefix lookup and ordered-fragment verification as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import languages
from ..functions import text as fn
from ..functions.languages import Language

# Shortest key, shortest single fragment without a symbol.
KEY, SINGLE = 3, 10


def admitted(templates: DataFrame, frags: str = "frags") -> DataFrame:
    """Adds key, the first fragment trimmed; templates with a short key, or one short fragment without a symbol, go."""
    key = F.trim(F.get(F.col(frags), F.lit(0)))
    told = (F.size(frags) > 1) | (F.length(key) >= SINGLE) | key.rlike(fn.SYMBOLS)
    return templates.withColumn("key", key).filter((F.length(F.col("key")) >= KEY) & told)


def longest_prefix(messages: DataFrame, templates: DataFrame, text: str = "static_text") -> DataFrame:
    """Pairs of a distinct message and every template at the longest key that the message starts with.

    Each distinct head of messages, as long as the longest key, gives its prefixes of the lengths that keys have (an aggregated
    row of numbers) and meets whole keys by equality; a head with its templates then meets the distinct messages that begin with
    it. So messages aren't multiplied by the lengths of keys. Of a message's candidates only the longest keys are
    kept, before fragments are looked at: a deeper key that fails isn't replaced by a shallower one.
    """
    keys = templates.select("key").distinct()
    lengths = F.broadcast(keys.agg(F.array_sort(F.collect_set(F.length("key"))).alias("_lengths")))
    distinct = messages.select(F.col(text).alias("_text")).filter(F.col("_text").isNotNull()).distinct()
    headed = distinct.crossJoin(lengths).select("_text", F.expr("substring(_text, 1, array_max(_lengths))").alias("_head"))
    heads = messages.crossJoin(lengths).select(F.expr(f"substring(`{text}`, 1, array_max(_lengths))").alias("_head"), "_lengths").filter(F.col("_head").isNotNull()).distinct()
    prefixes = heads.select("_head", F.explode(F.filter("_lengths", lambda n: n <= F.length("_head"))).alias("_n"))
    hits = prefixes.select("_head", F.expr("substring(_head, 1, _n)").alias("key")).join(keys, "key", "left_semi")
    longest = hits.groupBy("_head").agg(F.max_by("key", F.length("key")).alias("key"))
    return headed.join(longest.join(templates, "key"), "_head").select("key", "_text", *[c for c in templates.columns if c != "key"])


def in_order(text: Column, frags: Column) -> Column:
    """Whether every fragment behind the first is found at or behind the end of the one before it."""
    end = F.aggregate(
        F.slice(frags, F.lit(2), F.size(frags)),
        F.length(F.get(frags, F.lit(0))) + 1,
        lambda at, f: F.when(at == 0, F.lit(0)).otherwise(F.when(F.call_function("locate", f, text, at) > 0, F.call_function("locate", f, text, at) + F.length(f)).otherwise(F.lit(0))),
    )
    return (F.size(frags) == 1) | (end > 0)


def matched(messages: DataFrame, templates: DataFrame, text: str = "static_text", frags: str = "frags") -> DataFrame:
    """Verified (message, template) pairs: the message as `text`, and the template's columns."""
    pairs = longest_prefix(messages, admitted(templates, frags), text)
    return pairs.filter(in_order(F.col("_text"), F.col(frags))).withColumnRenamed("_text", text)


def counted(messages: DataFrame, templates: DataFrame, text: str = "static_text") -> DataFrame:
    """text, candidates, fid: how many functions each distinct message fits, and the smallest of them.

    Templates with equal fragments are one, with the number of functions that have no other template, so a message meets each only once,
    however many functions share it. Functions with several templates are brought together by message and counted once.
    """
    own = templates.groupBy("fid").agg(F.collect_set("frags").alias("_own")).select("fid", (F.size("_own") > 1).alias("_several"), F.explode("_own").alias("frags"))
    equal = own.groupBy("frags").agg(F.count(F.when(~F.col("_several"), F.col("fid"))).alias("_n"), F.min("fid").alias("_low"), F.collect_list(F.when(F.col("_several"), F.col("fid"))).alias("_several"))
    found = matched(messages, equal, text).groupBy(text).agg(F.sum("_n").alias("_n"), F.min("_low").alias("fid"), F.size(F.array_distinct(F.flatten(F.collect_list("_several")))).alias("_m"))
    return found.select(text, (F.col("_n") + F.col("_m")).alias("candidates"), "fid")


def lenient(message: Column, frags: Column) -> Column:
    """Whether the first fragment of more than 3 characters occurs in a message."""
    long = F.get(F.filter(frags, lambda f: F.length(f) > 3), F.lit(0))
    return F.coalesce(F.contains(message, F.trim(long)), F.lit(False))


def scanned(functions: DataFrame, source: str = "source", language: str | Language = "java") -> DataFrame:
    """fid, line (from 1), level, text, frags of the log calls that stand on one line of a source."""
    lines = functions.select("fid", F.posexplode(F.split(source, "\n")).alias("n", "l"))
    return _told(_there(lines, "_c", languages.log_call(F.col("l"), language)).withColumn("_s", F.col("_c.rest")), language, 3)


def extracted(functions: DataFrame, source: str = "source", language: str | Language = "java") -> DataFrame:
    """fid, line (from 1), level, text, frags of log calls in function sources that may go on for three more lines.

    A call goes on until a line ends with a closing bracket or holds `);`. The lines behind each one are known from its own source, so
    nothing is shuffled.
    """
    followed = fn.bound(F.split(source, "\n"), lambda a: F.transform(a, lambda l, i: F.struct(l.alias("l"), F.slice(a, i + 2, F.lit(3)).alias("more"))))
    lines = functions.select("fid", F.posexplode(followed).alias("n", "x")).select("fid", "n", "x.l", "x.more")
    called = _there(lines, "_c", languages.log_call(F.col("l"), language))
    ends = lambda l: F.contains(l, F.lit(");")) | l.rlike(r"\)\s*\z")
    step = lambda s, l: F.when(s["done"], s).otherwise(F.struct(F.concat(s["text"], F.lit(" "), F.regexp_replace(l, r"\A\s+|\s+\z", "")).alias("text"), ends(l).alias("done")))
    begin = F.struct(F.col("_c.rest").alias("text"), F.col("_c.rest").rlike(r"\)(?:;)?\s*\z").alias("done"))
    whole = called.withColumn("_s", F.aggregate("more", begin, step, lambda s: s["text"]))
    return _told(whole, language, 1)


def _there(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column, those where it is null left out. It is worked out once: a filter on it would work it out again."""
    return rows.withColumn(name, F.explode(F.filter(F.array(value), lambda x: x.isNotNull())))


def _told(called: DataFrame, language: str | Language, least: int) -> DataFrame:
    said = _there(called.select("fid", "n", F.col("_c.level").alias("level"), "_s"), "_q", languages.quoted(F.col("_s")))
    told = _there(said, "frags", languages.fragments(F.col("_q"), language)).withColumn("text", F.array_join("frags", ""))
    return told.filter((F.size("frags") > 0) & (F.length("text") >= least)).select("fid", (F.col("n") + 1).alias("line"), "level", "text", "frags")
