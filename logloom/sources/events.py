"""Server-sent events, reviews and other JSON that arrives in pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REVIEWS = "array<struct<id:bigint,user:struct<login:string>,path:string,line:int,original_line:int,body:string,html_url:string>>"


def frames(text: Column) -> Column:
    """Frames of a whole SSE text: parts between blank lines, whatever the line ends."""
    return F.filter(F.split(F.regexp_replace(text, "\r\n|\r", "\n"), "\n\n+"), lambda f: F.trim(f) != "")


def frame_field(frame: Column, name: str) -> Column:
    """Values of a field of a frame, one leading space cut, joined by line breaks; null where it is absent."""
    own = F.filter(F.split(frame, "\n"), lambda x: F.startswith(x, F.lit(f"{name}:")))
    values = F.transform(own, lambda x: F.regexp_replace(x, f"^{name}: ?", ""))
    return F.when(F.size(own) > 0, F.array_join(values, "\n"))


def messages(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, seq, event, id, data of each frame with data, an event or an id; comments don't count."""
    each = df.select(key, F.posexplode(frames(F.col(text))).alias("seq", "f"))
    told = each.select(key, "seq", F.coalesce(frame_field(F.col("f"), "event"), F.lit("message")).alias("event"), frame_field(F.col("f"), "id").alias("id"), frame_field(F.col("f"), "data").alias("data"))
    return told.filter(F.col("data").isNotNull() | F.col("id").isNotNull() | (F.col("event") != "message"))


def review_comments(pages: DataFrame, column: str, bots: list[str]) -> DataFrame:
    """id, reviewer, file_path, line, body, url of comments by the given reviewers with a body; pages are JSON arrays."""
    one = pages.select(F.explode(F.from_json(column, REVIEWS)).alias("c"))
    kept = one.filter(F.lower("c.user.login").isin([b.lower() for b in bots]) & (F.trim("c.body") != ""))
    return kept.select("c.id", F.col("c.user.login").alias("reviewer"), F.col("c.path").alias("file_path"), F.coalesce("c.line", "c.original_line").alias("line"), "c.body", F.col("c.html_url").alias("url"))


def rows_of(text: Column, keys: list[str]) -> Column:
    """The array under the first of the given keys that a JSON text holds (or the text itself, if it is an array), as variants."""
    parsed = F.try_parse_json(text)
    inner = [F.try_variant_get(parsed, f"$.{k}", "array<variant>") for k in keys]
    return F.coalesce(*inner, F.try_variant_get(parsed, "$", "array<variant>"))


def salvaged(reply: Column) -> Column:
    """JSON of a model's reply: of a fenced block, else the text, else its largest bracketed part; null if none is valid."""
    fenced = F.trim(F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)\s*```", 1))
    part = lambda p: F.nullif(F.regexp_extract(reply, p, 0), F.lit(""))
    options = [F.nullif(fenced, F.lit("")), F.trim(reply), part(r"(?s)\[.*\]"), part(r"(?s)\{.*\}")]
    return F.coalesce(*[F.when(F.try_parse_json(o).isNotNull(), o) for o in options])
