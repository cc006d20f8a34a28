"""Attribution of entries to functions: tiers with confidence, previous functions, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import hops_between, written
from .substrings import contained
from .templates import matched

# Confidence of each way to a function.
CONFIDENCE = {"stack": 0.95, "hit": 0.85, "class": 0.60, "neighbour": 0.55}
SHORTEST = 5
#: Stands for a function that is told but isn't in the graph.
UNKNOWN = -1
#: Packages of the platform, whose frames are no application's.
PLATFORM = ["java.", "javax.", "sun.", "com.sun.", "jdk.", "groovy.", "org.codehaus.groovy"]


def first_pass(entries: DataFrame, templates: DataFrame, stacks: DataFrame | None = None, idx: str = "entry_idx", text: str = "static_text") -> DataFrame:
    """entries with status (stack_trace, skip, miss, hit, ambiguous), tier, confidence, fid, fname and candidates.

    stacks: idx of entries with a stack trace. Templates with equal fragments are put together first, then matched against
    distinct messages and joined back. The status comes from a message's smallest and largest candidate, so all of them are
    only brought together where they are asked for.
    """
    one = F.struct("fid", "fname", "line")
    equal = templates.groupBy("frags").agg(F.min(one).alias("_low"), F.max(one).alias("_high"), F.collect_set(one).alias("_all"))
    found = matched(entries, equal, text).groupBy(text).agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_all")))).alias("candidates"))
    out = entries.join(found, text, "left")
    if stacks is not None:
        out = out.join(stacks.select(idx, F.lit(True).alias("_stack")).distinct(), idx, "left")
    else:
        out = out.withColumn("_stack", F.lit(None).cast("boolean"))
    n = F.when(F.col("_low").isNull(), 0).when(F.col("_low").eqNullSafe(F.col("_high")), 1).otherwise(2)
    status = F.when(F.col("_stack"), "stack_trace").when(F.coalesce(F.length(text), F.lit(0)) < SHORTEST, "skip").when(n == 0, "miss").when(n == 1, "hit").otherwise("ambiguous")
    out = out.withColumn("status", status).drop("_stack")
    return out.withColumns({
        "tier": F.when(F.col("status") == "stack_trace", 1).when(F.col("status") == "hit", 2).otherwise(4),
        "confidence": F.when(F.col("status") == "stack_trace", CONFIDENCE["stack"]).when(F.col("status") == "hit", CONFIDENCE["hit"]).otherwise(0.0),
        "fid": F.when(F.col("status") == "hit", F.col("_low.fid")),
        "fname": F.when(F.col("status") == "hit", F.col("_low.fname")),
    }).drop("_low", "_high")


def app_frames(frames: Column, markers: list[str]) -> Column:
    """Frames that aren't a framework's (else the first one); of more than four the first two and the last two."""
    own = frames
    for m in markers:
        own = F.filter(own, _not(m))
    own = F.when(F.size(own) == 0, F.slice(frames, 1, 1)).otherwise(own)
    head = F.slice(own, 1, 2)
    return F.when(F.size(own) > 4, F.concat(head, F.array_except(F.slice(own, -2, 2), head))).otherwise(own)


def _not(marker: str):
    return lambda f: ~F.startswith(f, F.lit(marker))


def hop_score(hops: Column, same: Column, first: Column) -> Column:
    """0.4 without a previous function, 0.9 for the same one, else 0.4 and half a point by hops; 0.4 where no path leads."""
    return F.when(first, 0.4).when(same, 0.9).when(hops > 0, 0.4 + 0.5 / hops).otherwise(0.4)


def previous_on_thread(entries: DataFrame, thread: str, idx: str, function: str) -> DataFrame:
    """Adds previous: the last non-null function on the same thread before the entry."""
    w = Window.partitionBy(thread).orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("previous", F.last(function, ignorenulls=True).over(w))


def transitions(sets: DataFrame, hops: DataFrame) -> DataFrame:
    """before, candidates, moves: what candidates are decided to be, by the id that came before.

    sets: before, candidates (arrays of ids), once each. hops: src, dst, hops. moves: map from an id of `before` that is a
    candidate or leads to one, to (decision, fid, score); '' has the same for all other ids and for none, with the smallest
    candidate and a score of 0.4. Ids meet candidates through the hops, so no set is multiplied by another.
    """
    keyed = sets.select("before", "candidates", F.xxhash64("before", "candidates").alias("_k"))
    before = keyed.select("before", "candidates", "_k", F.explode("before").alias("previous")).distinct()
    after = keyed.select("_k", F.explode("candidates").alias("fid")).distinct()
    same = before.select(F.col("previous").alias("src"), F.col("previous").alias("dst"), F.lit(0).alias("hops")).distinct()
    known = hops.select("src", "dst", F.col("hops").cast("int").alias("hops")).filter("src <> dst").unionByName(same)
    led = before.join(known, before["previous"] == known["src"]).join(after.withColumnRenamed("fid", "dst"), ["_k", "dst"])
    score = hop_score(F.col("hops"), F.col("hops") == 0, F.lit(False))
    top = led.groupBy("before", "candidates", "previous").agg(F.slice(F.array_sort(F.collect_list(F.struct((-score).alias("s"), F.col("dst").alias("fid")))), 1, 2).alias("_t"))
    first = -F.get("_t", F.lit(0))["s"]
    next_ = F.when(F.size("_t") > 1, -F.get("_t", F.lit(1))["s"]).when(F.size(F.array_distinct("candidates")) > 1, 0.4).otherwise(0.0)
    moves = top.select("before", "candidates", F.struct(F.col("previous").cast("string").alias("state"), _decision(first, next_, F.get("_t", F.lit(0))["fid"]).alias("move")).alias("m"))
    told = moves.groupBy("before", "candidates").agg(F.map_from_entries(F.collect_list("m")).alias("moves"))
    other = _decision(F.lit(0.4), F.when(F.size(F.array_distinct("candidates")) > 1, 0.4).otherwise(0.0), F.array_min("candidates"))
    plain = F.create_map(F.lit(""), other)
    return sets.join(told, ["before", "candidates"], "left").select("before", "candidates", F.when(F.col("moves").isNull(), plain).otherwise(F.map_concat("moves", plain)).alias("moves"))


def _decision(score: Column, following: Column, fid: Column) -> Column:
    """resolved if the score is over 0.5 and 0.2 ahead of the next one, a branch point over 0.3, else open."""
    told = F.when((score > 0.5) & (score - following > 0.2), "resolved").when(score > 0.3, "branch").otherwise("open")
    return F.struct(told.alias("decision"), fid.cast("bigint").alias("fid"), score.cast("double").alias("score"))


def thread_steps(entries: DataFrame, thread: str, idx: str, block: int) -> DataFrame:
    """_t, _b, _i, ids, ambiguous, before: entries that set or need a previous function, with what may stand before them.

    A thread is cut into blocks of positions; what enters a block comes from a table of blocks, so no thread is one task.
    """
    ambiguous = F.col("status") == "ambiguous"
    ids = F.when(ambiguous, F.array_sort(F.array_distinct("candidates"))).otherwise(F.array("fid"))
    walk = entries.filter(ambiguous | F.col("fid").isNotNull()).select(F.col(thread).cast("string").alias("_t"), F.floor(F.col(idx) / block).alias("_b"), F.col(idx).alias("_i"), ids.alias("ids"), ambiguous.alias("ambiguous"))
    last = walk.groupBy("_t", "_b").agg(F.max_by("ids", "_i").alias("_last"))
    entering = last.select(F.col("_t").alias("_t2"), F.col("_b").alias("_b2"), F.lag("_last").over(Window.partitionBy("_t").orderBy("_b")).alias("_enter"))
    inner = walk.withColumn("_before", F.lag("ids").over(Window.partitionBy("_t", "_b").orderBy("_i")))
    both = inner.join(entering, inner["_t"].eqNullSafe(entering["_t2"]) & (F.col("_b") == F.col("_b2")))
    return both.select("_t", "_b", "_i", "ids", "ambiguous", F.coalesce("_before", "_enter", F.array().cast("array<bigint>")).alias("before"))


def _in_order(steps: DataFrame, keys: list[str], order: str, run, schema: str) -> DataFrame:
    """Rows of equal keys side by side and in order, streamed through `run`, which holds a batch at a time."""
    return steps.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, order).mapInPandas(run, schema)


def _move(moves: dict, state: str):
    return moves.get(state) or moves[""]


def _ends(batches):
    """What each state that may enter a block leaves it as."""
    import pandas as pd

    key, ends = None, {}
    for pdf in batches:
        out = []
        for t, b, before, fid, ambiguous, moves in zip(*[pdf[c] for c in ("_t", "_b", "before", "fid", "ambiguous", "moves")], strict=True):
            if (t, b) != key:
                out += [(*key, *x) for x in ends.items()] if key else []
                key, ends = (t, b), {s: s for s in ["", *(str(int(x)) for x in before)]}
            told = dict(moves) if ambiguous else {}
            ends = {s: str(_move(told, now)["fid"] if ambiguous else int(fid)) for s, now in ends.items()}
        yield pd.DataFrame(out, columns=["_t", "_b", "start", "stop"])
    yield pd.DataFrame([(*key, *x) for x in ends.items()] if key else [], columns=["_t", "_b", "start", "stop"])


def _starts(batches):
    """The state that does enter each block: blocks of a thread in order."""
    import pandas as pd

    thread, state = ..., ""
    for pdf in batches:
        out = []
        for t, b, ends in zip(pdf["_t"], pdf["_b"], pdf["ends"], strict=True):
            state = state if t == thread else ""
            thread = t
            out.append((t, b, state))
            state = dict(ends)[state]
        yield pd.DataFrame(out, columns=["_t", "_b", "enters"])


def _decisions(batches):
    import pandas as pd

    key, state = None, ""
    for pdf in batches:
        out = []
        for t, b, i, enters, fid, ambiguous, moves in zip(*[pdf[c] for c in ("_t", "_b", "_i", "enters", "fid", "ambiguous", "moves")], strict=True):
            if (t, b) != key:
                key, state = (t, b), enters
            if ambiguous:
                move = _move(dict(moves), state)
                out.append((i, move["decision"], move["fid"], move["score"]))
                state = str(move["fid"])
            else:
                state = str(int(fid))
        yield pd.DataFrame(out, columns=["_i", "decision", "fid", "score"])


def ambiguous_on_thread(entries: DataFrame, hops: DataFrame | None = None, thread: str = "thread_id", idx: str = "entry_idx", calls: DataFrame | None = None, block: int = 50_000) -> DataFrame:
    """idx, decision, fid, score of ambiguous entries, each scored by hops from the last function told on its thread.

    entries: idx, thread, status, fid (of those that count as told), candidates (array of fid, at least one). The best
    candidate of an ambiguous entry, resolved or branch, is the previous function of those behind it. hops: src, dst,
    hops; without them they are searched in `calls`. Entries with a null thread are one thread. Moves are worked out once
    for each distinct pair of candidate sets; blocks of a thread are walked side by side for every state that may enter
    them, then again from the one that does. Nothing is held but a batch and the states that may enter a block.
    """
    steps = written(thread_steps(entries, thread, idx, block))
    sets = written(steps.filter("ambiguous").select("before", F.col("ids").alias("candidates")).distinct())
    if hops is None:
        hops = hops_between(sets.select(F.explode("before").alias("id")), sets.select(F.explode("candidates").alias("id")), calls)
    known = transitions(sets, hops).withColumnRenamed("candidates", "ids").withColumn("ambiguous", F.lit(True))
    ready = written(steps.join(known, ["before", "ids", "ambiguous"], "left").select("_t", "_b", "_i", "before", F.get("ids", F.lit(0)).alias("fid"), "ambiguous", "moves"))
    ends = _in_order(ready, ["_t", "_b"], "_i", _ends, "_t string, _b bigint, start string, stop string")
    blocks = ends.groupBy("_t", "_b").agg(F.map_from_entries(F.collect_list(F.struct("start", "stop"))).alias("ends"))
    starts = _in_order(blocks, ["_t"], "_b", _starts, "_t string, _b bigint, enters string").withColumnsRenamed({"_t": "_t2", "_b": "_b2"})
    entered = ready.join(starts, ready["_t"].eqNullSafe(starts["_t2"]) & (F.col("_b") == F.col("_b2"))).drop("_t2", "_b2")
    return _in_order(entered, ["_t", "_b"], "_i", _decisions, "_i bigint, decision string, fid bigint, score double").withColumnRenamed("_i", idx)


def near_resolved(entries: DataFrame, idx: str, tier: str, thread: str | None = None, reach: int = 3) -> DataFrame:
    """idx of unresolved entries (tier 4) with a resolved one at most `reach` positions away, on the same thread if given.

    Resolved positions are spread over the positions they can help and joined by position.
    """
    helpers = entries.filter(F.col(tier) <= 3).select(F.explode(F.sequence(F.col(idx) - reach, F.col(idx) + reach)).alias(idx), *([F.col(thread).alias("_t")] if thread else []))
    open_ = entries.filter(F.col(tier) == 4)
    if thread:
        return open_.join(helpers.distinct(), (open_[idx] == helpers[idx]) & open_[thread].eqNullSafe(helpers["_t"]), "left_semi").select(idx)
    return open_.join(helpers.distinct(), idx, "left_semi").select(idx)


def logger_class(line: Column, patterns: list[str]) -> Column:
    """The logger of a line: group `logger` of the first pattern that matches (null where it is empty), else the word between ] and a colon."""
    from ..config import group_names, java

    found = F.nullif(F.regexp_extract(line, r"\]\s+([\w.$]+)\s+:", 1), F.lit(""))
    for p in reversed(patterns):
        whole, names = java(p, anchored=True), group_names(p)
        told = F.nullif(F.regexp_extract(line, whole, names.index("logger") + 1), F.lit("")) if "logger" in names else F.nullif(F.regexp_extract(line, r"\]\s+([\w.$]+)\s+:", 1), F.lit(""))
        found = F.when(line.rlike(whole), told).otherwise(found)
    return found


def by_class(entries: DataFrame, candidates: DataFrame, idx: str = "entry_idx", text: str = "static_text") -> DataFrame:
    """idx, fid, rule of entries whose logger class is known: of the class's functions, the likeliest for the message.

    entries: idx, text, class_name. candidates: class_name, fid, name, source (may be absent), templates (array of texts).
    The longest function name in the message leads: it wins if a template of its own is there (rule 0), else the first
    function with a template there does (1), else it wins all the same (2). Without a name, the first function whose
    source holds the head of the message (3), or with a template there (4). Ties and firsts go by fid. Entries with an
    empty message have no candidate. Names, templates and heads meet texts of their class by their rarest three characters; the
    distinct texts are written first, as each of these asks for them several times.
    """
    functions = candidates if "source" in candidates.columns else candidates.withColumn("source", F.lit(None).cast("string"))
    functions = functions.select("class_name", "fid", "name", "source", F.coalesce("templates", F.array().cast("array<string>")).alias("templates"))
    by = ["class_name"]
    messages = written(entries.filter(F.length(text) > 0).select("class_name", F.col(text).alias("_m")).distinct())
    head = F.trim(F.substring_index(F.substring_index(F.regexp_replace(F.trim("_m"), "^[- ]+", ""), "---", 1), ":", 1))
    heads = messages.withColumn("_h", F.substring(head, 1, 40)).filter(F.length("_h") > 5)
    own = functions.select("class_name", "fid", F.lower("name").alias("_n"), F.length("name").alias("_size")).filter("_n <> ''")
    low = messages.withColumn("_low", F.lower("_m"))
    said = contained(low, own, "_low", "_n", by).drop("at").join(low, [*by, "_low"]).join(own, [*by, "_n"])
    best = said.groupBy(*by, "_m").agg(F.min(F.struct((-F.col("_size")).alias("n"), "fid")).alias("_w"))
    texts = functions.select("class_name", "fid", F.explode("templates").alias("_x")).filter(F.length("_x") > 3).distinct()
    told = contained(messages, texts, "_m", "_x", by).drop("at").join(texts, [*by, "_x"]).groupBy(*by, "_m", "fid").agg(F.max(F.length("_x")).alias("_l"))
    sources = functions.select("class_name", "fid", "source").filter("source IS NOT NULL")
    sourced = contained(sources, heads, "source", "_h", by).drop("at").join(sources, [*by, "source"]).groupBy(*by, "_h").agg(F.min("fid").alias("_s")).join(heads, [*by, "_h"]).select(*by, "_m", "_s")
    first = told.groupBy(*by, "_m").agg(F.min(F.when(F.col("_l") > 5, F.col("fid"))).alias("_t"))
    leads = told.select(*by, "_m", F.col("fid").alias("_f"), F.lit(True).alias("_own"))
    best = best.withColumn("_f", F.col("_w.fid")).join(leads, [*by, "_m", "_f"], "left").drop("_f")
    best = best.join(first, [*by, "_m"], "full").join(sourced, [*by, "_m"], "full")
    named = F.col("_w").isNotNull()
    rule = F.when(named & F.col("_own"), 0).when(named & F.col("_t").isNotNull(), 1).when(named, 2).when(F.col("_s").isNotNull(), 3).when(F.col("_t").isNotNull(), 4)
    fid = F.when(rule.isin(0, 2), F.col("_w.fid")).when(rule == 3, F.col("_s")).otherwise(F.col("_t"))
    chosen = best.select("class_name", F.col("_m").alias(text), fid.alias("fid"), rule.alias("rule")).filter("rule IS NOT NULL")
    return entries.select(idx, "class_name", text).join(chosen, ["class_name", text]).select(idx, "fid", "rule")


def attributed(entries: DataFrame, templates: DataFrame, functions: DataFrame, calls: DataFrame, idx: str = "entry_idx", thread: str = "thread_id", text: str = "static_text", by_thread: bool = True) -> DataFrame:
    """Entries to functions, all tiers: idx, status, tier, confidence, fid, fids, inferred, fname and line of a template's, previous functions taken into account.

    entries: idx, thread, text, class_name (of the logger, may be null), stack (whether a trace is there), frame (its
    first frame of the application as `class.function`, null if it has none). templates: fid, frags, fname, line. functions: fid, class_name, name,
    source, templates. calls: src, dst. In order:

    * tier 1, a stack frame (0.95; without an fid where no function is called so, and then nothing is near it);
    * tier 2, the only template that fits (0.85);
    * tier 3, a function of the logger's class (0.60), or of several templates the likeliest after the function that the
      thread told last (by frame, class or choice; the score is the confidence), with the three best where none leads;
    * tier 3, by class, for what is left near a told entry (0.55); tier 4 otherwise.
    """
    source = entries.select(idx, F.col(thread).cast("string").alias(thread) if by_thread else F.lit(None).cast("string").alias(thread), text, "class_name", F.coalesce("stack", F.lit(False)).alias("stack"), "frame")
    first = first_pass(source, templates, source.filter("stack").select(idx), idx, text).drop("tier", "confidence")
    by_name = functions.groupBy(F.concat_ws(".", "class_name", "name").alias("frame")).agg(F.min("fid").alias("_frame_fid"))
    first = written(first.join(by_name, "frame", "left").withColumn("fids", F.transform("candidates", lambda c: c["fid"])))
    classes = by_class(first.filter(F.col("status").isin("miss", "skip")), functions, idx, text).select(idx, F.col("fid").alias("_class_fid"))
    told = written(first.join(classes, idx, "left"))
    unknown = F.when((F.col("status") == "stack_trace") & F.col("frame").isNotNull(), F.coalesce("_frame_fid", F.lit(UNKNOWN)))
    counts = F.coalesce(unknown, F.col("_class_fid"))
    walked = ambiguous_on_thread(told.select(idx, thread, "status", counts.alias("fid"), F.col("fids").alias("candidates")), None, thread, idx, calls)
    walked = walked.select(idx, "decision", F.col("fid").alias("_best"), "score")
    out = told.join(walked, idx, "left")
    ambiguous = F.col("status") == "ambiguous"
    framed = (F.col("status") == "stack_trace") & F.col("frame").isNotNull()
    kept = F.when(F.col("decision") == "branch", F.slice(F.concat(F.array("_best"), F.array_remove(F.array_sort("fids"), F.col("_best"))), 1, 3))
    out = out.select(
        idx, thread, text, "class_name", "status", F.coalesce("decision", F.lit("")).alias("decision"),
        F.when(framed, 1).when(F.col("status") == "hit", 2).when(ambiguous & (F.col("decision") != "open"), 3).when(F.col("_class_fid").isNotNull(), 3).otherwise(4).alias("tier"),
        F.when(framed, F.lit(CONFIDENCE["stack"])).when(F.col("status") == "hit", F.lit(CONFIDENCE["hit"])).when(ambiguous & (F.col("decision") != "open"), F.col("score")).when(F.col("_class_fid").isNotNull(), F.lit(CONFIDENCE["class"])).otherwise(F.lit(0.0)).alias("confidence"),
        F.coalesce("fid", F.when(ambiguous & (F.col("decision") != "open"), F.col("_best")), F.nullif(counts, F.lit(UNKNOWN))).alias("fid"),
        kept.alias("fids"), F.col("_class_fid").isNotNull().alias("inferred"), "fname", F.when(F.col("status") == "hit", F.get("candidates", F.lit(0))["line"]).alias("line"),
    )
    out = written(out)
    near = near_resolved(out, idx, "tier", thread if by_thread else None)
    lost = written(out.filter("tier = 4 AND class_name IS NOT NULL").join(near, idx, "left_semi").select(idx, "class_name", text))
    again = by_class(lost, functions, idx, text).select(idx, F.col("fid").alias("_near_fid"))
    hit = F.col("_near_fid").isNotNull()
    final = out.join(again, idx, "left")
    return final.withColumns({"tier": F.when(hit, 3).otherwise(F.col("tier")), "confidence": F.when(hit, CONFIDENCE["neighbour"]).otherwise(F.col("confidence")), "fid": F.coalesce("fid", "_near_fid"), "inferred": F.col("inferred") | hit}).drop("_near_fid", text, "class_name")
