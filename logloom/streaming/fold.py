"""State of a session from its events: one transition for streams and for tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

#: State of a session: events and different lines so far, phase, whether a red run came, whether it is green since then.
STATE = "events bigint, lines bigint, phase string, red boolean, green boolean"
FRAMES = "session_id string, seq bigint, event string, id string, data string"


#: What a stream keeps of a session: counts and the places of the events that decide. Rows may come in any order.
MARKS = "events bigint, lines bigint, step bigint, step_event string, first_red bigint, last_red bigint, last_green bigint"
NO_MARKS = (0, 0, None, None, None, None, None)


def marked(marks: tuple, event: str, seq: int) -> tuple:
    """The marks with one more event; the result doesn't depend on the order of calls."""
    events, lines, step, step_event, first_red, last_red, last_green = marks
    if event == "red":
        first_red = seq if first_red is None else min(seq, first_red)
        last_red = seq if last_red is None else max(seq, last_red)
    elif event == "green":
        last_green = seq if last_green is None else max(seq, last_green)
    elif event in ("started", "done") and (step is None or (seq, event) > (step, step_event)):
        step, step_event = seq, event
    return events, lines, step, step_event, first_red, last_red, last_green


def told(marks: tuple) -> tuple:
    """The state that marks tell: a red run resets green, and green counts behind a red run only."""
    events, lines, step, step_event, first_red, last_red, last_green = marks
    places = [(step, step_event), (last_red, "reproduced")]
    if last_red is not None and last_green is not None and last_green > first_red:
        places.append((last_green, "verified"))
    phase = max((p for p in places if p[0] is not None), default=(None, None))[1]
    return events, lines, phase, last_red is not None, last_red is not None and last_green is not None and last_green > last_red


def folded(events: DataFrame, session: str = "session_id", order: str = "seq") -> DataFrame:
    """The last state of each session, by aggregation: sums, and the last red, green and phase by order."""
    last = lambda cond: F.max(F.when(cond, F.col(order)))
    red = events.groupBy(session).agg(F.min(F.when(F.col("event") == "red", F.col(order))).alias("_first_red"))
    joined = events.join(red, session)
    counts = F.col("event").isin("started", "done", "red") | ((F.col("event") == "green") & (F.col(order) > F.col("_first_red")))
    out = joined.groupBy(session).agg(F.count("*").alias("events"), F.count_distinct(F.when(F.col("event") == "line", F.col("id"))).alias("lines"), F.max_by("event", F.when(counts, F.col(order))).alias("_phase"), last(F.col("event") == "red").alias("_red"), last(F.col("event") == "green").alias("_green"))
    phase = F.when(F.col("_phase") == "red", "reproduced").when(F.col("_phase") == "green", "verified").otherwise(F.col("_phase"))
    return out.select(session, "events", "lines", phase.alias("phase"), F.col("_red").isNotNull().alias("red"), F.coalesce(F.col("_green") > F.col("_red"), F.lit(False)).alias("green"))


class SessionFold(StatefulProcessor):
    """Keeps each session's marks and the ids of its lines; gives the state after each batch, however late rows come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.marks = handle.getValueState("marks", MARKS)
        self.seen = handle.getMapState("seen", "id string", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        marks = tuple(self.marks.get()) if self.marks.exists() else NO_MARKS
        for pdf in rows:
            events, lines, *places = marks
            for id_ in pdf.loc[pdf["event"] == "line", "id"].dropna().unique():
                if not self.seen.containsKey((id_,)):
                    self.seen.updateValue((id_,), (1,))
                    lines += 1
            marks = (events + len(pdf), lines, *places)
            for event, seq in zip(pdf["event"], pdf["seq"], strict=True):
                marks = marked(marks, event, int(seq))
        self.marks.update(marks)
        yield pd.DataFrame([[key[0], *told(marks)]], columns=["session_id", "events", "lines", "phase", "red", "green"])

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame) -> DataFrame:
    """The state of each session after each batch of a stream of events (session_id, seq, event, id)."""
    return events.groupBy("session_id").transformWithStateInPandas(SessionFold(), f"session_id string, {STATE}", "Update", "None")


class FrameReader(StatefulProcessor):
    """Puts chunks of an SSE stream together: what stands behind the last blank line waits for the next chunk.

    A chunk that comes before its turn waits in the state, one that comes again is left out. A null chunk ends the stream:
    what stands behind the last blank line is then a frame too.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getValueState("rest", "text string, seq bigint, next bigint")
        self.early = handle.getMapState("early", "n bigint", "chunk string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        text, seq, turn = tuple(self.rest.get()) if self.rest.exists() else ("", 0, 0)
        waited = {k[0]: v[0] for k, v in self.early.iterator()}
        waiting, ready, ended, out = dict(waited), [text], False, []
        for pdf in rows:
            for n, chunk in zip(pdf["n"], pdf["chunk"], strict=True):
                if n >= turn:
                    waiting[int(n)] = None if pd.isna(chunk) else chunk
            while turn in waiting:
                chunk = waiting.pop(turn)
                ended |= chunk is None
                ready.append(chunk or "")
                turn += 1
        for n in waited.keys() - waiting.keys():
            self.early.removeKey((n,))
        for n in waiting.keys() - waited.keys():
            self.early.updateValue((n,), (waiting[n],))
        text = "".join(ready)
        held = "\r" if text.endswith("\r") and not ended else ""  # it may be half of a line end
        *whole, text = text[: len(text) - len(held)].replace("\r\n", "\n").replace("\r", "\n").split("\n\n")
        if ended:
            whole, text = [*whole, text], ""
        for frame in whole:
            found: dict[str, list[str]] = {}
            for line in frame.split("\n"):
                name, colon, value = line.partition(":")
                if name and colon:
                    found.setdefault(name, []).append(value.removeprefix(" "))
            if found.keys() & {"data", "event", "id"}:
                out.append((key[0], seq, "\n".join(found.get("event", ["message"])), "\n".join(found["id"]) if "id" in found else None, "\n".join(found["data"]) if "data" in found else None))
                seq += 1
        self.rest.update((text + held, seq, turn))
        yield pd.DataFrame(out, columns=["session_id", "seq", "event", "id", "data"])

    def close(self) -> None:
        pass


def frame_stream(chunks: DataFrame) -> DataFrame:
    """Frames of a stream of chunks (session_id, n, chunk); n counts a session's chunks from 0, a chunk may end anywhere."""
    return chunks.groupBy("session_id").transformWithStateInPandas(FrameReader(), FRAMES, "Append", "None")


def run_kind(reports: DataFrame, session: str = "session_id", order: str = "seq") -> DataFrame:
    """Adds kind to reports (is_broken, is_green): reproduce, verify (green behind red) or baseline."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    red = F.coalesce(F.max(F.col("is_broken").cast("int")).over(w), F.lit(0)) == 1
    return reports.withColumn("kind", F.when(F.col("is_broken"), "reproduce").when(F.col("is_green") & red, "verify").otherwise("baseline"))
