"""The whole state of a session from its events: by aggregation for tables, by a stateful stream, whatever the order of rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

# What a session begins with, and the types of its events.
TAB = "environment"
NODES = ["release", "imports", "tests", "errors", "patch", "verify"]
RED, GREEN, LINE, RESET, CLOCK = "tests.red_observed", "tests.green_observed", "sandbox.line.appended", "mission.reset", "clock.ticked"
STATUS = {"runtime.connecting": "connecting", "runtime.connected": "idle", "runtime.turn.started": "streaming", "runtime.turn.completed": "completed", "runtime.failed": "failed", "approval.required": "awaiting_approval"}
TYPES = [*STATUS, RED, GREEN, LINE, RESET, CLOCK, "sandbox.connected", "proof.node.updated", "selection.changed", "dock.toggled", "inspector.tab.changed", "popout.toggled", "approval.submitting", "approval.resolved", "approval.failed", "approval.approved", "approval.denied", "patch.observed"]

#: An event: what it says (an id, a message, a decision, a tab or a time), a node's status, a number of tests, and evidence of a run.
EVENT = "session_id string, seq bigint, type string, text string, status string, n bigint, run string, phase string, exit_code bigint"
STATE = (
    "status string, error string, connection string, turn string, sandbox string, nodes array<string>, lines bigint, red boolean, green boolean, red_tests bigint, green_tests bigint, "
    "pending string, submission string, approval_error string, approved boolean, patch string, selected string, dock_open boolean, tab string, popout boolean, clock string"
)
_FIELDS = [f.split()[0] for f in STATE.split(", ")]
_EVENT = [f.split()[0] for f in EVENT.split(", ")][1:]
_ROW = Row("session_id", *_FIELDS)
#: So many events and lines of a session are kept in one value of its stream's state, and so many events in each chunk beyond.
HELD = 1000
_WHERE = {"mission.reset": "currentTime", "clock.ticked": "currentTime", "runtime.connected": "sessionId", "runtime.turn.started": "turnId", "sandbox.connected": "sandboxId", "proof.node.updated": "nodeId", "selection.changed": "nodeId", LINE: "line.id", "inspector.tab.changed": "tab", "approval.required": "request.id", "approval.resolved": "decision", "patch.observed": "patch.id"}


def parsed(frames: DataFrame, data: str = "data") -> DataFrame:
    """Events (see EVENT) of JSON frames (session_id, seq, data); types that aren't known, and broken JSON, are left out."""
    v = F.try_parse_json(data)
    at = lambda path, kind="string": F.try_variant_get(v, f"$.{path}", kind)
    kind = at("type")
    text = at("message")
    for name, path in _WHERE.items():
        text = F.when(kind == name, at(path)).otherwise(text)
    run = F.when(at("evidence.phase").isNotNull(), F.concat_ws("\u0001", *[F.coalesce(at(f"evidence.{c}"), F.lit("")) for c in ("missionId", "sandboxId", "selectionKey")]))
    told = frames.select("session_id", "seq", kind.alias("type"), text.alias("text"), at("status").alias("status"), F.coalesce(at("failed", "bigint"), at("passed", "bigint")).alias("n"), run.alias("run"), at("evidence.phase").alias("phase"), at("evidence.exitCode", "bigint").alias("exit_code"))
    return told.filter(F.col("type").isin(TYPES))


def _baseline() -> Column:
    return F.coalesce(F.col("phase") == "baseline", F.lit(False))


def states(events: DataFrame, live: bool = True) -> DataFrame:
    """session_id and STATE of each session, from events (see EVENT; seq differs within a session).

    nodes has the nodes that were heard of, with their status; the others are pending. Only what comes behind a session's
    last reset counts, but for the clock. A red run resets what is green and approved;
    green counts behind a red run; a baseline run is neither. Who approves by hand is heard while nothing is decided and the
    evidence of the last red and green run agrees (live: once an approval is asked for). All of it is the last event of
    some kind behind others, so events are dealt and ordered once, and sums and maxima are taken in that order.
    """
    # of a line's rows only its last place counts: each is one row before events meet
    own = [c for c in events.columns if c not in ("session_id", "seq", "type", "text")]
    lines = events.filter(F.col("type") == LINE).groupBy("session_id", "text").agg(F.max("seq").alias("seq")).withColumn("type", F.lit(LINE))
    few = events.filter(~F.col("type").eqNullSafe(LINE)).unionByName(lines.withColumns({c: F.lit(None).cast(events.schema[c].dataType) for c in own}))
    # one order by session for all that follows
    order = Window.partitionBy("session_id").orderBy("seq")
    whole, before = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    low = F.lit(-(2**62))
    e = few.withColumn("_reset", F.coalesce(F.max(F.when(F.col("type") == RESET, F.col("seq"))).over(whole), low))
    tick = F.col("type").isin(CLOCK, RESET) & F.col("text").isNotNull()
    e = e.withColumn("_tick", F.when(tick, F.col("seq"))).withColumn("type", F.when(F.col("seq") > F.col("_reset"), F.col("type"))).drop("_reset")
    red = (F.col("type") == RED) & ~_baseline()
    e = e.withColumns({"_first": F.min(F.when(red, F.col("seq"))).over(whole), "_last": F.coalesce(F.max(F.when(red, F.col("seq"))).over(whole), low), "_asked": F.min(F.when(F.col("type") == "approval.required", F.col("seq"))).over(whole)})
    is_ = lambda *names: F.col("type").isin(*names)
    seen = is_(GREEN) & ~_baseline() & (F.col("seq") > F.col("_first"))
    behind = F.col("seq") > F.col("_last")
    last = lambda cond, *what: F.max_by(F.struct(*what), F.when(cond, F.col("seq")))
    # runs and approvals behind the last red run, in order
    proof = F.struct("run", "phase", "exit_code")
    e = e.withColumns({"_r": F.last(F.when(red & (F.col("seq") == F.col("_last")), proof), True).over(before), "_g": F.last(F.when(seen & behind, proof), True).over(before), "_s": F.last(F.when(behind & is_("approval.submitting", "approval.failed"), F.col("type")), True).over(before), "_done": F.max((behind & is_("approval.resolved")).cast("int")).over(before)})
    agree = (F.col("_r.run") == F.col("_g.run")) & (F.col("_r.phase") == "reproduce") & (F.col("_g.phase") == "verify") & (F.col("_r.exit_code") != 0) & (F.col("_g.exit_code") == 0)
    may = F.coalesce(agree, F.lit(False)) & F.coalesce(F.col("_s") != "approval.submitting", F.lit(True)) & (F.coalesce(F.col("_asked") < F.col("seq"), F.lit(False)) if live else F.lit(True))
    by_hand = behind & (F.coalesce("_done", F.lit(0)) == 0) & (is_("approval.denied") | (is_("approval.approved") & may))
    # nodes
    node = F.when(is_("proof.node.updated") & F.col("text").isin(NODES), F.struct(F.col("text").alias("node"), F.col("status").alias("to"))).when(red, F.struct(F.lit("errors").alias("node"), F.lit("red").alias("to"))).when(is_(RED, GREEN) & _baseline(), F.struct(F.lit("tests").alias("node"), F.lit("green").alias("to"))).when(seen, F.struct(F.lit("verify").alias("node"), F.lit("green").alias("to"))).when(is_("patch.observed"), F.struct(F.lit("patch").alias("node"), F.lit("static").alias("to")))
    e = e.withColumn("_x", node)
    heard = {n: f"_node_{n}" for n in NODES}
    nodes = F.array_sort(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat_ws(" ", F.lit(n), F.col(f"{c}.to"))) for n, c in heard.items()])))
    submission = F.when(is_("approval.submitting"), "submitting").when(is_("approval.failed"), "failed").when(is_("approval.resolved"), F.when(F.col("text") == "approve", "accepted").otherwise("denied")).otherwise("idle")
    decides = red | is_("approval.submitting", "approval.failed", "approval.resolved")
    green_tests = F.when(red, 0).when(_baseline(), F.when(F.col("exit_code") == 0, F.col("n")).otherwise(0)).otherwise(F.col("n"))
    out = e.groupBy("session_id").agg(
        last(is_(*STATUS), "type", "seq").alias("_status"), last(is_("runtime.connecting", "runtime.failed"), F.when(is_("runtime.failed"), F.col("text")).alias("x")).alias("_error"),
        last(is_("runtime.connected"), "text").alias("_c"), last(is_("runtime.turn.started"), "text").alias("_t"), last(is_("sandbox.connected"), "text").alias("_b"), F.count_if(is_(LINE) & F.col("text").isNotNull()).alias("lines"),
        F.max(F.when(seen, F.col("seq"))).alias("_green"), last(is_(RED), F.when(_baseline(), 0).otherwise(F.col("n")).alias("x")).alias("_rt"), last(red | seen | (is_(GREEN) & _baseline()), green_tests.alias("x")).alias("_gt"),
        last(is_("approval.required"), "text").alias("_p"), last(decides, submission.alias("x"), "seq").alias("_sub"), last(decides, F.when(is_("approval.failed"), F.col("text")).alias("x")).alias("_ae"),
        last(is_("approval.resolved") & behind, (F.coalesce(F.col("text") == "approve", F.lit(False))).alias("x")).alias("_res"), last(is_("patch.observed"), "text").alias("_patch"), last(is_("selection.changed"), "text").alias("_sel"),
        (F.count_if(is_("dock.toggled")) % 2 == 0).alias("dock_open"), last(is_("inspector.tab.changed"), "text").alias("_tab"), (F.count_if(is_("popout.toggled")) % 2 == 1).alias("popout"), F.first("_last").alias("_last"), F.first("_asked").alias("_asked"),
        F.min(F.when(by_hand, F.struct("seq", "type"))).alias("_hand"), F.max_by("text", "_tick").alias("clock"), *[last(F.col("_x.node") == n, F.col("_x.to").alias("to")).alias(c) for n, c in heard.items()],
    ).withColumn("nodes", nodes)
    status = F.when((F.col("_status.type") == "runtime.turn.completed") & (F.col("_asked") < F.col("_status.seq")), "awaiting_approval")
    for name, value in STATUS.items():
        status = status.when(F.col("_status.type") == name, value)
    denied = (F.col("_hand.type") == "approval.denied") & (F.coalesce(F.col("_sub.seq"), low) < F.col("_hand.seq"))
    return out.select(
        "session_id", status.otherwise("idle" if live else "fixture").alias("status"), F.col("_error.x").alias("error"), F.col("_c.text").alias("connection"), F.col("_t.text").alias("turn"), F.col("_b.text").alias("sandbox"), F.coalesce("nodes", F.array().cast("array<string>")).alias("nodes"), F.coalesce("lines", F.lit(0)).cast("long").alias("lines"),
        F.coalesce(F.col("_last") > low, F.lit(False)).alias("red"), F.coalesce(F.col("_green") > F.col("_last"), F.lit(False)).alias("green"), F.coalesce(F.col("_rt.x"), F.lit(0)).cast("long").alias("red_tests"), F.coalesce(F.col("_gt.x"), F.lit(0)).cast("long").alias("green_tests"),
        F.col("_p.text").alias("pending"), F.when(denied, "denied").otherwise(F.coalesce("_sub.x", F.lit("idle"))).alias("submission"), F.col("_ae.x").alias("approval_error"), F.coalesce(F.col("_res.x"), F.when(F.col("_hand").isNotNull(), F.col("_hand.type") == "approval.approved")).alias("approved"),
        F.col("_patch.text").alias("patch"), F.col("_sel.text").alias("selected"), F.coalesce("dock_open", F.lit(True)).alias("dock_open"), F.coalesce("_tab.text", F.lit(TAB)).alias("tab"), F.coalesce("popout", F.lit(False)).alias("popout"), "clock",
    )


class _State:
    """The state of one session while its events, in order, go by; lines and the clock are kept elsewhere."""

    def __init__(self, live: bool):
        self.live = live
        self.now = dict.fromkeys(_FIELDS) | {"status": "idle" if live else "fixture", "nodes": {}, "lines": 0, "red": False, "green": False, "red_tests": 0, "green_tests": 0, "submission": "idle", "dock_open": True, "tab": TAB, "popout": False}
        self.asked, self.runs = False, [None, None]

    def _agrees(self) -> bool:
        red, green = self.runs
        return bool(red and green and red[0] is not None and red[0] == green[0] and red[1] == "reproduce" and green[1] == "verify" and red[2] not in (None, 0) and green[2] == 0)

    def take(self, e: dict) -> None:
        now, kind, text, run = self.now, e["type"], e["text"], (e["run"], e["phase"], e["exit_code"])
        if kind in STATUS:
            self.asked |= kind == "approval.required"
            now["status"] = "awaiting_approval" if kind == "runtime.turn.completed" and self.asked else STATUS[kind]
        named = {"runtime.connected": "connection", "runtime.turn.started": "turn", "sandbox.connected": "sandbox", "approval.required": "pending", "patch.observed": "patch", "selection.changed": "selected"}
        if kind in named:
            now[named[kind]] = text
        if kind in ("runtime.connecting", "runtime.failed"):
            now["error"] = text if kind == "runtime.failed" else None
        elif kind == "proof.node.updated" and text in NODES:
            now["nodes"][text] = e["status"]
        elif kind == "patch.observed":
            now["nodes"]["patch"] = "static"
        elif kind == "inspector.tab.changed":
            now["tab"] = text if text is not None else TAB
        elif kind in ("dock.toggled", "popout.toggled"):
            name = "dock_open" if kind == "dock.toggled" else "popout"
            now[name] = not now[name]
        elif kind in (RED, GREEN):
            self._ran(kind, e["n"], run)
        elif kind.startswith("approval."):
            self._decided(kind, text)

    def _ran(self, kind: str, n: int | None, run: tuple) -> None:
        now = self.now
        if run[1] == "baseline":
            now["nodes"]["tests"] = "green"
            if kind == RED:
                now["red_tests"] = 0
            else:
                now["green_tests"] = (n or 0) if run[2] == 0 else 0
        elif kind == RED:
            now["nodes"]["errors"] = "red"
            now |= {"red": True, "green": False, "red_tests": n or 0, "green_tests": 0, "approved": None, "submission": "idle", "approval_error": None}
            self.runs = [run, None]
        elif now["red"]:
            now["nodes"]["verify"] = "green"
            now |= {"green": True, "green_tests": n or 0}
            self.runs[1] = run

    def _decided(self, kind: str, text: str | None) -> None:
        now = self.now
        if kind == "approval.submitting":
            now |= {"submission": "submitting", "approval_error": None}
        elif kind == "approval.failed":
            now |= {"submission": "failed", "approval_error": text}
        elif kind == "approval.resolved":
            now |= {"submission": "accepted" if text == "approve" else "denied", "approved": text == "approve", "approval_error": None}
        elif now["approved"] is None and kind == "approval.denied":
            now |= {"submission": "denied", "approved": False}
        elif now["approved"] is None and kind == "approval.approved" and self._agrees() and (self.asked or not self.live) and now["submission"] != "submitting":
            now["approved"] = True

    def row(self, lines: int, clock: str | None) -> list:
        now = self.now | {"lines": lines, "clock": clock, "nodes": sorted(f"{n} {s}" if s is not None else n for n, s in self.now["nodes"].items())}
        return [now[f] for f in _FIELDS]


def folded(events: list[dict], live: bool = True) -> list:
    """STATE of one session's events: one after the other, in order."""
    events = sorted(events, key=lambda e: e["seq"])
    reset = max((e["seq"] for e in events if e["type"] == RESET), default=None)
    own = [e for e in events if reset is None or e["seq"] > reset]
    state = _State(live)
    for e in own:
        state.take(e)
    clock = [e["text"] for e in events if e["type"] in (CLOCK, RESET) and e["text"] is not None]
    return state.row(len({e["text"] for e in own if e["type"] == LINE and e["text"] is not None}), clock[-1] if clock else None)


class MissionFold(StatefulProcessor):
    """Keeps what a session's state depends on: the last place of each line behind the last reset, and the other events behind it.

    Events may come in any order and in any batches; those before a reset are dropped when it is seen. A session's state
    is as large as its lines' ids and its other events, ticks of the clock aside. The newest lines and events are kept in one value, read
    and written once a batch; what is more than HELD of them goes on to maps.
    """

    def __init__(self, live: bool = True, held: int = HELD):
        self.live, self.held = live, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.marks = handle.getValueState("marks", "reset bigint, tick bigint, clock string, lines bigint, chunks bigint, mapped boolean, events string, ids string")
        self.seen = handle.getMapState("lines", "id string", "seq bigint")
        self.kept = handle.getMapState("events", "chunk bigint", "body string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        reset, tick, clock, lines, chunks, mapped, events, ids = self.marks.get() or (None, None, None, 0, 0, False, "[]", "{}")
        was, tail, ids, new = reset, json.loads(events), json.loads(ids), {}
        for _, body in rows:
            seq, kind, text, status, n, run, phase, code = json.loads(body)
            seq, n, code = int(seq), None if n is None else int(n), None if code is None else int(code)
            if kind in (CLOCK, RESET) and text is not None and (tick is None or seq > tick):
                tick, clock = seq, text
            if kind == RESET:
                reset = seq if reset is None else max(seq, reset)
            elif kind == LINE and text is not None:
                new[text] = max(seq, new.get(text, seq))
            elif kind not in (None, CLOCK, LINE):
                tail.append([seq, kind, text, status, n, run, phase, code])
        mapped, lines = self._lines(ids, new, reset, reset != was, mapped, lines)
        events = [e for _, body in sorted((k[0], b[0]) for k, b in self.kept.iterator()) for e in json.loads(body)] if chunks else []
        if reset != was:
            tail, chunks = [e for e in [*events, *tail] if e[0] > reset], self._drop(chunks)
            events = []
        elif reset is not None:
            tail = [e for e in tail if e[0] > reset]
        state = _State(self.live)
        for _, e in sorted({e[0]: e for e in [*events, *tail]}.items()):
            state.take(dict(zip(_EVENT, e, strict=True)))
        while len(tail) > self.held:
            self.kept.updateValue((chunks,), (json.dumps(tail[: self.held]),))
            tail, chunks = tail[self.held :], chunks + 1
        self.marks.update((reset, tick, clock, lines, chunks, mapped, json.dumps(tail), json.dumps(ids)))
        yield _ROW(*key, *state.row(lines, clock))

    def _drop(self, chunks: int) -> int:
        for k in range(chunks):
            self.kept.removeKey((k,))
        return 0

    def _lines(self, ids: dict, new: dict, reset: int | None, changed: bool, mapped: bool, lines: int) -> tuple[bool, int]:
        """Whether the map has lines, and how many lines there are behind the last reset; ids and the map take over the new ones."""
        if changed:
            for k in [k for k, s in ids.items() if s <= reset]:
                del ids[k]
            old = list(self.seen.iterator()) if mapped else []
            for k, s in old:
                if s[0] <= reset:
                    self.seen.removeKey(k)
            lines = len(ids.keys() | {k[0] for k, s in old if s[0] > reset})
        for k, seq in new.items():
            if reset is None or seq > reset:
                told = ids[k] if k in ids else self.seen.getValue((k,))[0] if mapped and self.seen.containsKey((k,)) else None
                lines += told is None
                ids[k] = seq if told is None else max(told, seq)
        if len(ids) > self.held:
            for k, seq in ids.items():
                self.seen.updateValue((k,), (seq,))
            ids.clear()
            mapped = True
        return mapped, lines

    def close(self) -> None:
        pass


def state_stream(events: DataFrame, live: bool = True) -> DataFrame:
    """STATE of each session after each batch of a stream of events (see EVENT).

    An event goes to Python as one text, as each cell of a row is taken over on its own there.
    """
    packed = events.select("session_id", F.to_json(F.array(*[F.col(c).cast("string") for c in _EVENT])).alias("body"))
    return packed.groupBy("session_id").transformWithState(MissionFold(live), f"session_id string, {STATE}", "Update", "None")
