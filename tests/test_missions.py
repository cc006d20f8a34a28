"""States of sessions: by aggregation, one event after the other, and as a stream, in any order."""

import json
import random

from logloom.streaming import missions


def _events(draw, session, size):
    runs = ["m\u0001s\u0001k", "other", None]
    rows = []
    for seq in range(size):
        kind = draw.choice([*missions.TYPES, *[missions.RED, missions.GREEN, "approval.approved", "approval.denied", "approval.required"] * 3])
        if kind == missions.RESET and draw.random() < 0.8:
            kind = missions.LINE
        phase = draw.choice(["reproduce", "baseline", None] if kind == missions.RED else ["verify", "verify", "baseline", None]) if kind in (missions.RED, missions.GREEN) else None
        run = draw.choice(runs[:1] * 4 + runs) if phase else None
        code = (draw.choice([1, 2, 0]) if kind == missions.RED else draw.choice([0, 0, 1])) if phase else None
        text = draw.choice(["approve", "deny"]) if kind == "approval.resolved" else draw.choice(["a", "b", "tests", "errors", None])
        rows.append({"session_id": session, "seq": seq, "type": kind, "text": text, "status": draw.choice(["amber", "static", None]) if kind == "proof.node.updated" else None, "n": draw.randrange(9) if kind in (missions.RED, missions.GREEN) else None, "run": run, "phase": phase, "exit_code": code})
    return rows


def _frame(spark, rows):
    names = [f.split()[0] for f in missions.EVENT.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], missions.EVENT)


def _plain(row):
    return [sorted(v) if isinstance(v, list) else v for v in row]


def test_aggregation_gives_the_state_of_a_walk(spark):
    draw = random.Random(2)
    many = [_events(draw, f"s{i}", draw.randrange(1, 60)) for i in range(250)]
    shuffled = [e for rows in many for e in rows]
    draw.shuffle(shuffled)
    for live in (True, False):
        want = {rows[0]["session_id"]: missions.folded(rows, live) for rows in many}
        got = {r.session_id: _plain(list(r)[1:]) for r in missions.states(_frame(spark, shuffled), live).collect()}
        for k, v in want.items():
            assert got[k] == v, (k, [(n, a, b) for n, a, b in zip(missions._FIELDS, got[k], v, strict=True) if a != b])
        assert any(v[missions._FIELDS.index("approved")] for v in want.values())
    assert missions.states(_frame(spark, [])).count() == 0


def test_events_are_dealt_and_ordered_once(spark):
    rows = [("s", 1, missions.LINE, "a"), ("s", 2, missions.LINE, "a"), ("s", 3, missions.LINE, None), ("s", 4, None, "x"), ("t", 1, missions.LINE, "a"), ("t", 3, missions.RESET, "9:00"), ("t", 4, missions.LINE, "b"), ("t", 2, missions.LINE, "b"), ("u", 1, missions.LINE, "a"), ("u", 2, missions.RESET, None), (None, 1, missions.LINE, "a")]
    df = missions.states(_frame(spark, [{n: None for n in ("status", "n", "run", "phase", "exit_code")} | dict(zip(("session_id", "seq", "type", "text"), r, strict=True)) for r in rows]))
    assert {(r.session_id, r.lines, r.clock) for r in df.collect()} == {("s", 1, None), ("t", 1, "9:00"), ("u", 0, None), (None, 1, None)}
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and plan.count("Window [") == 3
    done = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert done.count("Sort [session_id") == 1 and done.count("Exchange hashpartitioning") == 2


def test_streams_give_the_same_state(spark, tmp_path):
    draw = random.Random(8)
    rows = [e for i in range(12) for e in _events(draw, f"s{i}", 40)]
    want = {f"s{i}": missions.folded([e for e in rows if e["session_id"] == f"s{i}"]) for i in range(12)}
    draw.shuffle(rows)
    for k in range(3):  # three batches, in any order
        _frame(spark, rows[k::3]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(missions.EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = str(tmp_path / "out")
    job = missions.state_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).foreachBatch(lambda df, n: df.selectExpr("*", f"{n} AS batch").write.mode("append").parquet(out)).start()
    job.awaitTermination()
    last = {}
    for r in sorted(spark.read.parquet(out).collect(), key=lambda r: r.batch):
        last[r.session_id] = _plain(list(r)[1:-1])
    assert last == want


class _Handle:
    """State of one session, with the number of times it was asked."""

    def __init__(self):
        self.held, self.asked = {}, 0

    def getValueState(self, name, *schema):
        return _Kept(self, self.held.setdefault(name, {}))

    getMapState = getValueState


class _Kept:
    def __init__(self, handle, held):
        self.handle, self.held = handle, held

    def _said(self, value):
        self.handle.asked += 1
        return value

    def get(self):
        return self._said(self.held.get(()))

    def update(self, value):
        self._said(self.held.update({(): value}))

    def getValue(self, key):
        return self._said(self.held.get(key))

    def containsKey(self, key):
        return self._said(key in self.held)

    def updateValue(self, key, value):
        self._said(self.held.update({key: value}))

    def removeKey(self, key):
        self._said(self.held.pop(key, None))

    def iterator(self):
        return self._said(iter(list(self.held.items())))


def test_a_batch_reads_and_writes_a_small_session_once():
    draw = random.Random(5)
    for trial in range(120):
        rows = _events(draw, "s", draw.randrange(1, 120))
        draw.shuffle(rows)
        parts = draw.randrange(1, 5)
        for held in (missions.HELD, 3):
            handle, got = _Handle(), None
            fold = missions.MissionFold(held=held)
            fold.init(handle)
            for k in range(parts):
                bodies = [("s", json.dumps([None if e[c] is None else str(e[c]) for c in ("seq", "type", "text", "status", "n", "run", "phase", "exit_code")])) for e in rows[k::parts]]
                got = list(fold.handleInputRows(("s",), iter(bodies), None)) if bodies else got
            assert _plain(list(got[0])[1:]) == missions.folded(rows), (trial, held)
            assert held == 3 or handle.asked <= 2 * parts


def test_frames_become_events(spark):
    evidence = {"missionId": "m", "sandboxId": "s", "selectionKey": "k", "phase": "reproduce", "exitCode": 2}
    frames = [
        {"type": missions.RED, "failed": 2, "evidence": evidence}, {"type": missions.LINE, "line": {"id": "tf-1", "text": "x"}}, {"type": "unknown"}, {"type": "runtime.failed", "message": "gone"},
        {"type": "proof.node.updated", "nodeId": "tests", "status": "amber"}, {"type": missions.GREEN, "passed": 5}, {"type": "approval.resolved", "decision": "approve"}, {"type": missions.CLOCK, "currentTime": "10:00"},
    ]
    rows = [("s", i, json.dumps(f)) for i, f in enumerate(frames)] + [("s", 99, "{broken"), ("s", 100, None)]
    got = {r.seq: tuple(r)[2:] for r in missions.parsed(spark.createDataFrame(rows, "session_id string, seq bigint, data string")).collect()}
    assert got == {
        0: (missions.RED, None, None, 2, "m\u0001s\u0001k", "reproduce", 2), 1: (missions.LINE, "tf-1", None, None, None, None, None), 3: ("runtime.failed", "gone", None, None, None, None, None),
        4: ("proof.node.updated", "tests", "amber", None, None, None, None), 5: (missions.GREEN, None, None, 5, None, None, None), 6: ("approval.resolved", "approve", None, None, None, None, None), 7: (missions.CLOCK, "10:00", None, None, None, None, None),
    }
