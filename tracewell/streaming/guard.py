"""Live guard: watches a stream of run events and says, once a session, that it should stop, or that it was abandoned, and why."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewell.functions.repetition import MIN_LINE, cycles

OUT = "session_id string, reason string, ts_ms long, tokens long"
_STATE = "start_ms long, last_ms long, tokens long, texts array<string>, gap boolean, done boolean"
_NAMES = ["start_ms", "last_ms", "tokens", "texts", "gap", "done"]


@dataclass(frozen=True)
class GuardLimits:
    """Budgets (None: no such limit), the longest silence, and the loop test: the share of repeated lines in the last `loop_window` texts."""

    max_tokens: int | None = 1_000_000
    max_ms: int | None = 1_800_000
    max_gap_ms: int = 300_000
    loop_window: int = 12
    loop_share: float = 0.6
    #: Silence after which a session without an end counts as abandoned, and its state goes. How late events may come.
    idle_ms: int = 3_600_000
    late_ms: int = 60_000


def looping(texts: list[str], limits: GuardLimits) -> bool:
    """Three texts at least, and lines that repeat right after themselves in the last ones make up the share."""
    if limits.loop_window <= 0 or len(texts) < 3:
        return False
    lines = [x for x in (line.strip() for t in texts[-limits.loop_window :] for line in t.split("\n")) if len(x) >= MIN_LINE]
    found = cycles(lines)
    return found["loops"] > 0 and found["ratio"] >= limits.loop_share


def observe(x: dict, ts: int, kind: str, content: str | None, tokens: float | None, limits: GuardLimits) -> str | None:
    """Take an event into the state x of its session; the reason to stop, if there is one. Budgets of tokens come first, then of time, then loops, then silence. A session that ended while it was over its silence is abandoned."""
    silent = x["last_ms"] is not None and ts - x["last_ms"] > limits.max_gap_ms
    x["start_ms"] = ts if x["start_ms"] is None else x["start_ms"]
    x["last_ms"], x["gap"] = ts, x["gap"] or silent
    x["tokens"] = max(x["tokens"], int(tokens)) if pd.notna(tokens) else x["tokens"]
    if kind in ("output", "tool_call") and content and content.strip():
        x["texts"] = [*x["texts"], content][-max(limits.loop_window, 1) :]
    if limits.max_tokens is not None and x["tokens"] >= limits.max_tokens:
        return "tokens"
    if limits.max_ms is not None and x["last_ms"] - x["start_ms"] > limits.max_ms:
        return "timeout"
    if looping(x["texts"], limits):
        return "loop"
    return "stall" if silent else None


def fresh() -> dict:
    return {"start_ms": None, "last_ms": None, "tokens": 0, "texts": [], "gap": False, "done": False}


def advance(x: dict, ts: int, kind: str, content: str | None, tokens: float | None, limits: GuardLimits) -> tuple | None:
    """Take an event into the state x; (reason, ts_ms, tokens) if it stops the session. After a stop or an end only the time goes on."""
    if x["done"]:
        x["last_ms"] = max(x["last_ms"], ts)
        return None
    reason = observe(x, ts, kind, content, tokens, limits)
    x["done"] = reason is not None or kind == "end"
    x["texts"] = [] if x["done"] else x["texts"]
    return None if reason is None else (reason, ts, x["tokens"])


def guard(events: DataFrame, limits: GuardLimits = GuardLimits()) -> DataFrame:
    """Stream of (session_id, ts_ms, type, content, tokens), tokens cumulative, to one row for each session that should stop (tokens, timeout, loop, stall) or that went silent without an end (abandoned).

    The state of a session is a few numbers and its last texts. Within a micro-batch events are put in order of time. After a stop or an end nothing more is said; the state goes once event time has passed the last event by idle_ms, so it does not
    pile up. Events that come later than late_ms may be dropped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        x = dict(zip(_NAMES, state.get if state.exists else (None, None, 0, [], False, False)))
        x["texts"] = list(x["texts"])
        out = []
        if state.hasTimedOut:
            if not x["done"]:
                out.append((key[0], "abandoned", x["last_ms"], x["tokens"]))
            state.remove()
        else:
            batch = pd.concat(list(frames)).sort_values("ts_ms", kind="stable")
            for ts, kind, content, tokens in zip(batch["ts_ms"], batch["type"], batch["content"], batch["tokens"]):
                row = advance(x, int(ts), kind, content, tokens, limits)
                if row:
                    out.append((key[0], *row))
            state.update(tuple(x[n] for n in _NAMES))
            state.setTimeoutTimestamp(max(x["last_ms"] + limits.idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session_id", "reason", "ts_ms", "tokens"])

    timed = events.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", f"{limits.late_ms} milliseconds")
    return timed.groupBy("session_id").applyInPandasWithState(step, OUT, _STATE, "append", "EventTimeTimeout")


class GuardProcessor(StatefulProcessor):
    """The guard's rules as state with timers: numbers of a session in a value, its last texts in a list that is only rewritten when one comes, how often each tool was called in a map, and an event-time timer that says when silence ends a session."""

    def __init__(self, limits: GuardLimits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", "start_ms long, last_ms long, tokens long, gap boolean, done boolean")
        self.texts = handle.getListState("texts", "text string")
        self.calls = handle.getMapState("calls", "type string", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        old = self.facts.get() if self.facts.exists() else (None, None, 0, False, False)
        x = dict(zip(("start_ms", "last_ms", "tokens", "gap", "done"), old)) | {"texts": [r[0] for r in self.texts.get()] if self.texts.exists() else []}
        kept, out, seen = list(x["texts"]), [], {}
        batch = pd.concat(list(rows)).sort_values("ts_ms", kind="stable")
        for ts, kind, content, tokens in zip(batch["ts_ms"], batch["type"], batch["content"], batch["tokens"]):
            seen[kind] = seen.get(kind, 0) + 1
            row = advance(x, int(ts), kind, content, tokens, self.limits)
            if row:
                out.append((key[0], *row))
        for kind, n in seen.items():
            before = self.calls.getValue((kind,))[0] if self.calls.containsKey((kind,)) else 0
            self.calls.updateValue((kind,), (before + n,))
        if x["texts"] != kept:
            self.texts.put([(t,) for t in x["texts"]]) if x["texts"] else self.texts.clear()
        self.facts.update(tuple(x[n] for n in ("start_ms", "last_ms", "tokens", "gap", "done")))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(x["last_ms"] + self.limits.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=["session_id", "reason", "ts_ms", "tokens"])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        _, last, tokens, _, done = self.facts.get()
        for state in (self.facts, self.texts, self.calls):
            state.clear()
        yield pd.DataFrame([] if done else [(key[0], "abandoned", last, tokens)], columns=["session_id", "reason", "ts_ms", "tokens"])

    def close(self) -> None:
        pass


def guard_with_timers(events: DataFrame, limits: GuardLimits = GuardLimits()) -> DataFrame:
    """As `guard`, by a processor with timers; needs the RocksDB state store, which it sets for the session."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = events.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", f"{limits.late_ms} milliseconds")
    return timed.groupBy("session_id").transformWithStateInPandas(GuardProcessor(limits), OUT, "Append", "EventTime")


def replay(events: DataFrame, limits: GuardLimits = GuardLimits(), order: tuple[str, ...] = ("ts_ms",)) -> DataFrame:
    """What the guard says of events that are all there: the same rows, and `abandoned` for sessions without an end at their last event. Sessions are dealt out and read in order, one session's state in memory at a time, however long it is."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, x = None, fresh()
        for frame in frames:
            out = []
            for session, ts, kind, content, tokens in zip(frame["session_id"], frame["ts_ms"], frame["type"], frame["content"], frame["tokens"]):
                if session != now:
                    out += left(now, x)
                    now, x = session, fresh()
                row = advance(x, int(ts), kind, content, tokens, limits)
                if row:
                    out.append((session, *row))
            yield pd.DataFrame(out, columns=["session_id", "reason", "ts_ms", "tokens"])
        yield pd.DataFrame(left(now, x), columns=["session_id", "reason", "ts_ms", "tokens"])

    dealt = events.repartition("session_id").sortWithinPartitions("session_id", *order)
    return dealt.select("session_id", "ts_ms", "type", "content", "tokens").mapInPandas(run, OUT)


def left(session: str | None, x: dict) -> list[tuple]:
    """The row of a session whose events are over."""
    return [] if x["done"] or x["last_ms"] is None else [(session, "abandoned", x["last_ms"], x["tokens"])]
