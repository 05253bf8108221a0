"""Stateful processors: host health and hold-steady gates.

State is one small row per key. A key's rows of one batch arrive together
and are handled in time order.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from stitchwork.rules.garments import STALL_ALERT_HOURS

# Executors receive the processors with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark):
    """The processors need the RocksDB state store; the session's own setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


HEALTH_SCHEMA = ("host string, ts timestamp, status string, count long, delta long, stalled_hours double, "
                 "event string")
_HEALTH_STATE = ("last_count long, stalled_since double, completed boolean, alerted boolean, destroyed boolean, "
                 "instance_id long, seen long, silent boolean")
_HEALTH_COLUMNS = ["host", "ts", "status", "count", "delta", "stalled_hours", "event"]
#: ``seen``: microseconds of the last check; ``silent``: whether its timer has fired.
_FRESH = {"last_count": 0, "stalled_since": None, "completed": False, "alerted": False, "destroyed": False,
          "instance_id": None, "seen": None, "silent": False}


class HealthProcessor(StatefulProcessor):
    """Progress resets the stall; a flat or unreachable check starts it; half an hour alerts.

    Reaching the target completes a host once. Completion and a stall alert
    end an instance: it is destroyed and ignored until another instance
    takes the host over, which starts afresh.

    With ``silent_hours``, a host without a check for so long is seen all the
    same: an event-time timer stands in for the check that didn't come, as an
    unreachable one whose stall began at the last check. A gap between two
    rows of one batch counts as if the timer had fired in between.
    """

    def __init__(self, stall_hours: float = STALL_ALERT_HOURS, destroy: bool = True, silent_hours: float | None = None):
        self.stall_hours = stall_hours
        self.destroy = destroy
        self.silence = None if silent_hours is None else round(silent_hours * 3_600_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("health", _HEALTH_STATE)

    def _silent(self, key, s: dict) -> tuple[dict, tuple | None]:
        """What the timer that follows the last check does."""
        if s["destroyed"] or s["completed"] or s["silent"] or s["seen"] is None:
            return s, None
        at = s["seen"] + self.silence
        since = s["seen"] / 1e6 if s["stalled_since"] is None else s["stalled_since"]
        s, status, delta, hours, event = self._stall({**s, "stalled_since": since, "silent": True}, at / 1e6 / 3600 - since / 3600, "SILENT")
        return s, (key[0], pd.Timestamp(at, unit="us"), status, s["last_count"], delta, round(hours, 2), event)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = dict(zip(_FRESH, self.state.get())) if self.state.exists() else dict(_FRESH)
        row = None
        if s["seen"] is not None and expiredTimerInfo.getExpiryTimeInMs() == (s["seen"] + self.silence) // 1000:
            s, row = self._silent(key, s)
            self.state.update(tuple(s[n] for n in _FRESH))
        yield pd.DataFrame([row] if row else [], columns=_HEALTH_COLUMNS)

    def _check(self, s: dict, row) -> tuple[dict, str, int, float, str | None]:
        now = row.ts.timestamp()
        if not row.reachable:
            since = now if s["stalled_since"] is None else s["stalled_since"]
            hours = (now - since) / 3600.0
            s = {**s, "stalled_since": since}
            return (*self._stall(s, hours, "UNREACHABLE"),)
        delta = int(row.count) - s["last_count"]
        event = None
        if row.target > 0 and row.count >= row.target and not s["completed"]:
            s = {**s, "completed": True, "last_count": int(row.count)}
            event = "completed"
            if self.destroy:
                return {**s, "destroyed": True, "stalled_since": None}, "DESTROYED", delta, 0.0, event
        if delta > 0:
            return {**s, "last_count": int(row.count), "stalled_since": None, "alerted": False}, "RUNNING", delta, 0.0, event
        since = now if s["stalled_since"] is None else s["stalled_since"]
        s = {**s, "stalled_since": since}
        if s["completed"]:
            return s, "STOPPED", delta, (now - since) / 3600.0, event
        return (*self._stall(s, (now - since) / 3600.0, "STOPPED", delta),)

    def _stall(self, s: dict, hours: float, status: str, delta: int = 0):
        if hours < self.stall_hours:
            return s, status, delta, hours, None
        event = None if s["alerted"] else "stalled"
        s = {**s, "alerted": True}
        if self.destroy:
            return {**s, "destroyed": True}, "DESTROYED", delta, hours, event
        return s, status, delta, hours, event

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = dict(zip(_FRESH, self.state.get())) if self.state.exists() else dict(_FRESH)
        out, before = [], s["seen"]
        for row in pd.concat(list(rows)).sort_values("ts", kind="stable").itertuples(index=False):
            now = row.ts.value // 1000
            if self.silence is not None and s["seen"] is not None and now - s["seen"] >= self.silence:
                s, late = self._silent(key, s)
                out += [late] if late else []
            instance = int(row.instance_id)
            if s["instance_id"] != instance:
                s = {**_FRESH, "instance_id": instance}
            s = {**s, "seen": now, "silent": False}
            if s["destroyed"]:
                continue
            s, status, delta, hours, event = self._check(s, row)
            out.append((key[0], row.ts, status, s["last_count"], delta, round(hours, 2), event))
        self.state.update(tuple(s[n] for n in _FRESH))
        if self.silence is not None:
            if before is not None and not s["silent"]:
                self.handle.deleteTimer((before + self.silence) // 1000)
            if not s["destroyed"]:
                self.handle.registerTimer((s["seen"] + self.silence) // 1000)
        yield pd.DataFrame(out, columns=_HEALTH_COLUMNS)

    def close(self) -> None:
        pass


def host_health(checks: DataFrame, stall_hours: float = STALL_ALERT_HOURS, destroy: bool = True,
                silent_hours: float | None = None, delay: str = "0 seconds") -> DataFrame:
    """Health events per check. Input: host, instance_id, ts, reachable, count, target.

    With ``silent_hours`` also for hosts without checks, as soon as the
    watermark (the latest check of any host, less ``delay``) shows it.
    """
    if silent_hours is None:
        return checks.groupBy("host").transformWithStateInPandas(
            HealthProcessor(stall_hours, destroy), HEALTH_SCHEMA, "Append", "None")
    return checks.withWatermark("ts", delay).groupBy("host").transformWithStateInPandas(
        HealthProcessor(stall_hours, destroy, silent_hours), HEALTH_SCHEMA, "Append", "EventTime")


class HoldProcessor(StatefulProcessor):
    """Fires once when the gate has stayed true long enough; turning ``auto`` off re-arms it."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("hold", "since double, fired boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        since, fired = self.state.get() if self.state.exists() else (None, False)
        out = []
        for row in pd.concat(list(rows)).sort_values("ts", kind="stable").itertuples(index=False):
            if row.ok and row.auto:
                now = row.ts.timestamp()
                since = now if since is None else since
                if round(now - since, 6) >= self.seconds and not fired:
                    fired = True
                    out.append((key[0], row.ts))
            else:
                since = None
                fired = fired and bool(row.auto)
        self.state.update((since, fired))
        yield pd.DataFrame(out, columns=["session", "fired_at"])

    def close(self) -> None:
        pass


def hold_steady(gate: DataFrame, seconds: float) -> DataFrame:
    """Fire times per session. Input: session, ts, ok, auto."""
    return gate.groupBy("session").transformWithStateInPandas(
        HoldProcessor(seconds), StructType.fromDDL("session string, fired_at timestamp"), "Append", "None")


class TimedHoldProcessor(StatefulProcessor):
    """Fires when the gate has been true for so long, whether or not another frame comes: by an event-time timer.

    The gate counts as true from a true frame to the next frame that is not.
    Turning ``auto`` off re-arms it.
    """

    def __init__(self, seconds: float):
        self.hold = round(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("hold", "since long, fired boolean, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        since, fired, timer = self.state.get() if self.state.exists() else (None, False, None)
        out = []
        for row in pd.concat(list(rows)).sort_values("ts", kind="stable").itertuples(index=False):
            now = row.ts.value // 1000
            if since is not None and not fired and now - since >= self.hold:
                fired = True
                out.append((key[0], pd.Timestamp(since + self.hold, unit="us")))
            if row.ok and row.auto:
                since = now if since is None else since
            else:
                since, fired = None, fired and bool(row.auto)
        due = None if since is None or fired else -(-(since + self.hold) // 1000)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.state.update((since, fired, due))
        yield pd.DataFrame(out, columns=["session", "fired_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        since, fired, timer = self.state.get() if self.state.exists() else (None, False, None)
        out = []
        if since is not None and not fired and timer == expiredTimerInfo.getExpiryTimeInMs():
            out.append((key[0], pd.Timestamp(since + self.hold, unit="us")))
            self.state.update((since, True, None))
        yield pd.DataFrame(out, columns=["session", "fired_at"])

    def close(self) -> None:
        pass


def _condensed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames without those that lie between two true ones of the same session and batch: they change no hold."""
    for frame in frames:
        frame = frame.sort_values(["session", "ts"], kind="stable")
        held = frame["ok"].fillna(False).astype(bool) & frame["auto"].fillna(False).astype(bool)
        by = frame["session"]
        inner = held & held.shift(1, fill_value=False) & held.shift(-1, fill_value=False) & (by == by.shift(1)) & (by == by.shift(-1))
        yield frame[~inner]


def hold_steady_timed(gate: DataFrame, seconds: float, delay: str = "0 seconds") -> DataFrame:
    """Fire times per session, at the moment the gate had been true for ``seconds``. Input: session, ts, ok, auto.

    Frames inside a stretch of true ones are dropped by each task before they
    meet; the watermark (the latest frame of any session, less ``delay``)
    fires the others' timers.
    """
    few = gate.select("session", "ts", "ok", "auto").mapInPandas(_condensed, "session string, ts timestamp, ok boolean, auto boolean")
    return few.withWatermark("ts", delay).groupBy("session").transformWithStateInPandas(
        TimedHoldProcessor(seconds), StructType.fromDDL("session string, fired_at timestamp"), "Append", "EventTime")
