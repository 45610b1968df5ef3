"""Request budget and circuit breaker of hosts in one state that is dropped when a host falls silent, and a watch over jobs.

Both are stateful processors with timers and need the RocksDB state store: ``use_rocksdb`` sets it for a session.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The window of the budget in seconds, what is added to a wait, and the defaults of budget and breaker.
WINDOW_S, EXTRA_S, PER_MINUTE, FAILURES, OPEN_S = 60.0, 0.05, 10, 5, 300.0
#: Minutes after which a job is lost that is pending though started, has no task, or claims to run.
PENDING_MIN, LEGACY_MIN, HARD_MIN = 5.0, 15.0, 40.0
REPLAYED = "host string, at timestamp, allowed boolean, wait double, failures int"
LOST = "job_id string, reason string"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class HostGate(StatefulProcessor):
    def __init__(self, per_minute: int, failures: int, open_s: float, idle_s: float):
        self.per_minute, self.failures, self.open_s, self.idle_s = per_minute, failures, open_s, idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getListState("sent", "at double")
        self.circuit = handle.getValueState("circuit", "failures int, until double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("at", kind="stable")
        sent = [x[0] for x in self.sent.get()]
        row, until = self.circuit.get() if self.circuit.exists() else (0, 0.0)
        out, now = [], 0.0
        for at, ok in zip(events["at"], events["ok"], strict=True):
            now = at.timestamp()
            if until > now:
                out.append((key[0], at, False, 0.0, row))
                continue
            sent = [s for s in sent if s >= now - WINDOW_S]
            wait = max(0.0, WINDOW_S - (now - sent[0]) + EXTRA_S) if len(sent) >= self.per_minute else 0.0
            sent = [s for s in sent if s >= now + wait - WINDOW_S] + [now + wait]
            row = 0 if ok else row + 1
            until = 0.0 if ok else now + wait + self.open_s if row >= self.failures else until
            out.append((key[0], at, True, round(wait, 3), row))
        self.sent.put([(s,) for s in sent])
        self.circuit.update((row, until))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((max(now, until) + self.idle_s) * 1000))
        yield pd.DataFrame(out, columns=["host", "at", "allowed", "wait", "failures"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.sent.clear()
        self.circuit.clear()
        yield pd.DataFrame({"host": [key[0]], "at": [pd.NaT], "allowed": [None], "wait": [None], "failures": [None]})

    def close(self) -> None:
        pass


def host_gate(requests: DataFrame, per_minute: int = PER_MINUTE, failures: int = FAILURES, open_s: float = OPEN_S, idle_s: float = 3600.0, delay: str = "1 minute") -> DataFrame:
    """(host, at, allowed, wait, failures) for each of the requests (host, at, ok): whether the circuit lets it through, how many seconds the
    budget holds it back, and how many failures in a row there are after it.

    After ``failures`` in a row the circuit is open for ``open_s`` seconds; then one request is let through, and a failure opens it again.
    The budget is of requests in the 60 seconds before. A host from which nothing came for ``idle_s`` after its last request, or
    after its circuit closed, is forgotten, and a row with the host alone says so.
    """
    gate = HostGate(per_minute, failures, open_s, idle_s)
    return requests.withWatermark("at", delay).groupBy("host").transformWithStateInPandas(gate, REPLAYED, "append", "eventTime")


class JobWatch(StatefulProcessor):
    def __init__(self, pending_min: float, legacy_min: float, hard_min: float):
        self.pending, self.legacy, self.hard = pending_min, legacy_min, hard_min

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, state string, started timestamp, created timestamp, task_id string")

    def _verdict(self, now_ms: float) -> str | None:
        """Why the job is lost by now; if it is not, a timer is set for when it will be."""
        status, state, started, created, task_id = self.job.get()
        if status not in ("queued", "running"):
            return None
        if state in ("FAILURE", "REVOKED"):
            return "task failed"
        since = (started or created).replace(tzinfo=dt.UTC).timestamp() * 1000 if (started or created) else None
        limits = [(self.hard, "silent")] + ([(self.pending, "pending")] if state == "PENDING" and started else []) + ([(self.legacy, "no task")] if task_id is None else [])
        if since is None:
            return None
        minutes, reason = min(limits)
        due = math.ceil(since + minutes * 60_000)
        if now_ms >= due:
            return reason
        self.handle.registerTimer(due)
        return None

    def _told(self, key, now_ms: float) -> Iterator[pd.DataFrame]:
        reason = self._verdict(now_ms)
        if reason:
            self.job.clear()
            yield pd.DataFrame({"job_id": [key[0]], "reason": [reason]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = pd.concat(list(rows)).sort_values("at", kind="stable").iloc[-1]
        plain = lambda x: None if pd.isna(x) else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x
        self.job.update(tuple(plain(last[c]) for c in ("status", "state", "started", "created", "task_id")))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        yield from self._told(key, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.job.exists():
            yield from self._told(key, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def lost_jobs(events: DataFrame, pending_min: float = PENDING_MIN, legacy_min: float = LEGACY_MIN, hard_min: float = HARD_MIN) -> DataFrame:
    """(job_id, reason) of jobs that are lost by the rules of ``gates.job_interrupted``, when they are: at an event, or by a timer when time passes
    without one. Events are (job_id, at, status, state, started, created, task_id); the last of a job counts, times are UTC."""
    watch = JobWatch(pending_min, legacy_min, hard_min)
    return events.groupBy("job_id").transformWithStateInPandas(watch, LOST, "append", "processingTime")
