"""Supervisor of task queues: claims one task after the other, routes how it ended, reclaims what a dead worker left.

Events of a queue are (queue, seq, at, event, task, status, page, total, percent, error). Requests (add, pause, resume,
cancel, retry, pause_all, ...) and progress go to the ledger. ``outcome`` tells how the running task ended
(status success, failure, paused, cancelled, error), ``restart`` that the worker came up again. A worker that says
nothing for ``lease_ms`` is taken for dead. What has to be done is given out as actions (queue, at, n, action, task, detail):
create_output and run for a claimed task, delete_output of an incomplete file, clean_cache of a task that will not go on.

The same steps serve the batch form and the stream, whose state is kept by transformWithState: it begins with the
ledger that is there, as if after a restart, and its timers end silent workers when the watermark passes their lease.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagelake.operators import ledger
from pagelake.operators.ledger import CANCELLED, DONE, FAILED, PAUSED, RUNNING, Queue, Task

LEASE_MS = 10 * 60 * 1000
EVENTS = [*ledger.EVENTS, "error"]
ACTIONS = "queue string, at long, n long, action string, task string, detail string"
NAMES = [c.split()[0] for c in ACTIONS.split(", ")]
#: How a task ends in the ledger, and whether its cache goes, for each outcome.
ENDS = {"success": (DONE, False), "failure": (FAILED, False), "error": (FAILED, False), "paused": (PAUSED, False), "cancelled": (CANCELLED, True)}


@dataclass
class Supervisor:
    lease_ms: int = LEASE_MS
    ledger: Queue = field(default_factory=Queue)
    runs: dict[str, int] = field(default_factory=dict)
    running: str | None = None
    deadline: int | None = None
    said: int = 0

    def _task(self, name: str | None) -> Task | None:
        return next((t for t in self.ledger.tasks if t.task == name), None)

    def _drop_output(self, t: Task) -> Iterator[tuple]:
        if t.output:
            yield "delete_output", t.task, t.output
            self.ledger.step("output", task=t.task, status="")

    def handle(self, e) -> Iterator[tuple]:
        """Actions (at, action, task, detail) that an event calls for."""
        at = int(e.at)
        yield from self.passed(at)
        match e.event:
            case "outcome":
                found = list(self._ended(e.task, e.status, e.error))
            case "restart":
                found = list(self._restarted(at))
            case _:
                number = lambda x: None if x is None or x != x else int(x)
                self.ledger.step(e.event, at, e.task, e.status, number(e.page), error=e.error or "", total=number(e.total), percent=number(e.percent))
                found = []
                if e.event == "progress" and e.task == self.running is not None:
                    self.deadline = at + self.lease_ms
        for a in (*found, *self._claimed(at)):
            yield at, *a

    def passed(self, now: int) -> Iterator[tuple]:
        """Every lease that is over before ``now``: its worker is dead, and the next one begins."""
        while self.deadline is not None and self.deadline < now:
            at = self.deadline
            for a in (*self._restarted(at), *self._claimed(at)):
                yield at, *a

    def _ended(self, task: str | None, outcome: str | None, error: str | None) -> Iterator[tuple]:
        if self.running is None or task != self.running or outcome not in ENDS:
            return
        t = self._task(task)
        self.running = self.deadline = None
        if t is None:
            return
        status, clean = ENDS[outcome]
        if outcome != "success":
            yield from self._drop_output(t)
        self.ledger.step("finish", task=task, status=status, error=(error or "processing failed") if status == FAILED else "")
        if clean:
            yield "clean_cache", task, ""

    def _restarted(self, at: int) -> Iterator[tuple]:
        """What a dead worker left: finished and cancelled tasks need no cache, cancelled and failed ones no output."""
        self.running = self.deadline = None
        self.ledger.step("crash", at)
        for t in self.ledger.tasks:
            if t.status in (CANCELLED, FAILED):
                yield from self._drop_output(t)
            if t.status in (DONE, CANCELLED):
                yield "clean_cache", t.task, ""

    def _claimed(self, at: int) -> Iterator[tuple]:
        if self.running is not None:
            return
        self.ledger.step("claim", at)
        t = next((t for t in self.ledger.tasks if t.status == RUNNING), None)
        if t is None:
            return
        yield from self._drop_output(t)
        run = self.runs[t.task] = self.runs.get(t.task, 0) + 1
        self.ledger.step("output", task=t.task, status=f"{t.task}-{run}.pdf")
        self.running, self.deadline = t.task, at + self.lease_ms
        yield "create_output", t.task, f"{t.task}-{run}.pdf"
        yield "run", t.task, str(t.quality)

    def needed(self) -> bool:
        """Is there anything to do or to wait for?"""
        return self.ledger.busy or (not self.ledger.paused_all and any(t.status == ledger.WAITING for t in self.ledger.tasks))

    def numbered(self, queue: str, actions: Iterable[tuple]) -> pd.DataFrame:
        rows = []
        for at, action, task, detail in actions:
            self.said += 1
            rows.append((queue, at, self.said, action, task, detail))
        return pd.DataFrame(rows, columns=NAMES)

    def dump(self) -> str:
        return json.dumps({"tasks": [asdict(t) for t in self.ledger.tasks], "paused_all": self.ledger.paused_all, "runs": self.runs, "running": self.running, "deadline": self.deadline, "said": self.said})

    @classmethod
    def load(cls, text: str, lease_ms: int) -> Supervisor:
        d = json.loads(text)
        queue = Queue([Task(**t) for t in d["tasks"]], d["paused_all"])
        return cls(lease_ms, queue, d.get("runs", {}), d.get("running"), d.get("deadline"), d.get("said", 0))


def event_columns(events: DataFrame) -> DataFrame:
    rows = ledger.with_event_columns(events)
    error = F.col("error").cast("string") if "error" in events.columns else F.lit(None).cast("string")
    return events.withColumn("__error", error).select(F.col("queue").cast("string").alias("queue"), *(events[c] if c in events.columns else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ledger.EVENTS), F.col("__error").alias("error"))


def actions(events: DataFrame, until: int | None = None, lease_ms: int = LEASE_MS) -> DataFrame:
    """Batch form: all actions of each queue; leases that end before ``until`` count as over. Queues are folded in parallel."""

    def fold(log: pd.DataFrame) -> pd.DataFrame:
        s = Supervisor(lease_ms)

        def every() -> Iterator[tuple]:
            for e in log.astype(object).where(log.notna(), None).sort_values(["at", "seq"], kind="stable").itertuples():
                yield from s.handle(e)
            if until is not None:
                yield from s.passed(until)

        return s.numbered(log["queue"].iloc[0], every())

    return event_columns(events).groupBy("queue").applyInPandas(fold, ACTIONS)


class _Processor(StatefulProcessor):
    def __init__(self, lease_ms: int):
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("supervisor", "json string")

    def _load(self) -> Supervisor:
        return Supervisor.load(self.kept.get()[0], self.lease_ms) if self.kept.exists() else Supervisor(self.lease_ms)

    def _save(self, s: Supervisor) -> None:
        self.kept.update((s.dump(),))
        for timer in list(self.handle.listTimers()):
            if timer != s.deadline:
                self.handle.deleteTimer(timer)
        if s.deadline is not None:
            self.handle.registerTimer(s.deadline)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = self._load()
        log = pd.concat(list(rows))
        log = log.astype(object).where(log.notna(), None).sort_values(["at", "seq"], kind="stable")
        out = s.numbered(str(key[0]), (a for e in log.itertuples() for a in s.handle(e)))
        self._save(s)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._load()
        out = s.numbered(str(key[0]), s.passed(timerValues.getCurrentWatermarkInMs()))
        self._save(s)
        yield out

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """The ledger that is there: tasks in order; a task that was under way has lost its worker."""
        tasks = [Task(**{k: v for k, v in row.items() if k in Task.__dataclass_fields__}) for row in initialState.sort_values("ord").to_dict("records")]
        paused = bool(initialState["paused_all"].any())
        self._save(Supervisor(self.lease_ms, Queue(tasks, paused)))

    def close(self) -> None:
        pass


def actions_stream(events: DataFrame, ledgers: DataFrame | None = None, lease_ms: int = LEASE_MS, late: str = "0 seconds") -> DataFrame:
    """Stream form. events have a timestamp column ts that equals ``at``; ledgers are rows of ledger.STATE to begin with.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass). Where a queue begins with tasks of an earlier worker, its first event should be restart.
    """
    rows = events.withWatermark("ts", late)
    initial = None if ledgers is None else ledgers.groupBy("queue")
    return rows.groupBy("queue").transformWithStateInPandas(_Processor(lease_ms), ACTIONS, "Append", "EventTime", initial)
