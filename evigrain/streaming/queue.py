"""A queue of build jobs as a fold over its events, in batch and as a stream.

Events (queue, at, id, kind, job, worker, force, reason) are `submit`, `lease`, `done` and `failed`. A lease takes all waiting
jobs as one build: forced if any is, with their distinct reasons. There is one worker a queue: while a lease holds, others
are refused. A lease that isn't done in time expires, and its jobs wait again. Ends by a worker without the lease are stale.

What happens is told as rows (queue, at, state, jobs, force, reasons, worker): queued, running, refused, idle, ready, failed,
expired, stale. The stream holds events back until the watermark has passed them, so it works in the order of event
time, whatever order they come in, and tells exactly what the batch fold tells about the same events; what comes
later than the watermark allows is dropped. Its state is one machine a queue and the events of one delay.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Milliseconds that a lease holds.
LEASE = 600_000
EVENTS = ("at", "id", "kind", "job", "worker", "force", "reason")
TOLD = "queue string, at timestamp, state string, jobs string, force boolean, reasons string, worker string"


class Machine:
    """The state of one queue: jobs that wait, and the lease, if there is one."""

    def __init__(self, waiting: dict | None = None, lease: dict | None = None):
        self.waiting: dict[str, list] = waiting or {}
        self.lease = lease

    def _row(self, at: int, state: str, jobs: dict, worker: str | None) -> tuple:
        return (at, state, ",".join(sorted(jobs)), any(f for f, _ in jobs.values()), ",".join(sorted({r for _, r in jobs.values()})), worker)

    def tick(self, now: int) -> list[tuple]:
        """What happens because time passes."""
        if self.lease is None or self.lease["until"] > now:
            return []
        lease, self.lease = self.lease, None
        # What was submitted again meanwhile stays as it was submitted last.
        self.waiting = lease["jobs"] | self.waiting
        return [self._row(lease["until"], "expired", lease["jobs"], lease["worker"])]

    def step(self, at: int, kind: str, job: str | None, worker: str | None, force: bool, reason: str | None) -> list[tuple]:
        out = self.tick(at)
        if kind == "submit":
            self.waiting[job or ""] = [bool(force), reason or "unknown"]
            return [*out, self._row(at, "queued", self.waiting, None)]
        if kind == "lease":
            if self.lease is not None:
                return [*out, self._row(at, "refused", {}, worker)]
            if not self.waiting:
                return [*out, self._row(at, "idle", {}, worker)]
            self.lease, self.waiting = {"jobs": self.waiting, "worker": worker, "until": at + LEASE}, {}
            return [*out, self._row(at, "running", self.lease["jobs"], worker)]
        if self.lease is None or self.lease["worker"] != worker:
            return [*out, self._row(at, "stale", {}, worker)]
        lease, self.lease = self.lease, None
        return [*out, self._row(at, "ready" if kind == "done" else "failed", lease["jobs"], worker)]


def _events(pdf: pd.DataFrame) -> list[list]:
    ms = pdf["at"].astype("datetime64[ms]").astype("int64")
    return [[a, int(i), k, j, w, bool(f) if f is not None else False, r] for a, i, k, j, w, f, r in zip(ms.tolist(), pdf["id"], pdf["kind"], pdf["job"], pdf["worker"], pdf["force"], pdf["reason"])]


def _frame(queue: str, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame([(queue, *r) for r in rows], columns=[c.split()[0] for c in TOLD.split(", ")])
    out["at"] = pd.to_datetime(out["at"], unit="ms")
    return out


def folded(events: DataFrame) -> DataFrame:
    """What happened in each queue, from all of its events. Rows are dealt by queue and sorted, and a task holds one
    machine at a time; leases that are open at the end stay open."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queue, machine = None, Machine()
        for pdf in batches:
            out = []
            for name, *event in zip(pdf["queue"], *zip(*_events(pdf))) if len(pdf) else []:
                if name != queue:
                    queue, machine = name, Machine()
                out += [(queue, *r) for r in machine.step(event[0], *event[2:])]
            told = pd.DataFrame(out, columns=[c.split()[0] for c in TOLD.split(", ")])
            told["at"] = pd.to_datetime(told["at"], unit="ms")
            yield told

    return events.select("queue", *EVENTS).repartition("queue").sortWithinPartitions("queue", "at", "id").mapInPandas(run, TOLD)


def _stream_step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held, waiting, lease = json.loads(state.get[0]) if state.exists else ([], None, None)
    machine = Machine(waiting, lease)
    if not state.hasTimedOut:
        for pdf in batches:
            held += _events(pdf)
    now = state.getCurrentWatermarkMs()
    held.sort(key=lambda e: (e[0], e[1]))
    ripe = [e for e in held if e[0] <= now]
    held = held[len(ripe) :]
    out = [r for e in ripe for r in machine.step(e[0], *e[2:])]
    out += machine.tick(now)
    state.update((json.dumps([held, machine.waiting, machine.lease]),))
    # Called again when the watermark passes the next event or the end of the lease.
    due = [*(e[0] for e in held[:1]), *([machine.lease["until"]] if machine.lease else [])]
    if due:
        state.setTimeoutTimestamp(max(min(due), now + 1))
    yield _frame(key[0], out)


def streamed(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """folded() of a stream of events, which may come in any order within `late`."""
    rows = events.select("queue", *EVENTS).withWatermark("at", late)
    return rows.groupBy("queue").applyInPandasWithState(_stream_step, TOLD, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def at_most(told: DataFrame, ms: int) -> DataFrame:
    """What was told up to a time."""
    return told.filter(F.unix_millis("at") <= ms)
