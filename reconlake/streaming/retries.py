"""Attempts of tasks as a stream with state: failures wait for their next attempt, timers start it, the last failure is final.

The state of a task is which attempt it is at and when the next is due; it lies
in the query's checkpoint, so a restarted stream goes on with the attempts and
timers that it had. Timers run on event time: a task that is due is started
when its next event is later than that, or when the watermark passes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reconlake.operators.operations import DELAYS, RETRYABLE

STEPS = "task_id bigint, at timestamp, action string, attempt int"
STATE = "status string, attempt int, due bigint"
IDLE, RUNNING, WAITING = "idle", "running", "waiting"
Status = tuple[str, int, int]  # status, attempt, when the next is due in microseconds


def stepped(state: Status, kind: str, code: int | None, at: int, delays: Sequence[int]) -> tuple[Status, str | None]:
    """The state after an event, and what is done."""
    status, attempt, _ = state
    if kind == "submitted" and status == IDLE:
        return (RUNNING, 1, 0), "RUN"
    if status == RUNNING and kind == "done":
        return (IDLE, 0, 0), "DONE"
    if status == RUNNING and kind == "failed":
        again = code is None or code >= 500 or code in RETRYABLE
        if again and attempt <= len(delays):
            return (WAITING, attempt, at + delays[attempt - 1] * 1_000_000), "WAIT"
        return (IDLE, 0, 0), "DEAD"
    return state, None


def _stepper(delays: Sequence[int]):
    def steps(key: tuple[Any, ...], batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now: Status = state.get if state.exists else (IDLE, 0, 0)
        out: list[tuple[int, str, int]] = []

        def started(by: int) -> None:
            nonlocal now
            if now[0] == WAITING and now[2] <= by:
                out.append((now[2], "RUN", now[1] + 1))
                now = (RUNNING, now[1] + 1, 0)

        if state.hasTimedOut:
            started(now[2])
        else:
            events = pd.concat(list(batches)).sort_values(["at", "event_id"], kind="stable")
            for kind, code, at in zip(events["kind"], events["code"], events["at"]):
                micros = at.value // 1000
                started(micros)
                before = now
                now, action = stepped(now, kind, None if pd.isna(code) else int(code), micros, delays)
                if action:
                    out.append((micros, action, now[1] if action == "RUN" else before[1]))
        watermark = state.getCurrentWatermarkMs() * 1000
        if now[0] == WAITING and now[2] <= watermark:
            started(watermark)
        if now[0] == IDLE:
            if state.exists:
                state.remove()
        else:
            state.update(now)
            if now[0] == WAITING:
                state.setTimeoutTimestamp(now[2] // 1000)
        if out:
            at, action, attempt = zip(*out)
            yield pd.DataFrame({"task_id": key[0], "at": pd.to_datetime(list(at), unit="us", utc=True), "action": action, "attempt": attempt})

    return steps


def attempts(events: DataFrame, late: str = "10 minutes", delays: Sequence[int] = DELAYS) -> DataFrame:
    """task_id, at, action, attempt: what is done when, for a stream of events (task_id, event_id, at, kind, code).

    kinds: 'submitted' runs a task that isn't under way; 'failed' with a code
    (HTTP; null: network) makes it wait `delays` by attempt, or ends it dead
    where trying again is no use or was tried often enough; 'done' ends it.
    Actions are RUN, WAIT, DEAD and DONE. All else changes nothing: unknown
    kinds, outcomes of tasks that don't run. Events of a task come in their
    order, within a batch in any; those without task or time are left out.
    Timestamps are read to the microsecond, timers run to the millisecond.
    """
    known = events.where("task_id is not null and at is not null").select("task_id", "event_id", "at", "kind", F.col("code").cast("double").alias("code"))
    keyed = known.withWatermark("at", late).groupBy("task_id")
    return keyed.applyInPandasWithState(_stepper(tuple(delays)), STEPS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
