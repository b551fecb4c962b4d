"""The job protocol as state: one pure transition, replayed over a table or run over a stream.

Events: job, at (seconds), kind (queue, lease, beat, commit, fail, cancel), detail (a failure's class).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LEASE, BACKOFF, MOST = 600.0, 900.0, 3
STATE = "state string, attempt int, until double"
RESULT = "job long, state string, attempt int, until double, events long"
#: The state that a failure of a class leads to; any other is tried again.
FAILED = {"cancelled": "cancelled", "input": "ineligible", "source": "blocked"}


class Job(NamedTuple):
    state: str = "none"
    attempt: int = 0
    until: float = 0.0  # end of the lease, or of the wait before a retry


def step(job: Job, kind: str, at: float, detail: str) -> Job:
    """The job after one event; events that its state doesn't allow change nothing."""
    running = job.state in ("running", "cancel_requested")
    if kind == "queue" and job.state in ("none", "committed", "cancelled"):
        return Job("queued")
    if kind == "lease" and (job.state == "queued" or job.state == "retry_wait" and at >= job.until or job.state == "running" and at > job.until):
        return Job("dead_letter", job.attempt) if job.attempt >= MOST else Job("running", job.attempt + 1, at + LEASE)
    if kind == "beat" and running:
        return job._replace(until=at + LEASE)
    if kind == "commit" and running:
        return Job("cancelled" if job.state == "cancel_requested" else "committed", job.attempt)
    if kind == "fail" and running:
        state = FAILED.get(detail) or ("dead_letter" if job.attempt >= MOST else "retry_wait")
        return Job(state, job.attempt, at + BACKOFF * max(1, job.attempt) if state == "retry_wait" else 0.0)
    if kind == "cancel" and job.state in ("queued", "retry_wait", "running"):
        return job._replace(state="cancel_requested") if job.state == "running" else Job("cancelled", job.attempt)
    return job


def fold(job: Job, events: Iterable[tuple]) -> Job:
    for at, _, kind, detail in sorted(events, key=lambda e: e[:2]):
        job = step(job, kind, at, detail)
    return job


def rows(pdf: pd.DataFrame) -> list[tuple]:
    return list(zip(pdf["at"], pdf["seq"], pdf["kind"], pdf["detail"].fillna(""), strict=True))


def replay(events: DataFrame) -> DataFrame:
    """The state of each job after all its events. events: job, seq, at, kind, detail; a job has few."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        j = fold(Job(), rows(pdf))
        return pd.DataFrame([(int(pdf["job"].iloc[0]), *j, len(pdf))], columns=["job", "state", "attempt", "until", "events"])

    return events.groupBy("job").applyInPandas(run, RESULT)


def stream(events: DataFrame) -> DataFrame:
    """The same over a stream: each trigger gives the new state of the jobs that had events."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job, seen = (Job(*state.get[:3]), state.get[3]) if state.exists else (Job(), 0)
        batch = [r for p in parts for r in rows(p)]
        job, seen = fold(job, batch), seen + len(batch)
        state.update((*job, seen))
        yield pd.DataFrame([(int(key[0]), *job, seen)], columns=["job", "state", "attempt", "until", "events"])

    return events.groupBy("job").applyInPandasWithState(run, RESULT, STATE + ", events long", "update", GroupStateTimeout.NoTimeout)
