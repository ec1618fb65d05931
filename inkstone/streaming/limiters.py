"""Stateful operators: token bucket with additive increase and multiplicative decrease, sliding log, streaks.

The state machines are plain functions of (state, event). In a batch they run over events that Spark has
sorted within a key's partition, one state in memory at a time; in a stream they run as state processors.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from inkstone.session import ship_code


@dataclass
class Limits:
    """Parameters of the bucket; the defaults are the reference's exploration values."""

    initial_rpm: float = 20
    min_rpm: float = 2
    max_rpm: float = 60
    burst_seconds: float = 10
    decrease: float = 0.5
    successes: int = 5
    step: float = 1

    def __post_init__(self) -> None:
        if self.min_rpm < 1 or self.max_rpm < self.min_rpm or not 0 < self.decrease < 1:
            raise ValueError("limits need 1 <= min_rpm <= max_rpm and 0 < decrease < 1")

    def measured(self, rpm: float | None) -> Limits:
        """A measured rate is both the start and the cap, but never under the minimum."""
        if rpm is None:
            return self
        rate = max(self.min_rpm, rpm)
        return Limits(rate, self.min_rpm, rate, self.burst_seconds, self.decrease, self.successes, self.step)


@dataclass
class Bucket:
    """State of one tenant's model, moved on by one event at a time.

    The rate is kept within the limits at every event. A refusal multiplies it and empties the bucket until the
    provider's hint, or without a positive hint one interval, has passed; ``successes`` in a row raise it by a step.
    """

    limits: Limits = field(default_factory=Limits)
    rpm: float | None = None
    tokens: float | None = None
    at_ms: int | None = None
    blocked_until: int = 0
    streak: int = 0

    def after(self, op: str, now: int, hint_ms: int | None = None) -> tuple[bool, int]:
        """Move on by one event: (whether a token was granted, milliseconds to wait)."""
        rule = self.limits
        rate = min(rule.max_rpm, max(rule.min_rpm, rule.initial_rpm if self.rpm is None else self.rpm))
        interval = lambda r: math.ceil(60_000 / r)
        if op == "throttle":
            self.rpm = max(rule.min_rpm, math.floor(rate * rule.decrease))
            self.blocked_until = self.at_ms = now + (hint_ms if hint_ms is not None and hint_ms > 0 else interval(self.rpm))
            self.tokens, self.streak = 0.0, 0
            return False, 0
        if op == "success":
            full = self.streak + 1 >= rule.successes
            self.rpm, self.streak = (min(rule.max_rpm, rate + rule.step), 0) if full else (rate, self.streak + 1)
            return False, 0
        self.rpm = rate
        room = max(1.0, rate * rule.burst_seconds / 60)
        since = now if self.at_ms is None else self.at_ms
        gained = max(0, now - since) * rate / 60_000
        self.tokens = room if self.tokens is None else min(room, self.tokens + gained) if gained else self.tokens
        self.at_ms = max(since, now)
        if now < self.blocked_until:
            return False, self.blocked_until - now
        if self.tokens < 1:
            return False, math.ceil((1 - self.tokens) * 60_000 / rate - 1e-9)  # what rounding adds is no millisecond
        self.tokens -= 1
        return True, 0


class SlidingLog:
    """At most ``rpm`` admitted calls in the last minute and ``per_day`` a UTC day; refused calls use nothing."""

    def __init__(self, rpm: int, per_day: int) -> None:
        self.rpm, self.per_day = rpm, per_day
        self.day, self.today, self.recent = -1, 0, deque()

    def admit(self, now: int) -> str:
        """``ok``, ``day`` or ``minute``."""
        if now // 86_400_000 != self.day:
            self.day, self.today = now // 86_400_000, 0
        while self.recent and self.recent[0] <= now - 60_000:
            self.recent.popleft()
        if self.today >= self.per_day:
            return "day"
        if len(self.recent) >= self.rpm:
            return "minute"
        self.recent.append(now)
        self.today += 1
        return "ok"


def fold(events: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable[..., tuple], columns: list[str], schema: str) -> DataFrame:
    """Run a state machine over each key's events in order; ``step(state, *columns)`` gives a row of the schema.

    Events are sorted within partitions by Spark, which spills; Python holds one state and one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for k, *values in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or k != now:
                    now, state = k, start()
                out.append(step(state, *values))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    ship_code(events.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = events.select(key, *dict.fromkeys([*columns, *order])).repartition(n, key).sortWithinPartitions(key, *order)
    return dealt.select(key, *columns).mapInArrow(run, schema)


def bucket_step(b: Bucket, event_id: int, op: str, ts_ms: int, hint_ms: int | None) -> tuple:
    """One event: event_id, granted, wait_ms, rpm, streak, cap."""
    granted, wait = b.after(op, ts_ms, hint_ms)
    return event_id, granted, wait, float(b.rpm), b.streak, float(b.limits.max_rpm)


WEEK_MS = 7 * 86_400_000
BUCKET = "event_id bigint, granted boolean, wait_ms bigint, rpm double, streak int, cap double"


def token_bucket(events: DataFrame, key: str = "bucket", limits: Limits | None = None, measured: str | None = None) -> DataFrame:
    """Batch twin of the limiter; ``measured`` names a column with the registry's rate for the bucket, or null."""
    rule = limits or Limits()

    def step(b: Bucket, event_id: int, op: str, ts_ms: int, hint_ms: int | None, *rate: float | None) -> tuple:
        if rate and b.rpm is None:  # the bucket's first event
            b.limits = rule.measured(*rate)
        return bucket_step(b, event_id, op, ts_ms, hint_ms)

    columns = ["event_id", "op", "ts_ms", "hint_ms", *([measured] if measured else [])]
    return fold(events, key, ["ts_ms", "event_id"], lambda: Bucket(rule), step, columns, BUCKET)


def sliding_log(events: DataFrame, key: str, rpm: int, per_day: int) -> DataFrame:
    """Batch twin of the sliding log."""
    step = lambda s, event_id, ts_ms: (event_id, s.admit(ts_ms))
    return fold(events, key, ["ts_ms", "event_id"], lambda: SlidingLog(rpm, per_day), step, ["event_id", "ts_ms"], "event_id bigint, verdict string")


def token_bucket_stream(events: DataFrame, key: str = "bucket", limits: Limits | None = None) -> DataFrame:
    """The limiter over a stream: events of a micro-batch are taken in event time.

    State that was idle for a week in event time counts as none; a processing-time timeout would keep
    an ``availableNow`` run from ending.
    """
    rule = limits or Limits()

    def process(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        b = Bucket(rule)
        if state.exists:
            b.rpm, b.tokens, b.at_ms, b.blocked_until, b.streak = state.get
        for batch in batches:
            ordered = batch.sort_values(["ts_ms", "event_id"])
            if len(ordered) and b.at_ms is not None and ordered["ts_ms"].iloc[0] - b.at_ms > WEEK_MS:
                b = Bucket(rule)
            hints = [None if pd.isna(h) else int(h) for h in ordered["hint_ms"]]
            rows = [bucket_step(b, *e) for e in zip(ordered["event_id"].tolist(), ordered["op"], ordered["ts_ms"].tolist(), hints)]
            yield pd.DataFrame(rows, columns=["event_id", "granted", "wait_ms", "rpm", "streak", "cap"])
        state.update((b.rpm, b.tokens, b.at_ms, b.blocked_until, b.streak))

    ship_code(events.sparkSession)
    schema = "rpm double, tokens double, at_ms bigint, blocked_until bigint, streak int"
    return events.groupBy(key).applyInPandasWithState(process, BUCKET, schema, "append", GroupStateTimeout.NoTimeout)


def wait_plan(wait_ms: int, most_ms: int = 120_000, slice_ms: int = 1000) -> list[int] | None:
    """Slices of a wait, or None where it is too long and the job goes back to the queue."""
    if wait_ms > most_ms:
        return None
    return [slice_ms] * (wait_ms // slice_ms) + ([wait_ms % slice_ms] if wait_ms % slice_ms else [])
