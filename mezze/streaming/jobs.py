"""The job queue as Structured Streaming: event time, watermarks, and a state for each place or host."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mezze.operators.jobs import ATTEMPTS, DISCOVER, FIRST_DELAY_S, STICKY
from mezze.streaming.state import InOrder, in_order


def dedup(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A place's queued events but for the first within the watermark; late repeats of older jobs count as new."""
    return events.filter("state = 'queued'").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["place_id"]).select("event_id", "place_id", "ts")


def rate_windows(events: DataFrame, seconds: int = 60, most: int = 15, delay: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", f"{seconds} seconds")).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "n", F.greatest(F.lit(0), F.col("n") - most).alias("over"))


def status(events: DataFrame) -> DataFrame:
    """place_id, status after each batch that has events of the place; a state of a few values for each place."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, walled = state.get if state.exists else ("", False)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for now in rows["state"]:
            walled = now == STICKY or walled and now == "failed"
            last = now
        state.update((last, walled))
        yield pd.DataFrame({"place_id": [key[0]], "status": [STICKY if walled and last == "failed" else last]})

    return events.groupBy("place_id").applyInPandasWithState(step, "place_id long, status string", "last string, walled boolean", "update", GroupStateTimeout.NoTimeout)


class Retries(InOrder):
    """Counts a place's failures since it was last queued or completed, and fires the retries that are not called off."""

    names = ("what", "event_id", "place_id", "attempt", "delay_s", "final", "due_us")
    first = (0, [])

    def step(self, value: list, event: tuple) -> list[tuple]:
        us, event_id, state, kind, place_id = event
        fired = self.until(value, us - 1)
        if state in ("queued", "completed"):
            value[:] = [0, []]
        elif state in ("failed", STICKY):
            most = 1 if kind == DISCOVER else ATTEMPTS
            value[0] += 1
            final = state == STICKY or value[0] >= most
            delay = None if final else FIRST_DELAY_S * 2 ** (value[0] - 1)
            if value[0] <= most:
                fired.append(("failed", event_id, place_id, value[0], delay, final, None))
            if delay is not None:
                value[1] = [*map(tuple, value[1]), (us + delay * 1_000_000, event_id, place_id, value[0])]
        return fired

    def until(self, value: list, us: int) -> list[tuple]:
        due = [tuple(d) for d in value[1]]
        value[1] = [d for d in due if d[0] > us]
        return [("retry", event_id, place_id, attempt, None, False, at) for at, event_id, place_id, attempt in due if at <= us]

    def wake(self, value: list) -> int | None:
        return min((d[0] for d in value[1]), default=None)

    def done(self, value: list, us: int) -> bool:
        return value[0] == 0 and not value[1]


def retries(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """what, event_id, place_id, attempt, delay_s, final, due_at: `jobs.retries` as `failed`, and `jobs.due` as `retry` when due."""
    out = in_order(events, "place_id", Retries(), "what string, event_id string, place_id string, attempt int, delay_s long, final boolean, due_us long", delay)
    return out.select("what", F.col("event_id").cast("long"), F.col("place_id").cast("long"), "attempt", "delay_s", "final", F.timestamp_micros("due_us").alias("due_at"))


class StaticOnly(InOrder):
    """Remembers a host's last failure, and the one before it for events at its very time, as long as it lives."""

    names = ("event_id", "static")
    first = (None, None)

    def __init__(self, seconds: int):
        self.lives = seconds * 1_000_000

    def step(self, value: list, event: tuple) -> list[tuple]:
        us, event_id, state, _, _ = event
        last = value[1] if value[0] == us else value[0]
        if state in ("failed", STICKY) and value[0] != us:
            value[:] = [us, value[0]]
        return [(event_id, last is not None and us - last <= self.lives)]

    def wake(self, value: list) -> int | None:
        return None if value[0] is None else value[0] + self.lives

    def done(self, value: list, us: int) -> bool:
        return value[0] is None or us > value[0] + self.lives


def static_only(events: DataFrame, seconds: int = 600, delay: str = "1 hour") -> DataFrame:
    """event_id, static as in `jobs.static_only`; a host's state is dropped by a timer when its failure is too old to count.

    The time to live is counted in event time. Spark's own counts the clock's, so that a replay would give other results.
    """
    return in_order(events, "host", StaticOnly(seconds), "event_id string, static boolean", delay).withColumn("event_id", F.col("event_id").cast("long"))
