"""Stateful steps over keyed events in the order of their time, whatever the order they come in.

Rows wait in a list state until the watermark has passed them; then nothing earlier can come, and they are handled in
order. What a step does at a later time, such as a retry that falls due, hangs on an event-time timer. Results are those
of a batch over the same events, also when a query is stopped and started again: all state is in the checkpoint.

Each access to the state is a call to the JVM, so keys share it: a bucket of keys has one list of waiting rows, one value
with what is known of each key, and one timer. A batch then costs a few calls for each bucket, not for each key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIELDS = ["us", "event_id", "state", "kind", "place_id", "key"]
#: Buckets of keys; a query's checkpoint holds for one number only.
BUCKETS = 1024


class InOrder(StatefulProcessor):
    """Hands each key's events to `step` in the order of (us, event_id), and `until` the watermark after them.

    A subclass has `names`, the columns that it returns, and `first`, a key's value at the start. `step(value, event)` and
    `until(value, us)` change the list `value`, which JSON can hold, and return rows; `wake(value)` is the microsecond
    at which `until` has something to do, or None; a value that `done(value, us)` finds of no more use is dropped.
    """

    names: tuple[str, ...]
    first: tuple

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Both as JSON: rows of FIELDS, and pairs of a key and its value.
        self.pending = handle.getListState("pending", "rows string")
        self.values = handle.getValueState("values", "pairs string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        come = [r for batch in rows for r in zip(*(batch[c].tolist() for c in FIELDS))]
        yield from self._advance(timerValues, come)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(timerValues, [])

    def _advance(self, timers, come: list[tuple]) -> Iterator[pd.DataFrame]:
        passed = timers.getCurrentWatermarkInMs() * 1000
        waiting = [r for (rows,) in self.pending.get() for r in json.loads(rows)] if self.pending.exists() else []
        ready = sorted((r for part in (waiting, come) for r in part if r[0] <= passed), key=lambda r: (r[0], int(r[1] or -1)))
        left = [r for part in (waiting, come) for r in part if r[0] > passed]
        values = dict(json.loads(self.values.get()[0])) if self.values.exists() else {}
        out = []
        for *event, key in ready:
            if key not in values:
                values[key] = json.loads(json.dumps(self.first))
            out += self.step(values[key], tuple(event))
        for value in values.values():
            out += self.until(value, passed)
        values = {key: value for key, value in values.items() if not self.done(value, passed)}
        if len(left) < len(waiting) + len(come):
            if left:
                self.pending.put([(json.dumps(left),)])
            else:
                self.pending.clear()
        elif come:
            self.pending.appendValue((json.dumps(come),))
        if values:
            self.values.update((json.dumps(list(values.items())),))
        else:
            self.values.clear()
        wakes = [r[0] for r in left] + [us for us in map(self.wake, values.values()) if us is not None]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if wakes:
            self.handle.registerTimer(min(wakes) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=list(self.names))

    def step(self, value: list, event: tuple) -> list[tuple]:
        raise NotImplementedError

    def until(self, value: list, us: int) -> list[tuple]:
        return []

    def wake(self, value: list) -> int | None:
        return None

    def done(self, value: list, us: int) -> bool:
        return False


def in_order(events: DataFrame, key: str, processor: InOrder, returns: str, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """`processor` over the events by `key`; events without a time or later than `delay` behind the newest are left out.

    Needs the RocksDB state store. `events` has event_id, place_id, state, kind and ts. Keys and ids come and go as strings: next
    to nulls, pandas turns longs into floats, and a float is no key of theirs.
    """
    ids = [F.col(c).cast("string").alias(c) for c in ("event_id", "place_id")]
    keyed = events.filter("ts IS NOT NULL").withWatermark("ts", delay).select(F.col(key).cast("string").alias("key"), "ts", *ids, "state", "kind", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return keyed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").transformWithStateInPandas(processor, returns, "append", "eventTime")
