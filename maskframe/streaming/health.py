"""Health state as keyed state of a stream.

Probes wait in a key's state until the watermark has passed them, so those that come
late, but within the delay, are still taken in time order.  A batch reads and writes
the state of its own keys and of keys whose timer is due, and no other.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from maskframe.operators.stats import step_micros
from maskframe.streaming.streams import event_time

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    """Keep the state of streams that start from now on in RocksDB, which keyed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _Health(StatefulProcessor):
    """Streaks of one key.  Rows are (columns besides key and time, microseconds); ``at`` says which column is what."""

    def __init__(self, key: str, id: str, ok: str, others: list[T.StructField], bad: int, good: int, idle: int | None) -> None:
        self.key, self.id, self.ok = key, id, ok
        self.names = [f.name for f in others]
        self.bad, self.good, self.idle = bad, good, idle
        self.row = T.StructType([*others, T.StructField("__us", T.LongType())])
        self.result = [key, *self.names, "__us", "healthy", "consecutive_failures", "consecutive_successes"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.streak = handle.getValueState("streak", "healthy boolean, fails long, oks long, seen long")
        self.timer = handle.getValueState("timer", "due long")
        self.waiting = handle.getListState("waiting", self.row)

    def _wake(self, micros: int) -> None:
        """See to it that the key is looked at once the watermark has reached a time."""
        due = -(-micros // 1000)
        if not self.timer.exists() or self.timer.get()[0] > due:
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        part: list[tuple] = []
        first = None
        for r in rows:
            first = r["__us"] if first is None else min(first, r["__us"])
            part.append((*[r[n] for n in self.names], r["__us"]))
            if len(part) == 1000:
                self.waiting.appendList(part)
                part = []
        if part:
            self.waiting.appendList(part)
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        if self.timer.exists() and self.timer.get()[0] * 1000 > passed:
            return  # an earlier timer has seen to this
        self.timer.clear()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        at = len(self.names)
        due = sorted((r for r in held if r[at] <= passed), key=lambda r: (r[at], r[self.names.index(self.id)]))
        left = [tuple(r) for r in held if r[at] > passed]
        if held:
            self.waiting.put(left) if left else self.waiting.clear()
        healthy, fails, oks, seen = self.streak.get() if self.streak.exists() else (True, 0, 0, 0)
        place = self.names.index(self.ok)
        for r in due:
            if r[place]:
                fails, oks = 0, oks + 1
            else:
                fails, oks = fails + 1, 0
            healthy = False if fails >= self.bad else True if oks >= self.good else healthy
            seen = r[at]
            yield Row(**dict(zip(self.result, (*key, *r, healthy, fails, oks), strict=True)))
        if due:
            self.streak.update((healthy, fails, oks, seen))
        if left:
            self._wake(min(r[at] for r in left))
        elif self.idle is not None and self.streak.exists():
            if passed >= seen + self.idle:
                self.streak.clear()
            else:
                self._wake(seen + self.idle)

    def close(self) -> None:
        pass


def health_stream(
    sdf: DataFrame,
    key: str,
    ok: str,
    id: str,
    ts: str = "ts",
    delay: str = "10 minutes",
    bad: int = 3,
    good: int = 1,
    idle: str | None = None,
) -> DataFrame:
    """State after every probe of a stream, as ``health_state`` has it for a table.

    A probe comes out when the watermark, ``delay`` behind the newest probe, has passed
    it; probes that come later than that are dropped.  Probes of one time are taken in
    the order of ``id``.  A key without a probe for as long as ``idle`` loses its state and
    starts healthy again; without ``idle`` state is kept for good.  The session must keep
    stream state in RocksDB (``use_keyed_state``).
    """
    timed = event_time(sdf, ts, delay)
    kind = sdf.schema[ts].dataType
    others = [f for f in sdf.schema.fields if f.name not in (key, ts)]
    before = timed.select(key, ts, *[f.name for f in others], F.unix_micros(ts).alias("__us"))
    result = T.StructType(
        [
            sdf.schema[key],
            *others,
            T.StructField("__us", T.LongType()),
            T.StructField("healthy", T.BooleanType()),
            T.StructField("consecutive_failures", T.LongType()),
            T.StructField("consecutive_successes", T.LongType()),
        ]
    )
    machine = _Health(key, id, ok, others, bad, good, None if idle is None else step_micros(idle))
    states = before.groupBy(key).transformWithState(machine, result, "Append", "EventTime")
    return states.withColumn(ts, F.timestamp_micros("__us").cast(kind)).select(
        *sdf.columns,
        "healthy",
        F.when(F.col("healthy"), F.lit("ok")).otherwise("degraded").alias("status"),
        "consecutive_failures",
        "consecutive_successes",
    )
