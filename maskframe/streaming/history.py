"""Running totals on a stream: a point for every step of a clock, also when nothing happens.

The clock is a stream of its own, a row without a change for every step, and goes
together with the changes; the totals are keyed state behind the sums of closed steps.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from maskframe.operators.stats import step_micros

MEASURES = ("active", "queries", "masked")


def clock(spark: SparkSession) -> DataFrame:
    """A row ``ts`` every second of the wall clock."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(F.col("timestamp").alias("ts"))


def replayed_clock(spark: SparkSession, start_ms: int, advance: str, every: str) -> DataFrame:
    """Rows ``ts`` a step apart from a time on, an ``advance`` more of them with every batch; for replays of a log."""
    ahead, step = step_micros(advance), step_micros(every)
    ticks = (
        spark.readStream.format("rate-micro-batch")
        .option("rowsPerBatch", 1)
        .option("startTimestamp", start_ms)
        .option("advanceMillisPerBatch", ahead // 1000)
        .load()
    )
    begin = F.unix_micros("timestamp")
    steps = ticks.select(F.explode(F.sequence(begin, begin + ahead - step, F.lit(step))).alias("us"))
    return steps.select(F.timestamp_micros("us").alias("ts"))


class _Totals(StatefulProcessor):
    """Adds up the sums of closed steps, which come in the order of time from batch to batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", ", ".join(f"{m} long" for m in MEASURES))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        now = self.total.get() if self.total.exists() else (0,) * len(MEASURES)
        for r in sorted(rows, key=lambda r: r["us"]):
            now = tuple(a + r[m] for a, m in zip(now, MEASURES, strict=True))
            yield Row(us=r["us"], **dict(zip(MEASURES, now, strict=True)))
        self.total.update(now)

    def close(self) -> None:
        pass


def history_stream(changes: DataFrame, ticks: DataFrame, every: str = "5 seconds", delay: str = "0 seconds") -> DataFrame:
    """Points of active sessions and total queries and masked fields, as ``history`` has them for a table.

    ``changes`` is a stream of ``tally`` rows, ``ticks`` a clock.  A step's point comes out when
    the watermark, ``delay`` behind the newest row of either stream, has passed it; changes
    that come later than that are dropped.  One row per step reaches the totals.  The
    session must keep stream state in RocksDB (``use_keyed_state``).
    """
    idle = ticks.select("ts", *[F.lit(0).cast("long").alias(m) for m in MEASURES])
    made = changes.select(F.col("ts").cast("timestamp").alias("ts"), *[F.col(m).cast("long").alias(m) for m in MEASURES])
    both = made.unionByName(idle).withWatermark("ts", delay)
    steps = both.groupBy(F.window("ts", every).alias("w")).agg(*[F.sum(m).alias(m) for m in MEASURES])
    closed = steps.select(F.lit(0).alias("all"), F.unix_micros("w.end").alias("us"), *MEASURES)
    result = T.StructType([T.StructField(n, T.LongType()) for n in ("us", *MEASURES)])
    points = closed.groupBy("all").transformWithState(_Totals(), result, "Append", "None")
    return points.select(
        F.timestamp_micros("us").alias("ts"),
        F.col("active").alias("active_connections"),
        F.col("queries").alias("total_queries"),
        F.col("masked").alias("total_masked"),
    )
