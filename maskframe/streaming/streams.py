"""The operators on Structured Streaming.

Masking is stateless and the same projection as in batch.  Counters and
sessions use event-time windows with a watermark, so their state is dropped as
time goes on.  What must write twice or look back (masked rows with their log,
a policy that may change, health state) runs per micro-batch, and every output
is written under its batch number, so a batch that is repeated after a failure
replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from maskframe.operators.mask import change_log, mask
from maskframe.operators.ordered import health_report, health_state
from maskframe.policy import MaskPolicy
from maskframe.sources.policy_io import load_policy, reload, reload_audit

mask_stream = mask


def event_time(df: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Watermark on a TIMESTAMP column (a TIMESTAMP_NTZ one is cast first)."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, delay)


def stream_counters(
    sdf: DataFrame,
    key: str | Column,
    window: str = "5 seconds",
    delay: str = "10 minutes",
    ts: str = "ts",
) -> DataFrame:
    """Rows per window and key: statements by kind or masked fields by strategy.

    A window comes out when the watermark has passed it, and rows that come
    after that are dropped; ``run_counters`` keeps all rows.
    """
    k = F.col(key) if isinstance(key, str) else key
    return (
        event_time(sdf, ts, delay)
        .groupBy(F.window(ts, window).alias("w"), k.alias("key"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "key", "n")
    )


def run_counters(
    sdf: DataFrame,
    key: str | Column,
    out: str,
    checkpoint: str,
    window: str = "5 seconds",
    ts: str = "ts",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Counters that lose no row: each micro-batch writes its own sums per window and key.

    No watermark and no state, so neither late rows nor the last window are
    held back; ``read_counters`` adds the batches up.
    """
    k = F.col(key) if isinstance(key, str) else key

    def write(batch: DataFrame, batch_id: int) -> None:
        counted = batch.groupBy(F.window(ts, window).alias("w"), k.alias("key")).agg(
            F.count(F.lit(1)).alias("n"), F.max(ts).alias("newest")
        )
        _write_batch(counted.select("w.start", "w.end", "key", "n", "newest"), out, batch_id, "parquet")

    return (
        sdf.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_counters(spark: SparkSession, out: str, delay: str = "10 minutes") -> DataFrame:
    """Rows per window and key over all batches, and how many of them came late.

    Late are the rows of windows that ended more than ``delay`` before the newest
    row of the batches before theirs.
    """
    parts = spark.read.parquet(out)
    newest = parts.groupBy("batch").agg(F.max("newest").alias("newest"))
    earlier = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    # One row per batch.
    seen = newest.select("batch", F.max("newest").over(earlier).alias("seen"))
    late = F.col("end") < F.col("seen") - F.expr(f"INTERVAL {delay}")
    return (
        parts.join(seen, "batch")
        .groupBy("start", "end", "key")
        .agg(F.sum("n").alias("n"), F.sum(F.when(late, F.col("n")).otherwise(0)).alias("n_late"))
    )


def stream_sessions(
    sdf: DataFrame, key: str, gap: str = "300 seconds", delay: str = "10 minutes", ts: str = "ts"
) -> DataFrame:
    """Idle sessions on a stream.

    Set ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition``
    so that a hot key is reduced to sessions before the shuffle.
    """
    return (
        event_time(sdf, ts, delay)
        .groupBy(F.session_window(ts, gap).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")
    )


def _write_batch(df: DataFrame, path: str, batch_id: int, fmt: str) -> None:
    df.write.format(fmt).mode("overwrite").save(f"{path}/batch={batch_id:012d}")


def _marker(spark: SparkSession, out: str, batch_id: int):
    """The file whose presence says that a batch is whole, and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out.rstrip('/')}/_committed/batch={batch_id:012d}")
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def committed(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the batches of ``run_masked`` all of whose outputs are there."""
    path, fs = _marker(spark, out, 0)
    folder = path.getParent()
    if not fs.exists(folder):
        return []
    return sorted(int(s.getPath().getName().removeprefix("batch=")) for s in fs.listStatus(folder))


def read_committed(spark: SparkSession, out: str, other: str | None = None, fmt: str = "parquet") -> DataFrame | None:
    """The rows of whole batches; with ``other``, those of that output (the change log).  None if there are none.

    A batch counts once the marker beside its rows is there, which is made after the
    rows and the log: both are seen, or neither.
    """
    root = (other or out).rstrip("/")
    paths = [f"{root}/batch={b:012d}" for b in committed(spark, out)]
    return spark.read.option("basePath", root).format(fmt).load(paths).drop("batch") if paths else None


def run_masked(
    sdf: DataFrame,
    policy_path: str,
    out: str,
    checkpoint: str,
    log_out: str | None = None,
    table: str | None = None,
    fmt: str = "parquet",
    keys: tuple[str, ...] = (),
    trigger: dict | None = None,
    on_batch: Callable[[int, MaskPolicy], None] | None = None,
    audit_out: str | None = None,
    **kw,
) -> StreamingQuery:
    """Write a stream's masked rows and, if asked, its change log.

    The policy file is read again for every micro-batch: a change takes effect
    at a batch edge, and an unusable file leaves the policy in force.  The
    first read must succeed.  With ``audit_out`` every change and every refusal leaves an
    audit row there, under the number of its batch.

    Rows and log are one commit: a marker is made when both are written, and
    ``read_committed`` sees whole batches only.  A batch that fails in between is
    written again; one that is whole is not.
    """
    spark = sdf.sparkSession
    current = {"policy": load_policy(policy_path, spark)}

    def write(batch: DataFrame, batch_id: int) -> None:
        before, told = current["policy"], []
        policy = current["policy"] = reload(before, policy_path, spark, lambda now, e: told.append((now, e)))
        if audit_out is not None and (row := reload_audit(spark, before, *told[0])) is not None:
            _write_batch(row, audit_out, batch_id, "json")
        if on_batch is not None:
            on_batch(batch_id, policy)
        marker, fs = _marker(spark, out, batch_id)
        if fs.exists(marker):
            return  # whole, but Spark was stopped before it knew
        if log_out is not None:
            batch.persist()
        try:
            _write_batch(mask(batch, policy, table, **kw), out, batch_id, fmt)
            if log_out is not None:
                log = change_log(batch, policy, table, keys, **kw)
                _write_batch(log, log_out, batch_id, fmt)
        finally:
            batch.unpersist()
        fs.create(marker, True).close()

    return (
        sdf.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def run_health(
    sdf: DataFrame,
    key: str,
    ok: str,
    id: str,
    out: str,
    state_out: str,
    checkpoint: str,
    ts: str = "ts",
    bad: int = 3,
    good: int = 1,
    block: str = "1 hour",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Health state on a stream of probes that arrive in time order.

    Every micro-batch goes through ``health_state`` and starts from the state
    that the batch before it wrote: one row per key, under its batch number.
    """
    spark = sdf.sparkSession
    state_schema = T.StructType(
        [
            sdf.schema[key],
            T.StructField("healthy", T.BooleanType()),
            T.StructField("consecutive_failures", T.LongType()),
            T.StructField("consecutive_successes", T.LongType()),
        ]
    )

    def state_path(batch_id: int) -> str:
        return f"{state_out}/batch={batch_id:012d}"

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id == 0:
            before = spark.createDataFrame([], state_schema)
        else:
            before = spark.read.schema(state_schema).parquet(state_path(batch_id - 1))
        batch.persist()
        try:
            states = health_state(batch, key, ok, id, ts, bad, good, block, before)
            _write_batch(states, out, batch_id, "parquet")
            # Read back what was written: the batch is computed once.
            written = spark.read.schema(states.schema).parquet(f"{out}/batch={batch_id:012d}")
            now = health_report(written, key, id, ts).select(*state_schema.names)
            quiet = before.join(now.select(key), key, "left_anti")
            now.unionByName(quiet).write.mode("overwrite").parquet(state_path(batch_id))
        finally:
            batch.unpersist()

    return (
        sdf.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
