"""Registered queries over stored logs, state and time."""

from __future__ import annotations

import time
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.operators import audit as A
from maskframe.operators import discover as D
from maskframe.operators import stats as K
from maskframe.operators.asof import mask_as_of as rows_masked_as_of
from maskframe.operators.bucket import token_bucket
from maskframe.operators.paths import scan_paths
from maskframe.plans import fixtures as X
from maskframe.plans.queries import _changes, _policy_text, audit_rows, customers, probes, query, scan_tables
from maskframe.policy import MaskPolicy, Rule
from maskframe.sources import tables as S
from maskframe.sources.retention import read_log, retain_days
from maskframe.sources.sinks import staged, work_dir, write_audit
from maskframe.streaming import streams as ST
from maskframe.streaming.health import health_stream, use_keyed_state
from maskframe.streaming.history import history_stream, replayed_clock

#: Files that a slice of a replayed log has; a micro-batch takes one slice.
FILES = 4


def replayed(df: DataFrame, slice_no, slices: int, last: DataFrame | None = None) -> DataFrame:
    """A stream of a table in slices, one a micro-batch; ``last`` is a slice behind all others."""
    spark = df.sparkSession
    path = work_dir(spark, "replay")
    held = staged(df.withColumn("__slice", slice_no), "slices")
    for k in range(slices):
        held.where(F.col("__slice") == k).drop("__slice").repartition(FILES).write.parquet(f"{path}/{k}")
    if last is not None:
        last.select(*df.columns).write.parquet(f"{path}/{slices}")
    reader = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES)
    return reader.option("recursiveFileLookup", "true").parquet(path)


def _slice(ts: str, first, seconds: int):
    return F.floor(F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'{first}', `{ts}`)") / seconds).cast("int")


def _span(df: DataFrame):
    return df.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()


@query
def stream_health_state(spark, d):
    """ST4: keyed state over seven micro-batches, every seventh probe one batch late."""
    use_keyed_state(spark)
    rows = probes(spark, d).drop("latency_ms")
    edge = _span(rows)
    seconds = int((edge.b - edge.a).total_seconds()) // 6 + 1
    late = F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    # One probe of a key of its own, long after all others, lets the watermark pass them.
    closing = spark.createDataFrame([(-1, -1, True)], "event_id long, user_id long, ok boolean")
    closing = closing.withColumn("ts", F.expr(f"TIMESTAMP_NTZ'{edge.b}' + INTERVAL 90 DAYS"))
    sdf = replayed(rows, _slice("ts", edge.a, seconds) + late, 7, closing)
    states = health_stream(sdf, "user_id", "ok", "event_id", delay=f"{2 * seconds} seconds")
    out = work_dir(spark, "keyed-health")
    states.writeStream.option("checkpointLocation", work_dir(spark, "keyed-health-cp")).trigger(availableNow=True).format(
        "parquet"
    ).start(out).awaitTermination()
    return spark.read.schema(states.schema).parquet(out).where("user_id >= 0")


@query
def stream_history(spark, d):
    """K6: a point every 10 minutes beside a clock, idle steps too."""
    use_keyed_state(spark)
    changes = _changes(spark, d)
    edge = _span(changes)
    first = edge.a.replace(hour=0, minute=0, second=0, microsecond=0)
    days = (edge.b - first).days // 6 + 1
    sdf = replayed(changes, _slice("ts", first, days * 86_400), 6)
    start = int(spark.range(1).select(F.unix_millis(F.lit(str(first)).cast("timestamp"))).first()[0])
    ticks = replayed_clock(spark, start, f"{days} days", "10 minutes")
    points = history_stream(sdf, ticks, "10 minutes")
    out = work_dir(spark, "history")
    q = points.writeStream.option("checkpointLocation", work_dir(spark, "history-cp")).format("parquet").start(out)
    try:
        while q.isActive and (q.lastProgress is None or q.lastProgress["batchId"] < 8):
            time.sleep(0.1)
        if q.exception() is not None:
            raise q.exception()
    finally:
        q.stop()
    found = spark.read.schema(points.schema).parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return found.where(F.col("ts").between(_step_end(edge.a), _step_end(edge.b)))


def _step_end(t, minutes: int = 10):
    """The end of the step that holds a time."""
    floor = t.replace(minute=t.minute // minutes * minutes, second=0, microsecond=0)
    return F.lit(floor + timedelta(minutes=minutes)).cast("timestamp_ntz")


@query
def rate_token_bucket(spark, d):
    """ST5: three tokens, filled by the first event an hour or more after the last fill."""
    events = X.table(spark, d, "events").select("event_id", "ts", "event_type")
    return token_bucket(events, "event_type", 3, "event_id", per="1 hour")


_AUDIT = "id string, timestamp timestamp_ntz, event_type string, outcome string, auth_method string, user_id string"


@query
def audit_retain_days(spark, d):
    """A log stored by day, cut to its newest 777 rows where it lies."""
    path = work_dir(spark, "audit-days")
    write_audit(audit_rows(spark, d), path, by_day=True)
    retain_days(spark, path, 777, _AUDIT)
    return read_log(spark, path, _AUDIT).drop("day")


@query
def audit_cube(spark, d):
    """A10: subtotals by type, by outcome and in all."""
    return A.cube(audit_rows(spark, d))


@query
def history_span(spark, d):
    """K6: a grid whose ends are given; what was before counts at its first point."""
    points = K.history(_changes(spark, d), "1 hour", None, "2024-01-05 00:00:00", "2024-01-10 12:30:00")
    return K.for_chart(points)


@query
def latency_sketch_merge(spark, d):
    """K9: quantiles from stored hourly sketches, ranked against all values."""
    events = X.table(spark, d, "events")
    stored = staged(K.latency_sketches(events, "event_type", "value", every="1 hour"), "latency-sketches")
    merged = K.merge_latency(stored, "event_type")
    long = merged.select("event_type", "n", F.expr("stack(3, 0.5D, p50, 0.95D, p95, 0.99D, p99) AS (quantile, guess)"))
    ranks = events.join(long, "event_type").groupBy("event_type", "quantile", "n").agg(
        F.count_if(F.col("value") < F.col("guess")).alias("below"),
        F.count_if(F.col("value") <= F.col("guess")).alias("up_to"),
    )
    off = F.greatest(F.col("below") / F.col("n") - F.col("quantile"), F.col("quantile") - F.col("up_to") / F.col("n"))
    return ranks.select("event_type", "quantile", "n", (off < 0.015).alias("within"))


@query
def scan_bottom_k(spark, d):
    """100 rows of every table, the same for every partitioning."""
    return D.profile(scan_tables(spark, d), D.ScanConfig(bottom_k=100)).select("table", "column", "row_count")


@query
def row_counts_footer(spark, d):
    """P10: rows per table from the footers of its files."""
    return S.footer_counts(spark, {n: f"{d}/{n}.parquet" for n in X.DRIVER_TABLES})


@query
def scan_json_paths(spark, d):
    """Personal data by path inside JSON columns."""
    orders = X.derived(spark, d, X.JSON_ORDERS, "orders")
    tables = {"customers": customers(spark, d), "events": X.table(spark, d, "events"), "orders": orders}
    columns = {"customers": ["profile", "tags"], "events": ["props"], "orders": ["doc"]}
    return scan_paths(tables, columns).drop("sample")


# A rule list that changed four times; the third version has no rules.
_HISTORY = (
    ("2024-01-04 00:00:00", 0, None, "event_type", "hash"),
    ("2024-01-11 06:30:00", 0, "other", "event_type", "ip"),
    ("2024-01-11 06:30:00", 1, "events", "event_type", "phone"),
    ("2024-01-11 06:30:00", 2, None, "event_type", "email"),
    ("2024-01-17 00:00:00", None, None, None, None),
    ("2024-01-23 12:00:00", 0, "events", "props", "json"),
    ("2024-01-23 12:00:00", 1, "events", "event_type", "no_such_strategy"),
)


@query
def mask_as_of(spark, d):
    """R10, R11, ST7: every event masked by the rules in force at its time."""
    schema = "valid_from string, rule_idx int, `table` string, `column` string, strategy string"
    rules = spark.createDataFrame(list(_HISTORY), schema)
    rules = rules.withColumn("valid_from", F.col("valid_from").cast("timestamp_ntz"))
    events = X.table(spark, d, "events").select("event_id", "ts", "event_type", "props")
    return rows_masked_as_of(events, rules, "ts", "events", version="valid_from")


@query
def stream_committed(spark, d):
    """ST6, ST7: rows and log of whole batches, with the trace of a refused policy file."""
    policy_path, audit = work_dir(spark, "policy"), work_dir(spark, "policy-audit")
    rules = MaskPolicy((Rule(None, "event_type", "hash"),))

    def say(text: str) -> None:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(policy_path)

    say(_policy_text(rules))
    events = X.table(spark, d, "events").select("event_id", "ts", "event_type")
    edge = _span(events)
    seconds = int((edge.b - edge.a).total_seconds()) // 3 + 1
    sdf = replayed(events, _slice("ts", edge.a, seconds), 3).drop("ts")
    out, log = work_dir(spark, "rows"), work_dir(spark, "log")

    def change(batch_id: int, policy: MaskPolicy) -> None:
        # Seen by the next batch: a file that is no policy, then one with another rule.
        if batch_id < 2:
            say("no policy" if batch_id == 0 else _policy_text(MaskPolicy((Rule(None, "event_type", "ssn"),))))

    ST.run_masked(
        sdf, policy_path, out, work_dir(spark, "cp"), log_out=log, keys=("event_id",), on_batch=change, audit_out=audit
    ).awaitTermination()
    rows, logged = ST.read_committed(spark, out), ST.read_committed(spark, out, log)
    trace = spark.read.json(audit)
    refused = trace.agg(F.count_if(F.col("outcome") == "failure")).scalar()
    reloaded = trace.agg(F.count_if(F.col("outcome") == "success")).scalar()
    both = rows.join(logged.select("event_id", F.col("details")[0]["strategy"].alias("strategy")), "event_id")
    return both.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n"), refused.alias("refused"), reloaded.alias("reloaded")
    )
