from __future__ import annotations

import json
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from maskframe import MaskPolicy, Rule, mask, save_policy
from maskframe.operators import ordered as O
from maskframe.streaming import streams as ST
from test_operators import SCHEMA, machine, skewed


def files(spark, rows, schema, path, n):
    """Write rows as ``n`` files in order."""
    import os
    import time

    size = -(-len(rows) // n)
    for i in range(n):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1)
        part.write.mode("append").parquet(path)
        newest = max(Path(path).glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
        stamp = time.time() - 1000 + i * 10
        os.utime(newest, (stamp, stamp))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_masked_stream_and_policy_reload(spark, tmp_path):
    rows = [(i, f"user{i}@example.com") for i in range(90)]
    sdf = files(spark, rows, "id bigint, v string", str(tmp_path / "in"), 3)
    policy = str(tmp_path / "policy.yaml")
    save_policy(MaskPolicy([Rule(None, "v", "ip")]), policy)
    seen = []

    def on_batch(batch_id, current):
        seen.append(current.rules[0].strategy)
        if batch_id == 0:
            save_policy(MaskPolicy([Rule(None, "v", "passport")]), policy)
        if batch_id == 1:
            Path(policy).write_text("rules: nonsense")

    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    ST.run_masked(
        sdf, policy, out, str(tmp_path / "cp"), log_out=log, keys=("id",), on_batch=on_batch
    ).awaitTermination()
    assert seen == ["ip", "passport", "passport"]
    got = {r.id: r.v for r in spark.read.parquet(out).collect()}
    assert len(got) == 90 and {got[0], got[89]} == {"0.0.0.0", "XXXXXXXX"}
    logged = spark.read.parquet(log).select("id", F.col("details")[0]["masked"].alias("m"))
    assert {r.id: r.m for r in logged.collect()} == got


def test_stateless_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"555-000-{i:04d}", json.dumps({"a": f"u{i}@x.com"})) for i in range(50)]
    schema = "id bigint, p string, j string"
    sdf = files(spark, rows, schema, str(tmp_path / "in"), 2)
    out = str(tmp_path / "out")
    (
        ST.mask_stream(sdf, MaskPolicy())
        .writeStream.option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .format("json")
        .start(out)
        .awaitTermination()
    )
    batch = mask(spark.createDataFrame(rows, schema), MaskPolicy())
    stream = spark.read.schema(schema).json(out)
    assert stream.count() == 50 and stream.exceptAll(batch).count() == 0


def test_health_over_batches(spark, tmp_path):
    rows = sorted(skewed(6, 600), key=lambda r: (r[2], r[0]))
    sdf = files(spark, rows, SCHEMA, str(tmp_path / "in"), 3)
    out = str(tmp_path / "out")
    ST.run_health(
        sdf, "k", "ok", "id", out, str(tmp_path / "state"), str(tmp_path / "cp"), bad=3, good=2
    ).awaitTermination()
    got = spark.read.parquet(out).collect()
    want, _ = machine(rows, 3, 2)
    assert {r.id: (r.healthy, r.consecutive_failures, r.consecutive_successes) for r in got} == want
    assert len(list(Path(out).glob("batch=*"))) == 3


def test_windows_and_sessions(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(i, "a" if i % 3 else "b", t0 + timedelta(seconds=20 * i), True) for i in range(60)]
    rows.append((99, "a", t0 + timedelta(days=1), True))
    sdf = files(spark, rows, SCHEMA, str(tmp_path / "in"), 2)

    def drain(df, name):
        out = str(tmp_path / name)
        (
            df.writeStream.option("checkpointLocation", str(tmp_path / f"{name}-cp"))
            .trigger(availableNow=True)
            .format("parquet")
            .start(out)
            .awaitTermination()
        )
        return spark.read.schema(df.schema).parquet(out)

    counted = drain(ST.stream_counters(sdf, "k", window="5 minutes", delay="1 minute"), "counters")
    assert counted.agg(F.sum("n")).first()[0] == 60
    sessions = drain(ST.stream_sessions(sdf, "k", delay="1 minute"), "sessions")
    batch = O.idle_sessions(spark.createDataFrame(rows[:-1], SCHEMA), "k")
    key = lambda r: (r.k, r.start.replace(tzinfo=None), r.end.replace(tzinfo=None), r.n_events)
    assert sorted(map(key, sessions.collect())) == sorted(map(key, batch.collect()))
