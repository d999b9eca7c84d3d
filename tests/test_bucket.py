"""Token bucket, ranks and range blocks against row loops."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from maskframe.operators import bucket, ordered
from maskframe.operators.ranks import ranked

START = datetime(2024, 1, 1)


def loop(rows, n, period):
    """(key, time, id) rows that are rejected, one after the other."""
    held, out = {}, set()
    for k, t, i in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        last, left = held.get(k, (None, 0))
        if last is None or t - last >= period:
            last, left = t, n
        if left == 0:
            out.add(i)
        else:
            left -= 1
        held[k] = last, left
    return out


def frame(spark, rows, kind="timestamp_ntz"):
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long").withColumn("ts", F.col("ts").cast(kind))


def rejected(df):
    return {r.id for r in df.where("rejected").collect()}


@pytest.mark.parametrize("n,kind", [(1, "timestamp_ntz"), (3, "timestamp"), (0, "timestamp_ntz")])
def test_against_a_row_loop(spark, n, kind):
    rnd = random.Random(n)
    rows = []
    for i in range(3000):
        k = rnd.choice(["a", "a", "a", "b", "c", None])
        # bursts, gaps of every length, equal times, and times exactly one period apart
        t = START + timedelta(milliseconds=rnd.choice([rnd.randrange(60_000), 250 * rnd.randrange(400), rnd.randrange(60) * 1000 + 86_400_000 * rnd.randrange(3)]))
        rows.append((k, t, i))
    got = bucket.token_bucket(frame(spark, rows, kind), "k", n, "id", per="1 second")
    assert got.count() == len(rows)
    assert rejected(got) == loop(rows, n, timedelta(seconds=1))


def test_hot_key_and_a_large_bucket(spark):
    """One key with a third of all rows; a limit beyond Spark's ranking limit."""
    rnd = random.Random(7)
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", START + timedelta(milliseconds=rnd.randrange(3000) if i % 3 == 0 else rnd.randrange(10**8)), i) for i in range(60_000)]
    assert rejected(bucket.token_bucket(frame(spark, rows), "k", 5000, "id")) == loop(rows, 5000, timedelta(seconds=1))


def test_odd_rows(spark):
    rows = [("a", None, 1), ("a", START, 2), ("a", START, 3), (None, START, 4), (None, START, 5), ("b", datetime(1960, 5, 5, 1, 1, 1, 999_999), 6), ("b", datetime(1960, 5, 5, 1, 1, 2, 999_998), 7), ("b", datetime(1960, 5, 5, 1, 1, 2, 999_999), 8)]
    df = frame(spark, rows).withColumn("p", F.lit(1)).withColumn("t", F.lit(2)).withColumn("fill", F.lit(3)).withColumn("n", F.lit("x"))
    got = {r.id: r.rejected for r in bucket.token_bucket(df, "k", 1, "id").collect()}
    assert got == {1: None, 2: False, 3: True, 4: False, 5: True, 6: False, 7: True, 8: False}
    assert bucket.token_bucket(frame(spark, []), "k", 1, "id").collect() == []


def test_times_far_apart_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(bucket, "BLOCK", 4)
    rnd = random.Random(9)
    rows = [("a", START + timedelta(milliseconds=rnd.randrange(200) * 700 + rnd.randrange(3) * 3_000_000), i) for i in range(800)]
    assert rejected(bucket.token_bucket(frame(spark, rows), "k", 2, "id")) == loop(rows, 2, timedelta(seconds=1))


def test_rounds_are_few(spark, monkeypatch):
    """4,000 fills in a row take a dozen rounds."""
    rounds = []
    real = bucket.staged
    monkeypatch.setattr(bucket, "staged", lambda df, name: rounds.append(name) or real(df, name))
    rows = [("a", START + timedelta(seconds=i), i) for i in range(4000)]
    assert rejected(bucket.token_bucket(frame(spark, rows), "k", 1, "id")) == set()
    assert rounds.count("fills") <= 14 and rounds.count("filled") <= 13


def test_clock_aligned_limit_beyond_the_ranking_limit(spark):
    rows = [("a" if i % 4 else "b", START + timedelta(milliseconds=(i * 7919) % 3_000), i) for i in range(20_000)]
    groups = defaultdict(list)
    for k, t, i in rows:
        groups[k, t.replace(microsecond=0)].append((t, i))
    want = {i for g in groups.values() for _, i in sorted(g)[1500:]}
    assert rejected(ordered.rate_flag(frame(spark, rows), "k", 1500, "id")) == want and want


def test_ranks_in_ranges(spark):
    rows = [(i % 3 if i % 5 else 0, i * 7919 % 10_007, i) for i in range(8_000)]
    got = ranked(spark.createDataFrame(rows, "g int, o int, id int").repartition(7), ["g"], ["o", "id"])
    assert got.columns == ["g", "o", "id", "rank"]
    want = {}
    for g in range(3):
        for rank, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]), 1):
            want[i] = rank
    assert {r.id: r.rank for r in got.collect()} == want


def test_a_burst_of_one_key_is_many_blocks(spark):
    """Health of a key all of whose probes fall into one hour, range blocks against time blocks."""
    rnd = random.Random(2)
    rows = [("hot" if i % 2 else f"k{i % 9}", START + timedelta(milliseconds=rnd.randrange(10_000)), i, rnd.random() < 0.6) for i in range(6_000)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long, ok boolean")
    by_range = ordered.health_state(df, "k", "ok", "id")
    assert sorted(map(tuple, by_range.collect())) == sorted(map(tuple, ordered.health_state(df, "k", "ok", "id", block="1 hour").collect()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as on data that fills the ranges
    try:
        assert sorted(map(tuple, ordered.health_state(df, "k", "ok", "id").collect())) == sorted(map(tuple, by_range.collect()))
        largest = ordered.placed(df, ["k", "ts", "id"]).groupBy("k", "__part").count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert largest < 2_000
