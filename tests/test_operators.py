from __future__ import annotations

import json
import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from maskframe import AuditConfig, MaskPolicy, Rule, ScanConfig, columns_df, profile, scan, scan_summary
from maskframe import write_audit, write_masked
from maskframe.operators import audit as A
from maskframe.operators import ordered as O
from maskframe.operators import stats as K
from maskframe.sources import tables as S

T0 = datetime(2024, 1, 1)


# ---- discovery ---------------------------------------------------------------


def test_scores(spark):
    rows = [("a@b.com" if i < 5 else None, "555-123-4567", "x" if i else "  ", "1990-01-15" if i < 3 else "n")
            for i in range(10)]
    df = spark.createDataFrame(rows, "email string, ssn string, mobile string, free string")
    got = {r.column: r for r in scan({"t": df}).collect()}
    assert (got["email"].confidence, got["email"].match_count, got["email"].sample) == (0.8, 5, "a@***om")
    assert (got["ssn"].pii_type, got["ssn"].confidence) == ("Phone", 0.8)
    assert (got["mobile"].pii_type, got["mobile"].confidence, got["mobile"].sample) == ("Phone", 0.6, None)
    assert "free" not in got
    assert {r.column for r in scan({"t": df}, ScanConfig(confidence_threshold=0.7)).collect()} == {"email", "ssn"}
    low = scan({"t": df}, ScanConfig(confidence_threshold=0.1)).collect()
    assert {r.column: r.confidence for r in low}["free"] == 0.3


def test_ties_empty_tables_and_trimming(spark):
    df = spark.createDataFrame([("555-123-4567",), (" a@b.com ",), ("\t",)], "v string")
    (r,) = profile({"t": df}).collect()
    assert (r.detected_type, r.match_count, r.row_count) == ("Email", 2, 3)
    empty = df.where("false")
    assert scan({"t": empty}).count() == 0
    assert scan({"email_only": empty.withColumnRenamed("v", "email")}).first().confidence == 0.6


def test_sampling_exclusion_and_wide_tables(spark):
    wide = spark.range(300).select(
        "id", *[F.concat(F.lit("u"), "id", F.lit(f"@x{i}.com")).alias(f"c{i:02d}") for i in range(40)]
    )
    some = ScanConfig(sample_size=100, exclude_tables=("other",))
    got = scan({"wide": wide, "other": wide}, some).collect()
    assert len(got) == 40 and {r.row_count for r in got} == {100} and {r.table for r in got} == {"wide"}
    full = scan({"wide": wide}, ScanConfig(sample_size=None, order_by={"wide": "id"})).collect()
    assert {r.row_count for r in full} == {300} and {r.sample for r in full if r.column == "c00"} == {"u0@***com"}
    assert 0 < S.sample_fraction(wide, 0.5, 1).count() < 300
    assert S.sample_rows(wide, 20_000).count() == 300
    part = profile({"wide": wide}, ScanConfig(fraction=0.5)).first()
    assert 0 < part.row_count < 300
    r = scan_summary({"wide": wide}).first()
    assert (r.status, r.tables_scanned, r.columns_scanned, r.findings) == ("completed", 1, 41, 40)


def test_catalog(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "s string, n int")
    tables = {"b": df, "a": df, "pg_x": df, "sql_y": df, "pgsql": df, "pg": df}
    assert {r.table for r in columns_df(spark, tables).collect()} == set(tables)
    shown = columns_df(spark, tables, hide_system=True).collect()
    got = [(r.table, r.column, r.data_type) for r in shown]
    # LIKE 'pg_%' also hides "pgsql": the underscore stands for any character.
    assert got[:2] == [("a", "s", "string"), ("a", "n", "int")] and {g[0] for g in got} == {"a", "b", "pg"}
    assert {r.table: r.row_count for r in S.row_counts({"a": df}).collect()} == {"a": 1}
    df.write.parquet(str(tmp_path / "t.parquet"))
    df.write.json(str(tmp_path / "t.json"))
    assert S.read_tables(spark, str(tmp_path), ["t"])["t"].count() == 1
    assert S.read_tables(spark, str(tmp_path), ["t"], fmt="json")["t"].count() == 1
    text = S.stringify(spark.sql("SELECT 1 AS a, array(1) AS b")).first()
    assert tuple(text) == ("1", "[1]")


# ---- audit -------------------------------------------------------------------


def test_audit_rows_and_sink(spark, tmp_path):
    rows = (
        A.auth_success(spark, "jwt", "u1")
        .unionByName(A.auth_failure(spark, "api_key", "bad"))
        .unionByName(A.auth_denied(spark))
        .unionByName(A.database_scan(spark, "db", 3))
        .unionByName(A.rules_imported(spark, 2))
    )
    assert A.latest(rows, outcome="failure").count() == 1
    assert A.latest(rows, event_type="auth_attempt").count() == 3
    assert A.latest(rows, event_type="nope", outcome="failure").count() == 5
    assert A.latest(rows, outcome="nope").count() == 5 and A.retain(rows, 2).count() == 2
    assert A.admit(rows, AuditConfig(enabled=False)).count() == 0
    assert A.admit(rows, AuditConfig(events=("database_scan",))).count() == 1
    r = A.audit_response(A.latest(rows, 4)).first()
    assert r["count"] == 4 and len(r.entries) == 4
    path = str(tmp_path / "audit")
    write_audit(rows.coalesce(1), path)
    write_audit(A.config_change(spark, {"a": 1}), path)
    lines = [json.loads(x) for f in Path(path).glob("*.json") for x in f.read_text().splitlines()]
    assert len(lines) == 6 and all(None not in x.values() for x in lines)
    assert "error" not in next(x for x in lines if x["event_type"] == "database_scan")
    write_audit(rows, str(tmp_path / "days"), by_day=True)
    assert [p.name[:4] for p in (tmp_path / "days").glob("day=*")] == ["day="]
    for wrong in ({"event_type": "x"}, {"event_type": "api_access", "outcome": "x"}):
        with pytest.raises(ValueError):
            A.audit_row(spark, **wrong)


def test_write_masked(spark, tmp_path):
    df = spark.createDataFrame([("a@b.com", "x")], "e string, k string")
    out = str(tmp_path / "masked")
    write_masked(df, MaskPolicy([Rule(None, "e", "ip")]), out, fmt="json", partition_by=("k",))
    assert spark.read.json(out).first().e == "0.0.0.0"


# ---- statistics --------------------------------------------------------------


def test_statements(spark):
    texts = ["SELECT 1", " select\t2", "INSERT x", "Update x", "DELETE", "TRUNCATE t", "", "  "]
    df = spark.createDataFrame([(t,) for t in texts], "statement string")
    assert tuple(K.statement_counters(df).first()) == (8, 2, 1, 1, 1, 3)
    kinds = [r[0] for r in df.select(K.statement_type(F.col("statement"))).collect()]
    assert kinds[-3:] == ["TRUNCATE", "OTHER", "OTHER"]


def test_shares(spark):
    df = spark.createDataFrame([("a", 2), ("b", 1), ("c", 0)], "k string, n bigint")
    assert {r.k: r.percent for r in K.shares(df, "k").collect()} == {"a": 66.7, "b": 33.3}


def test_cumulative_and_newest_agree_with_a_loop(spark):
    rng = random.Random(5)
    rows = [(T0 + timedelta(seconds=rng.choice([0, 3590, 3600, 9000]) + rng.random() * 100), 1, 1, rng.randint(0, 3))
            for _ in range(300)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, active bigint, queries bigint, masked bigint")
    points = K.history(df, keep=None).orderBy("ts").collect()
    assert all(b.ts - a.ts == timedelta(seconds=5) for a, b in zip(points, points[1:]))
    for p in points[:: max(1, len(points) // 50)] + points[-1:]:
        past = [r for r in rows if r[0] < p.ts]
        assert (p.total_queries, p.total_masked) == (len(past), sum(r[3] for r in past))
    assert points[-1].total_queries == 300
    newest = K.history(df, keep=60).collect()
    assert newest == points[::-1][:60]
    assert K.history(df, keep=10**4).count() == len(points)
    assert [p.ts for p in K.for_chart(K.history(df)).collect()] == [p.ts for p in points[-60:]]


def test_open_sessions(spark):
    df = spark.createDataFrame(
        [(T0, T0 + timedelta(seconds=7)), (T0 + timedelta(seconds=3), None)], "s timestamp_ntz, e timestamp_ntz"
    )
    got = [(r.active_connections, r.total_connections) for r in K.active(df, "s", "e").orderBy("ts").collect()]
    assert got == [(2, 2), (1, 2)]


def test_latency_quantiles(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet")
    exact = {
        r.event_type: (r.p50, r.p95, r.p99)
        for r in df.groupBy("event_type").agg(
            *[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)").alias(n)
              for q, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]
        ).collect()
    }
    got = {r.event_type: (r.p50, r.p95, r.p99) for r in K.latency(df, "event_type", "value").collect()}
    assert got == exact


# ---- time order --------------------------------------------------------------


def skewed(seed, n=1500):
    """Events of which one key and one hour hold more than a third."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randint(0, 20)}"
        second = rng.randint(7200, 7400) if rng.random() < 0.4 else rng.randint(0, 86400)
        rows.append((i, key, T0 + timedelta(seconds=second), rng.random() < 0.5))
    return rows


SCHEMA = "id bigint, k string, ts timestamp_ntz, ok boolean"


def machine(rows, bad, good):
    state, out = {}, {}
    for i, k, t, ok in sorted(rows, key=lambda r: (r[2], r[0])):
        h, f, s = state.get(k, (True, 0, 0))
        f, s = (0, s + 1) if ok else (f + 1, 0)
        h = False if f >= bad else True if s >= good else h
        state[k] = (h, f, s)
        out[i] = state[k]
    return out, state


@pytest.mark.parametrize("bad,good,block", [(3, 1, "1 hour"), (2, 3, "5 minutes"), (4, 2, "1 minute")])
def test_health_state(spark, bad, good, block):
    rows = skewed(bad)
    df = spark.createDataFrame(rows, SCHEMA)
    states = O.health_state(df, "k", "ok", "id", bad=bad, good=good, block=block)
    want, last = machine(rows, bad, good)
    got = {r.id: (r.healthy, r.consecutive_failures, r.consecutive_successes) for r in states.collect()}
    assert got == want
    report = O.health_report(states, "k", "id").collect()
    assert {r.k: (r.healthy, r.consecutive_failures, r.consecutive_successes) for r in report} == last


def test_health_state_continues(spark):
    rows = sorted(skewed(9), key=lambda r: (r[2], r[0]))
    first, second = rows[:700], rows[700:]
    want, _ = machine(rows, 3, 2)
    _, state = machine(first, 3, 2)
    known = spark.createDataFrame(
        [(k, *v) for k, v in state.items()],
        "k string, healthy boolean, consecutive_failures bigint, consecutive_successes bigint",
    )
    df = spark.createDataFrame(second, SCHEMA)
    got = O.health_state(df, "k", "ok", "id", bad=3, good=2, state=known).collect()
    assert {r.id: (r.healthy, r.consecutive_failures, r.consecutive_successes) for r in got} == {
        r[0]: want[r[0]] for r in second
    }


def test_idle_sessions(spark):
    rows = skewed(2) + [(9000 + i, "edge", T0 + timedelta(seconds=300 * i), True) for i in range(3)]
    rows += [(9100 + i, "near", T0 + timedelta(seconds=299 * i), True) for i in range(3)]
    want = []
    for k in {r[1] for r in rows}:
        times = sorted(r[2] for r in rows if r[1] == k)
        run = [times[0]]
        for t in times[1:]:
            if t - run[-1] >= timedelta(seconds=300):
                want.append((k, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        want.append((k, run[0], run[-1], len(run)))
    got = O.idle_sessions(spark.createDataFrame(rows, SCHEMA), "k").collect()
    assert sorted((r.k, r.start, r.last_seen, r.n_events) for r in got) == sorted(want)
    assert all(r.end - r.last_seen == timedelta(seconds=300) for r in got)


def test_rate(spark):
    rows = skewed(4)
    df = spark.createDataFrame(rows, SCHEMA)
    flagged = O.rate_flag(df, "k", 3, "id", per="1 minute")
    seen, want = {}, set()
    for i, k, t, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        group = (k, t.replace(second=0))
        seen[group] = seen.get(group, 0) + 1
        if seen[group] > 3:
            want.add(i)
    got = flagged.collect()
    assert len(got) == len(rows) and {r.id for r in got if r.rejected} == want
    counts = O.rate_counts(df, "k", 3, per="1 minute").agg(F.sum("accepted"), F.sum("rejected")).first()
    assert tuple(counts) == (len(rows) - len(want), len(want))
