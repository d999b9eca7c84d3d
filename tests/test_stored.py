"""Stored logs, samples, counts, paths, versions of rules and joint commits."""

from __future__ import annotations

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from maskframe import MaskPolicy, Rule, ScanConfig, mask, profile, read_tables, schema_report, write_audit
from maskframe.operators import audit as A
from maskframe.operators import discover as D
from maskframe.operators import stats as K
from maskframe.operators.asof import as_of, mask_as_of
from maskframe.operators.paths import scan_paths
from maskframe.sources import policy_io
from maskframe.sources import tables as S
from maskframe.sources.retention import read_log, retain_days
from maskframe.streaming import streams as ST
from maskframe.streaming.health import health_stream, use_keyed_state

START = datetime(2024, 3, 1)
LOG = "id string, timestamp timestamp_ntz, event_type string, outcome string"


def log_of(spark, n, days=5, nulls=0):
    rnd = random.Random(n)
    rows = [(f"{i:06d}", START + timedelta(seconds=rnd.randrange(days * 86_400) // 600 * 600), "api_access", "success") for i in range(n)]
    return spark.createDataFrame(rows + [(f"x{i}", None, "api_access", "denied") for i in range(nulls)], LOG)


def files(path):
    return {f"{os.path.basename(r)}/{f}": os.stat(os.path.join(r, f)).st_mtime_ns for r, _, fs in os.walk(path) for f in fs if f.endswith(".json")}


@pytest.mark.parametrize("n", [0, 1, 37, 250, 399, 400, 402, 1000])
def test_retention_keeps_the_newest_rows_and_touches_one_day(spark, tmp_path, n):
    log, path = log_of(spark, 400, nulls=3), str(tmp_path / "log")
    write_audit(log, path, by_day=True)
    before = files(path)
    done = retain_days(spark, path, n, LOG)
    want = sorted(((r.timestamp or datetime.min, r.id) for r in log.collect()), reverse=True)[:n]
    left = [r for r in read_log(spark, path, LOG).collect()] if os.listdir(path) else []
    assert sorted(((r.timestamp or datetime.min, r.id) for r in left), reverse=True) == want and done.rows == len(want)
    after = files(path)
    kept = {f for f in before if f in after and before[f] == after[f]}
    touched = {f.split("/")[0] for f in set(before) - kept}
    rewritten = {f"day={done.rewritten or '__HIVE_DEFAULT_PARTITION__'}"} if set(after) - kept else set()
    assert touched == rewritten | {f"day={d or '__HIVE_DEFAULT_PARTITION__'}" for d in done.dropped}
    if left:
        again = retain_days(spark, path, n, LOG)
        assert again.rows == done.rows and not again.dropped and files(path) == after


def test_cube_adds_up(spark):
    log = spark.createDataFrame([("a", "success"), ("a", "denied"), (None, "denied"), ("b", None)], "event_type string, outcome string")
    got = {(r.level, r.event_type, r.outcome): r.n for r in A.cube(log).collect()}
    assert got[3, None, None] == 4 and got[1, "a", None] == 2 and got[2, None, "denied"] == 2
    assert got[1, None, None] == 1 and got[2, None, None] == 1 and got[0, None, "denied"] == 1
    assert sum(n for (level, _, _), n in got.items() if level == 0) == 4


def test_one_wrong_time_does_not_make_an_endless_grid(spark):
    rows = [(datetime(1970, 1, 1), 1), (START, 1), (START + timedelta(seconds=12), 2)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, n int")
    with pytest.raises(Exception, match="give its start and end"):
        K.cumulative(df, ["n"]).collect()
    got = K.cumulative(df, ["n"], start="2024-03-01 00:00:00", end="2024-03-01 00:00:20").orderBy("ts").collect()
    assert [(r.ts.second, r.n) for r in got] == [(5, 2), (10, 2), (15, 4), (20, 4), (25, 4)]
    assert K.cumulative(df.limit(0), ["n"], start="2024-03-01", end="2024-03-01").collect()[0].n == 0


def test_sketches_merge_over_any_span(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("aab"), START + timedelta(seconds=rnd.randrange(86_400)), rnd.lognormvariate(3, 1)) for _ in range(20_000)] + [("c", START, None), ("c", START, 5.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double").repartition(9)
    sketches = K.latency_sketches(df, "k", "v", every="10 minutes").persist()
    assert set(sketches.columns) == {"k", "ts", "n", "sketch"}
    for start, end in ((None, None), ("2024-03-01 06:00:00", "2024-03-01 18:00:00")):
        inside = [r for r in rows if r[2] is not None and (start is None or datetime.fromisoformat(start) <= r[1] < datetime.fromisoformat(end))]
        for r in K.merge_latency(sketches, "k", (0.1, 0.5, 0.999), start, end).collect():
            values = sorted(v for k, _, v in inside if k == r.k)
            assert r.n == len(values)
            for q, guess in ((0.1, r.p10), (0.5, r.p50), (0.999, r.p99_9)):
                below, up_to = sum(v < guess for v in values), sum(v <= guess for v in values)
                assert below / len(values) - 0.015 <= q <= up_to / len(values) + 0.015
    plan = K.merge_latency(sketches, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "kll_merge" in plan
    sketches.unpersist()


def test_sample_is_the_same_for_every_partitioning(spark, sf):
    tables = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("customer", "documents", "region", "conversations", "embeddings")}
    tables["nested"] = spark.range(50).selectExpr("CAST(id % 5 AS STRING) AS s", "map('k', id) AS m", "array(map(id, 'x')) AS l")
    for n in (60, 1500):  # below and beyond Spark's ranking limit
        seen = []
        for parts in (1, 8, 211):
            got = profile({k: t.repartition(parts) for k, t in tables.items()}, ScanConfig(bottom_k=n)).collect()
            seen.append(sorted(map(str, got)))
            for r in got:
                assert r.row_count == min(n, tables[r.table].count())
        assert seen[0] == seen[1] == seen[2]
    plan = D.bottom_k([(0, tables["customer"], [tables["customer"].schema["c_name"]]), (1, tables["region"], [tables["region"].schema["r_name"]])], 60)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")


def test_counts_from_footers_and_fresh_statistics(spark, sf, tmp_path):
    paths = {n: f"{sf}/{n}.parquet" for n in ("orders", "region")}
    plan = S.footer_plan(spark, paths)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedAggregation: [COUNT(*)]") == 2 and "ReadSchema: struct<count(*):bigint>" in plan
    counts = S.footer_counts(spark, paths)
    assert {r.table: r.row_count for r in counts.collect()} == {"orders": 1500, "region": 5}
    report = schema_report({n: spark.read.parquet(p) for n, p in paths.items()}, counts=counts).collect()
    assert [(r.table, r.row_count, len(r.columns)) for r in report] == [("orders", 1500, 6), ("region", 5, 2)]
    spark.conf.set("spark.sql.legacy.createHiveTableByDefault", "false")
    spark.sql(f"CREATE TABLE counted_t (a INT) USING parquet LOCATION '{tmp_path}/t'")
    try:
        spark.range(7).selectExpr("CAST(id AS INT) AS a").write.insertInto("counted_t")
        spark.sql("ANALYZE TABLE counted_t COMPUTE STATISTICS")
        assert S.catalog_row_count(spark, "counted_t") == 7
        assert [tuple(r) for r in S.known_counts(spark, ["counted_t"]).collect()] == [("counted_t", 7)]
        # Rows that the catalog has not seen: its number is stale, so they are counted.
        spark.range(3).selectExpr("CAST(id AS INT) AS a").write.mode("append").parquet(f"{tmp_path}/t")
        spark.sql("REFRESH TABLE counted_t")
        assert S.catalog_row_count(spark, "counted_t") == 7
        assert [tuple(r) for r in S.known_counts(spark, ["counted_t"]).collect()] == [("counted_t", 10)]
    finally:
        spark.sql("DROP TABLE counted_t")


@pytest.mark.parametrize("cuts", [[], [10], [3, 3, 50, 90], ["b", "b'c", "x"], [-1.5, 2.25]])
def test_jdbc_predicates_meet_every_row_once(spark, cuts):
    kind = "string" if cuts and isinstance(cuts[0], str) else "double"
    rows = spark.createDataFrame([(str(v),) if kind == "string" else (float(v),) for v in ([*"abcxyz", "b'c", "b'd"] if kind == "string" else range(-5, 100))] + [(None,)], f"k {kind}")
    counts = [rows.where(p).count() for p in S.jdbc_predicates("k", cuts)]
    assert sum(counts) == rows.count() and len(counts) == max(1, len(set(cuts)) + 1)


def test_jdbc_plan():
    assert S.jdbc_plan(10_000_000, 1, 10_000_000, "id") == {"partitionColumn": "id", "lowerBound": "1", "upperBound": "10000001", "numPartitions": "20"}
    assert S.jdbc_plan(0, 5, 5, "id")["numPartitions"] == "1"
    assert S.jdbc_plan(10**12, 0, 10**12, "id")["numPartitions"] == "256" and S.jdbc_plan(10**9, 1, 3, "id")["numPartitions"] == "3"
    with pytest.raises(ValueError):
        S.jdbc_plan(1, 2, 1, "id")


def leaves(v, path="$"):
    if isinstance(v, dict):
        for k, x in v.items():
            yield from leaves(x, f"{path}.{k}" if k.isidentifier() and k.isascii() else f"{path}[{json.dumps(k, ensure_ascii=False)}]")
    elif isinstance(v, list):
        for x in v:
            yield from leaves(x, f"{path}[*]")
    else:
        yield path, v


def test_paths_against_a_walk(spark):
    rnd = random.Random(8)

    def value(depth):
        kind = rnd.randrange(7 if depth else 5)
        if kind < 5:
            return [1, None, True, "text", f"u{rnd.randrange(9)}@x.org"][kind]
        return [value(depth - 1) for _ in range(rnd.randrange(3))] if kind == 5 else {rnd.choice(["a", "email", "odd key", "é", ""]): value(depth - 1) for _ in range(rnd.randrange(3))}

    docs = [json.dumps({"r": value(4)}) if i % 3 else json.dumps([value(3)]) for i in range(200)] + ["", None, "{bad", "text", "[1", "{}", "[]"]
    df = spark.createDataFrame([(d,) for d in docs], "j string").withColumn("k", F.lit("x")).withColumn("v", F.lit(1))
    want = {}
    for d in docs[:200]:
        for path, v in leaves(json.loads(d)):
            n, hits = want.get(path, (0, 0))
            want[path] = n + 1, hits + (isinstance(v, str) and "@" in v)
    got = {r.path: (r.n_leaves, r.match_count) for r in scan_paths({"t": df.repartition(4)}, {"t": ["j"]}).collect()}
    assert got == want
    found = {r.path: r for r in scan_paths({"t": df}, {"t": ["j"]}).collect()}
    assert all((r.detected_type == "Email") == (r.match_count > 0) for r in found.values())
    assert found["$.r.email"].suggested_type == "Email" if "$.r.email" in found else True
    assert scan_paths({"t": df.limit(0)}, {"t": ["j"]}).count() == 0


def test_as_of_against_a_loop(spark):
    rnd = random.Random(6)
    at = [START + timedelta(minutes=rnd.randrange(600)) for _ in range(40)]
    changes = [(t, i) for i, t in enumerate(at)] + [(at[0], 99), (None, 5)]
    rows = [(i, START + timedelta(minutes=rnd.randrange(-60, 700)) if i % 50 else None) for i in range(3_000)] + [(9_000 + i, at[i]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz").repartition(6)
    moves = spark.createDataFrame(changes, "at timestamp_ntz, v int")
    want = {}
    for i, t in rows:
        past = [c for c in changes if c[0] is not None and t is not None and c[0] <= t]
        want[i] = max(past)[1] if past else None
    for parts in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts)
        try:
            got = as_of(df, moves, "ts", "at", "v", "v")
            assert got.columns == ["id", "ts", "v"] and {r.id: r.v for r in got.collect()} == want
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.v for r in as_of(df, moves.limit(0), "ts", "at", "v", "v").collect()} == {None}
    assert as_of(df.limit(0), moves, "ts", "at", "v", "v").count() == 0


def test_versions_mask_as_their_policies_do(spark):
    versions = {
        START: (Rule(None, "a", "hash"), Rule("t", "n", "ssn"), Rule(None, "a", "ip")),
        START + timedelta(days=1): (Rule("other", "a", "phone"), Rule("t", "b", "prose"), Rule(None, "j", "json")),
        START + timedelta(days=2): (),
        START + timedelta(days=3): (Rule("t", "a", "unknown"), Rule(None, "d", "dob"), Rule(None, "b", "address")),
    }
    history = [(t, i, r.table, r.column, r.strategy) for t, rules in versions.items() for i, r in enumerate(rules)]
    history += [(t, None, None, None, None) for t, rules in versions.items() if not rules]
    rows = [(i, START + timedelta(hours=7 * i - 10), f"u{i}@x.org", f"ask u{i}@x.org" if i % 3 else None, '{"m":"a@b.com"}' if i % 2 else "no json", i, "1990-01-01") for i in range(14)]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz, a string, b string, j string, n int, d string")
    got = {r.id: r for r in mask_as_of(df, spark.createDataFrame(history, "valid_from timestamp_ntz, rule_idx int, `table` string, `column` string, strategy string"), "ts", "t", version="v").collect()}
    for row in rows:
        past = [t for t in versions if t <= row[1]]
        policy = MaskPolicy(versions[max(past)] if past else ())
        one = mask(df.where(F.col("id") == row[0]), policy, "t").first()
        assert got[row[0]].v == (max(past) if past else None)
        assert [str(x) for x in got[row[0]][:-1]] == [str(x) for x in one]


def test_reload_says_what_it_refused(spark, tmp_path):
    path, told = str(tmp_path / "p.json"), []
    first = MaskPolicy((Rule(None, "a", "hash"),))
    policy_io.save_policy(first, path)
    assert policy_io.reload(MaskPolicy(), path, None, lambda now, e: told.append((now, e))) == first and told[-1] == (first, None)
    for text in ("{", "[]", '{"rules": 3}', '{"rules": [{"column": 1}]}', ""):
        with open(path, "w") as f:
            f.write(text)
        assert policy_io.reload(first, path, None, lambda now, e: told.append((now, e))) == first
        assert told[-1][0] == first and told[-1][1] is not None
        row = policy_io.reload_audit(spark, first, *told[-1]).first()
        assert (row.event_type, row.outcome) == ("config_reload", "failure") and row.error
    assert policy_io.reload(first, str(tmp_path / "none"), spark, lambda now, e: told.append((now, e))) == first and told[-1][1]
    assert policy_io.reload_audit(spark, first, first, None) is None
    assert policy_io.reload_audit(spark, MaskPolicy(), first, None).first().outcome == "success"
    with pytest.raises(ZeroDivisionError):  # faults of the program are not swallowed
        policy_io.reload(first, path, None, lambda now, e: 1 / 0)


def test_rows_and_log_are_seen_together_or_not_at_all(spark, tmp_path, monkeypatch):
    policy = str(tmp_path / "policy")
    spark.createDataFrame([(json.dumps(MaskPolicy((Rule(None, "s", "hash"),)).to_dict()),)], "value string").coalesce(1).write.text(policy)
    for k in range(2):
        spark.range(10 * k, 10 * k + 10).selectExpr("id", "concat('s', id) AS s").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    out, log, cp = (str(tmp_path / n) for n in ("out", "log", "cp"))

    def run():
        sdf = spark.readStream.schema("id long, s string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        ST.run_masked(sdf, policy, out, cp, log_out=log, keys=("id",)).awaitTermination()

    real, calls = ST.change_log, []

    def fails(*args, **kw):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost between the two writes")
        return real(*args, **kw)

    monkeypatch.setattr(ST, "change_log", fails)
    assert ST.read_committed(spark, out) is None
    with pytest.raises(Exception, match="lost between"):
        run()
    assert ST.committed(spark, out) == [0] and os.path.exists(f"{out}/batch={1:012d}")
    assert ST.read_committed(spark, out).count() == ST.read_committed(spark, out, log).count() == 10
    run()
    assert ST.committed(spark, out) == [0, 1]
    rows, logged = ST.read_committed(spark, out), ST.read_committed(spark, out, log)
    assert {r.id for r in rows.collect()} == {r.id for r in logged.collect()} == set(range(20))
    assert rows.columns == ["id", "s"]


def test_keyed_health_forgets_idle_keys_and_drops_what_is_too_late(spark, tmp_path):
    use_keyed_state(spark)

    def probe(i, k, minutes, ok):
        return (i, START + timedelta(minutes=minutes), k, ok)

    batches = [
        [probe(1, "a", 0, False), probe(3, "a", 2, False), probe(4, "b", 0, False)],
        [probe(2, "a", 1, False), probe(5, "b", 30, True)],  # 2 comes late, but within the delay
        [probe(6, "b", 600, False)],
        [probe(8, "b", 700, True), probe(7, "a", 3, True)],  # 7 comes when the batch before has passed 25 minutes
        [probe(9, "a", 900, False)],
        [probe(10, "z", 2_000, True)],
        [probe(11, "z", 2_001, True)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "id int, ts timestamp_ntz, k string, ok boolean").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    sdf = spark.readStream.schema("id int, ts timestamp_ntz, k string, ok boolean").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    states = health_stream(sdf, "k", "ok", "id", delay="5 minutes", idle="2 hours")
    assert states.columns[:4] == ["id", "ts", "k", "ok"]
    q = states.writeStream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out")
    q.awaitTermination()
    got = {r.id: (r.healthy, r.consecutive_failures, r.consecutive_successes) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got[1] == (True, 1, 0) and got[2] == (True, 2, 0) and got[3] == (False, 3, 0)
    assert 7 not in got  # dropped
    assert got[9] == (True, 1, 0)  # unhealthy before, forgotten since
    assert got[5] == (True, 0, 1) and got[6] == (True, 1, 0)
    # A quiet key's state is gone, not only unused.
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 6


def test_read_tables_still_reads_folders(spark, sf):
    assert read_tables(spark, sf, ["region"])["region"].count() == 5
