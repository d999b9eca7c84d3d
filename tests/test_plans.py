"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from maskframe import MaskPolicy, Rule, ScanConfig, change_log, mask, scan
from maskframe.operators import audit as A
from maskframe.operators import ordered as O
from maskframe.operators import rules as R
from maskframe.plans import fixtures as X
from maskframe.plans.queries import POLICY, audit_rows, customers, orders


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_masking_and_its_log_do_not_shuffle(spark, sf):
    for df in (
        mask(customers(spark, sf), POLICY, "customers"),
        change_log(customers(spark, sf), POLICY, "customers"),
        mask(orders(spark, sf), MaskPolicy(), coerce=True),
    ):
        text = plan(df)
        assert "Exchange" not in text and "Python" not in text and "Sort" not in text


def test_masking_prunes_and_pushes(spark, sf):
    raw = X.table(spark, sf, "documents").where("doc_id > 5")
    text = plan(mask(raw, MaskPolicy([Rule(None, "text", "hash")])).select("doc_id", "lang"))
    assert "GreaterThan(doc_id,5)" in text
    assert re.search(r"ReadSchema: struct<doc_id:bigint,lang:string>", text)


def test_a_value_is_classified_once(spark, sf):
    from maskframe.functions import patterns as P

    df = X.table(spark, sf, "benchmark").select("text")
    text = df.select(F.lit(1).alias("i"), "text")
    masked = mask(text, MaskPolicy())._jdf.queryExecution().optimizedPlan().toString()
    log = change_log(text, MaskPolicy())._jdf.queryExecution().optimizedPlan().toString()
    # Once for the cell and once per kind of container; never once per result.
    assert masked.count(P.SHORT_PATTERN) <= 3 and log.count(P.SHORT_PATTERN) <= 3


def test_scan_sends_one_row_per_task_and_reads_text_only(spark, sf):
    text = plan(scan({"lineitem": X.table(spark, sf, "lineitem")}, ScanConfig(sample_size=None)))
    # All tables are counted by column number in one exchange, after a partial count in each task.
    assert text.count("Exchange") == 1 and re.search(r"Exchange hashpartitioning\(k#\d+", text)
    assert text.rindex("partial_sum(n") > text.index("Exchange")
    assert "ReadSchema: struct<l_returnflag:string,l_linestatus:string>" in text
    assert "Sort " not in text.replace("SortAggregate", "")


def test_latest_is_a_top_n(spark, sf):
    text = plan(A.latest(audit_rows(spark, sf), 10, outcome="denied"))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_uncovered_and_resolved_rules_are_equality_joins(spark, sf):
    rules = X.derived(spark, sf, X.RULES, "orders")
    found = X.derived(spark, sf, X.CATALOG, "part").withColumn("pii_type", F.lit("Ssn"))
    for df in (R.uncovered(found, rules), R.resolved_rules_df(found.drop("pii_type"), rules)):
        text = plan(df)
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_time_order_works_on_combined_rows(spark, sf):
    events = X.table(spark, sf, "events")
    text = plan(O.rate_flag(events, "event_type", 3, "event_id"))
    assert "WindowGroupLimit" in text and "Partial" in text
    text = plan(O.idle_sessions(events, "user_id"))
    # The order per key is over buckets: an aggregate lies below the window.
    assert text.index("Window") < text.index("partial_min(ts")
    probes = events.withColumn("ok", F.col("event_type") != "error")
    text = plan(O.health_state(probes, "user_id", "ok", "event_id"))
    assert "hashpartitioning(user_id" in text and re.search(r"hashpartitioning\(user_id#\d+L, __block", text)


def test_long_cells_of_short_rows_are_masked_in_many_tasks(spark, sf):
    from maskframe.plans.queries import mask_json_hostile

    assert X.table(spark, sf, "customer").rdd.getNumPartitions() == 1
    found = mask_json_hostile(spark, sf)
    parts = [len(p) for p in found.rdd.glom().collect()]
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert min(parts) > 0 and max(parts) - min(parts) <= 8
    # Only the key is dealt out, before the cells are made of it.
    text = plan(found)
    assert re.search(r"Exchange RoundRobinPartitioning\(\d+\), REPARTITION_BY_NUM.*\n.*FileScan parquet \[c_custkey#\d+L\]", text)
