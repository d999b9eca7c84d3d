"""Free text, and what the first round's operators got wrong."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from maskframe import MaskPolicy, Rule, read_tables, redact_text, token_scan, uncovered
from maskframe.functions import patterns as P
from maskframe.operators.rules import delete_rules
from maskframe.operators.stats import cumulative, statement_type, step_micros
from maskframe.sources.policy_io import load_policy, rules_df, save_policy


def one(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(redact_text("t")).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("mail me at a@b.com or 123-45-6789.", "mail me at [EMAIL] or [SSN]."),
        ("card 1234-5678-9012-3456, ip 10.0.0.1; born 1990-01-15", "card [CREDIT_CARD], ip [IP]; born [DOB]"),
        ("call (555) 123-4567 or +1-555-123-4567", "call [PHONE] or [PHONE]"),
        ("passport AB1234567)", "passport [PASSPORT])"),
        ("<a href='mailto:x.y@z.org'>", "<a href='mailto:[EMAIL]'>"),
        ("v192.168.1.1.5 and 12345678901234567890", "v192.168.1.1.5 and 12345678901234567890"),
        ("no numbers here", "no numbers here"),
        ("", ""),
        (None, None),
    ],
)
def test_redact(spark, text, want):
    assert one(spark, text) == want


def test_every_token_that_classifies_is_redacted(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(
        spark.createDataFrame([(-1, "x 555.123.4567 y AB123456 2000/12/31 a@b.co")], "doc_id long, text string"), True
    )
    assert {r.pii_type for r in token_scan(docs.where("doc_id = -1"), "text").collect()} == {"Phone", "Passport", "DateOfBirth", "Email"}
    assert token_scan(docs.select(redact_text("text").alias("text")), "text").count() == 0


def test_tags_are_the_only_change(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", redact_text("text").alias("out")).collect()
    tags = "|".join(map(re.escape, P.TAGS.values()))
    for d in docs:
        at = 0
        for part in re.split(tags, d.out):
            assert (at := d.text.find(part, at)) >= 0
            at += len(part)


@pytest.mark.parametrize("every", ["7 seconds", "45 minutes", "2 hours", "1 day", "1 hour 1 second"])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_steps_of_any_length(spark, every, kind):
    rows = spark.range(600).select(
        (F.timestamp_seconds(F.col("id") * F.col("id") * 7 % 90_000 + 1_704_067_000)).cast(kind).alias("ts"), F.lit(1).alias("n")
    )
    step = step_micros(every) // 1_000_000
    seconds = [1_704_067_000 + i * i * 7 % 90_000 for i in range(600)]
    first, last = min(seconds) // step, max(seconds) // step
    want = [((k + 1) * step, sum(s < (k + 1) * step for s in seconds)) for k in range(first, last + 1)]
    got = cumulative(rows, ["n"], every=every).select(F.col("ts").cast("timestamp").cast("long").alias("s"), "n")
    assert sorted((r.s, r.n) for r in got.collect()) == want


def test_steps_that_are_none():
    for bad in ("1 month", "0 seconds", "five seconds"):
        with pytest.raises(ValueError):
            step_micros(bad)


def test_delete_counts_what_is_left(spark):
    rules = rules_df(spark, MaskPolicy(tuple(Rule(None, c, "hash") for c in "abcd")))
    once = delete_rules(rules, index=0)
    assert [(r.rule_idx, r.column) for r in delete_rules(once, index=0).orderBy("rule_idx").collect()] == [(0, "c"), (1, "d")]
    with pytest.raises(Exception, match="no rule at position 4"):
        delete_rules(rules, index=4).collect()


def test_null_statement_is_other(spark):
    df = spark.createDataFrame([(None,), ("",), (" select 1",)], "t string")
    assert [r[0] for r in df.select(statement_type(F.col("t"))).collect()] == ["OTHER", "OTHER", "SELECT"]


def test_uncovered_reads_rules_once(spark):
    found = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y"), ("b", "z")], "table string, column string")
    rules = spark.createDataFrame([(0, "a", "x"), (1, None, "z"), (2, "q", "y"), (3, "a", "x")], "rule_idx long, table string, column string")
    assert sorted(tuple(r) for r in uncovered(found, rules).collect()) == [("a", "y"), ("b", "x")]


def test_policy_and_tables_on_spark_paths(spark, tmp_path):
    policy = MaskPolicy((Rule("t", "c", "hash"),))
    save_policy(policy, f"file://{tmp_path}/p.yaml", spark)
    assert load_policy(f"file://{tmp_path}/p.yaml", spark) == policy
    spark.range(3).write.parquet(f"{tmp_path}/plain")
    assert read_tables(spark, str(tmp_path), ["plain"])["plain"].count() == 3
