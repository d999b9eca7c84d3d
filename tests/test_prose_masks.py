"""Fakes inside prose, their log, and counts of changed cells while a job runs."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation
from pyspark.sql import functions as F

from maskframe import MaskPolicy, Rule, change_log, mask, mask_prose, mask_value, observed, prose_log, prose_scan, redact_text, register_functions
from maskframe.functions import patterns as P
from maskframe.plans import fixtures as X

VALUES = {
    "Email": "jane.doe+x@mail.example.org",
    "CreditCard": "1234 5678-9012 3456",
    "Ssn": "123-45-6789",
    "IpAddress": "10.0.0.255",
    "DateOfBirth": "1990/01/15",
    "Phone": "+1-555-123-4567",
    "Passport": "AB1234567",
}


def masked(spark, texts, fn=mask_prose):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn("t")).collect()]


def fake(spark, t):
    return spark.range(1).select(mask_value(F.lit(VALUES[t]), P.TYPE_STRATEGY[t])).first()[0]


@pytest.mark.parametrize("glue", [" ", ", ", "\n", "<>", "\u0001", "（）"])
def test_every_piece_gets_its_columns_fake(spark, glue):
    text = glue + glue.join(VALUES.values()) + glue
    want = glue + glue.join(fake(spark, t) for t in VALUES) + glue
    assert masked(spark, [text]) == [want]


def test_gaps_and_edges(spark):
    assert masked(spark, [None, "", "a", "10.0.0.1", "x10.0.0.1 10.0.0.1", "\u0001", "\u0001 10.0.0.1\u0001\u0001AB123456\u0001"]) == [
        None, "", "a", "0.0.0.0", "x10.0.0.1 0.0.0.0", "\u0001", "\u0001 0.0.0.0\u0001\u0001XXXXXXXX\u0001",
    ]


def test_text_of_any_kind_keeps_its_gaps(spark):
    alphabet = st.sampled_from(["12", "3456", "-", " ", ".", "@", "a", "b.co", "AB", "(", ")", "/", "+1", "\u0001", "é", "255"])

    @settings(max_examples=4, deadline=None)
    @given(st.lists(st.lists(alphabet, max_size=20).map("".join), min_size=150, max_size=150))
    def check(texts):
        """Redaction by the joint pattern in Python, where patterns can look around too."""
        joint = re.compile(P.ANY_IN_TEXT.replace(r"\p{Nd}", r"\d").replace(r"\x{17f}", "ſ").replace(r"\x{212a}", "K").replace(P.WS_CLASS, re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), P.WS_CLASS)))
        found = [joint.findall(t) for t in texts]
        tags = re.compile("|".join(map(re.escape, P.TAGS.values())))
        for text, hits, out in zip(texts, found, masked(spark, texts, redact_text), strict=True):
            assert len(tags.findall(out)) == len(hits)
            assert tags.split(out) == joint.split(text)

    check()


def test_log_and_scan(spark):
    text = "a@b.com and 10.0.0.1, again a@b.com"
    df = spark.createDataFrame([(1, text), (2, None), (3, "none")], "id int, t string")
    log = prose_log(df, "t", ("id",)).orderBy("hit_idx").collect()
    assert [(r.id, r.hit_idx, r.pii_type, r.original) for r in log] == [(1, 0, "Email", "a@***om"), (1, 1, "IpAddress", "10***.1"), (1, 2, "Email", "a@***om")]
    assert log[0].masked == log[2].masked and log[1].masked == "0.0.0.0"
    assert {(r.pii_type, r.n_found) for r in prose_scan(df, "t").collect()} == {("Email", 2), ("IpAddress", 1)}


def test_prose_rule_with_salt_log_and_sql(spark):
    df = spark.createDataFrame([(1, "ask a@b.com"), (2, "nothing"), (3, None)], "id int, t string")
    policy = MaskPolicy([Rule(None, "t", "prose")])
    plain, salted = (dict(tuple(r) for r in mask(df, policy, salt=s).collect()) for s in ("", "s"))
    assert plain[2] == salted[2] == "nothing" and plain[3] is None
    assert plain[1].startswith("ask user.") and plain[1] != salted[1]
    log = change_log(df, policy, keys=("id",)).collect()
    assert [(r.id, r.details[0].strategy, r.details[0].masked) for r in log] == [(1, "prose", plain[1])]
    register_functions(spark)
    assert spark.sql("SELECT mask_prose('ask a@b.com') a, redact_text('ask a@b.com') b").first() == (plain[1], "ask [EMAIL]")


def test_log_names_every_cell_that_masking_changes(spark, sf):
    """Broken JSON and lists without quotes too."""
    hostile = X.derived(spark, sf, X.HOSTILE, "customer").select("c_custkey", "cell").unionByName(
        spark.createDataFrame([(-1, "[a@b.com, x]"), (-2, "[1, 2]"), (-3, '{"a@b.com",x}')], "c_custkey long, cell string")
    )
    changed = {r.c_custkey for r in mask(hostile.withColumn("was", F.lit(1)), MaskPolicy()).join(hostile.withColumnRenamed("cell", "before"), "c_custkey").where("cell != before").collect()}
    logged = {r.c_custkey for r in change_log(hostile, MaskPolicy(), keys=("c_custkey",)).collect()}
    assert changed == logged and -1 in logged and -2 not in logged and -3 in logged


def test_observed_counts_heuristic_hits(spark):
    df = spark.createDataFrame(
        [("a@b.com", '{"x":"10.0.0.1"}', "n", 5, ["1.1.1.1"]), ("none", "{}", None, 6, []), (None, "c@d.org", "m", 7, None)],
        "a string, b string, c string, d int, e array<string>",
    )
    seen = Observation()
    out = observed(df, MaskPolicy([Rule(None, "c", "hash"), Rule(None, "d", "ssn")]), seen)
    rows = out.collect()
    assert out.columns == df.columns and rows[1].a == "none"
    assert seen.get == {"rows": 3, "masked_a": 1, "masked_b": 2, "masked_c": 2, "masked_d": 3, "masked_e": 1}
    assert sorted(map(str, rows)) == sorted(map(str, mask(df, MaskPolicy([Rule(None, "c", "hash"), Rule(None, "d", "ssn")])).collect()))
