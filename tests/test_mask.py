from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from maskframe import (
    MaskPolicy,
    Rule,
    change_log,
    leaf_scan,
    mask,
    mask_json,
    mask_pg_array,
    mask_sql,
    mask_value,
    masking_counters,
    masking_counters_wide,
    observed,
    partial,
    preview,
    quick,
    register_functions,
    register_strategy,
)
from maskframe.functions.units import human_bytes, human_ms

NONE = MaskPolicy()


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn("v").alias("r")).first().r


def test_heuristics_nulls_and_order(spark):
    df = spark.createDataFrame(
        [(1, "a@b.com", "hello", None), (2, None, "555-123-4567", "x")],
        "id int, a string, b string, c string",
    )
    out = mask(df, NONE)
    assert out.columns == df.columns
    r1, r2 = out.orderBy("id").collect()
    assert "@" in r1.a and r1.a != "a@b.com" and r1.b == "hello" and r1.c is None
    assert r2.a is None and r2.b.startswith("555-") and r2.b != "555-123-4567" and r2.c == "x"


def test_rule_beats_heuristic_and_needs_no_pattern(spark):
    df = spark.createDataFrame([("a@b.com", "plain", None)], "email_col string, p string, n string")
    policy = MaskPolicy([Rule(None, "email_col", "address"), Rule(None, "p", "ssn"), Rule(None, "n", "ip")])
    r = mask(df, policy).first()
    assert "@" not in r.email_col and r.p.startswith("XXX-XX-") and r.n is None


def test_table_scope_first_rule_and_case(spark):
    df = spark.createDataFrame([("v",)], "c string")
    policy = MaskPolicy([Rule("other", "c", "ip"), Rule("t", "c", "dob"), Rule(None, "c", "ssn")])
    assert mask(df, policy, table="t").first().c == "1900-01-01"
    assert mask(df, policy, table="u").first().c.startswith("XXX-XX-")
    assert mask(df, policy, table="t", ignore_table=True).first().c == "0.0.0.0"
    assert mask(df, MaskPolicy([Rule(None, "C", "ip")])).first().c == "v"


def test_disabled_returns_the_same_rows(spark):
    df = spark.createDataFrame([("a@b.com",)], "c string")
    policy, change = MaskPolicy([Rule(None, "c", "ip")]).set_enabled(False)
    assert mask(df, policy) is df
    assert change == {"masking_enabled": {"old": True, "new": False}}
    assert change_log(df, policy).count() == 0


def test_deterministic_and_salted(spark):
    df = spark.createDataFrame([("a@b.com",), ("a@b.com",), ("c@d.com",)], "v string")
    got = [r.v for r in mask(df, NONE).collect()]
    assert got[0] == got[1] != got[2]
    assert mask(df, NONE, salt="s").first().v != got[0]


def test_no_original_survives(spark):
    values = [f"user{i}@example.com" for i in range(200)] + [f"555-000-{i:04d}" for i in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert mask(df, NONE).join(df, "v", "left_semi").count() == 0


def test_constant_strategies_are_idempotent(spark):
    df = spark.createDataFrame([("10.1.2.3", "1990-01-15")], "ip string, dob string")
    once = mask(df, NONE)
    assert mask(once, NONE).first() == once.first()


def test_types_kept_or_changed(spark):
    df = spark.sql("SELECT 7 AS n, DATE'1990-01-15' AS d, DATE'1990-01-15' AS e, array('a@b.com') AS a")
    policy = MaskPolicy([Rule(None, "n", "hash"), Rule(None, "d", "dob"), Rule(None, "a", "ip")])
    out = mask(df, policy)
    assert dict(out.dtypes) == {"n": "string", "d": "date", "e": "date", "a": "string"}
    r = out.first()
    assert str(r.d) == "1900-01-01" and str(r.e) == "1990-01-15" and r.a == "0.0.0.0"
    assert mask(df, NONE, coerce=True).first().e == "1900-01-01"


def test_coerced_binary(spark):
    df = spark.createDataFrame([(bytearray(b"a@b.com"),), (bytearray(b"\xff\xfe"),)], "b binary")
    a, b = (bytes(r.b) for r in mask(df, NONE, coerce=True).collect())
    assert a.endswith(b"@example.com") and b == b"\xff\xfe"
    assert bytes(mask(df, NONE).first().b) == b"a@b.com"


def test_native_nested(spark):
    df = spark.sql(
        "SELECT array(array('a@b.com', NULL), array('x')) AS a, map('k@k.com', '1.2.3.4') AS m, "
        "named_struct('s', '123-45-6789', 'n', 3, 'deep', array(named_struct('p', 'AB1234567'))) "
        "AS s, CAST(NULL AS STRUCT<q: STRING>) AS z, parse_json('{\"z\": \"a@b.com\"}') AS v"
    )
    out = mask(df, NONE)
    r = out.withColumn("v", F.to_json("v")).first()
    assert r.a[0][0].endswith("@example.com") and r.a[0][1] is None and r.a[1] == ["x"]
    assert r.m == {"k@k.com": "0.0.0.0"} and r.z is None
    assert r.s.s.startswith("XXX-XX-") and r.s.n == 3 and r.s.deep[0].p == "XXXXXXXX"
    assert json.loads(r.v)["z"].endswith("@example.com")
    assert out.dtypes == df.dtypes


def test_json_leaves_and_bytes_between(spark):
    text = (
        '{ "user": {"email": "test@example.com" ,"name":"John \\"Doe\\", x"},\n "payment":{"cc":'
        '"1234-5678-9012-3456"},"tags":["a@b.com","not-pii", 1234567890123456],'
        '"k@k.com" : {"esc":"a\\u0040b.com"}, "d":"1990\\/01\\/15", "q":"say \\"c@d.com\\""}'
    )
    got = one(spark, text, mask_json)
    out = json.loads(got)
    assert out["user"]["email"].endswith("@example.com") and out["user"]["name"] == 'John "Doe", x'
    assert out["payment"]["cc"][0] == "4" and out["tags"][1:] == ["not-pii", 1234567890123456]
    assert out["k@k.com"]["esc"] == out["tags"][0] and out["d"] == "1900-01-01"
    assert out["q"] == 'say "c@d.com"' and got.startswith('{ "user": {"email": "user.')


def brute_json(value, fakes):
    if isinstance(value, str):
        return fakes.get(value, value)
    if isinstance(value, list):
        return [brute_json(v, fakes) for v in value]
    if isinstance(value, dict):
        return {k: brute_json(v, fakes) for k, v in value.items()}
    return value


def test_json_against_a_recursive_walk(spark):
    rng = random.Random(3)
    leaves = [
        "a@b.com", "123-45-6789", "1990-01-15", "10.0.0.1", "555-123-4567", "AB1234567",
        "1234 5678 9012 3456", "1234\t5678\t9012\t3456", "plain", 'q"a@b.com"', "x\\", "a@b.com\\",
        "é a@b.com", "", ",", "multi\nline", "1990/01/15", "{", "[a@b.com]", "é@b.com",
    ]

    def build(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.4:
            return rng.choice([*leaves, *leaves, 5, 1.5, None, True])
        if kind < 0.7:
            return [build(depth - 1) for _ in range(rng.randint(0, 4))]
        return {rng.choice(leaves) + str(i): build(depth - 1) for i in range(rng.randint(0, 4))}

    df = spark.createDataFrame([(v,) for v in leaves if v[:1] not in ("{", "[")], "v string")
    fakes = {a.v: b.v for a, b in zip(df.collect(), mask(df, NONE).collect())}
    docs = [{"r": build(4)} for _ in range(400)]
    texts = [
        json.dumps(d, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for d in docs
    ]
    got = spark.createDataFrame([(t,) for t in texts], "v string").select(mask_json("v")).collect()
    assert [json.loads(r[0]) for r in got] == [brute_json(d, fakes) for d in docs]


def test_long_literals_do_not_overflow(spark):
    text = '{"k":"' + 'x\\"y' * 100000 + '","e":"a\\u0040b.com"}'
    got = one(spark, text, mask_json)
    assert len(got) > 400000 and "@example.com" in got


def test_pg_array(spark):
    got = one(spark, '{"test@example.com","normal_val",1234-5678-9012-3456, "a,b" ,"x\\"y"}', mask_pg_array)
    assert got.startswith('{"user.') and '"normal_val"' in got and ', "a,b" ,"x\\"y"}' in got
    assert ',"4' in got
    for same in ("{}", "{a,b}", "{{a@b.com},{b}}", '{"a@b.com,x"}', "{a@b.com", "plain", "{ }"):
        assert one(spark, same, mask_pg_array) == same
    assert one(spark, '{"unclosed,a@b.com}', mask_pg_array) == '{"unclosed,a@b.com}'


def test_containers_fall_through(spark):
    df = spark.createDataFrame(
        [('{"a":"a@b.com"} x',), ('{"a":1},{"b":"a@b.com"}',), ("[a@b.com]",), (' {"a":"a@b.com"} ',)],
        "v string",
    )
    got = [r.v for r in mask(df, NONE).collect()]
    # Not in brackets; refused as JSON, and a bare list: masked all the same.
    assert got[0] == '{"a":"a@b.com"} x'
    assert got[1].startswith('{"a":1},{"b":"user.') and "a@b.com" not in got[1]
    assert got[2].startswith('["user.') and "a@b.com" not in got[2]
    assert got[3].startswith(' {"a":"user.')


def test_custom_strategy(spark):
    register_strategy("shout", lambda c: F.upper(c))
    df = spark.createDataFrame([("abc", None)], "a string, b string")
    policy = MaskPolicy([Rule(None, "a", "shout"), Rule(None, "b", "shout")])
    assert tuple(mask(df, policy).first()) == ("ABC", None)
    detail = change_log(df, policy).first().details
    assert len(detail) == 1 and detail[0].masked == "ABC" and detail[0].strategy == "shout"
    with pytest.raises(ValueError):
        register_strategy("email", lambda c: c)


def test_strategies(spark):
    df = spark.createDataFrame([("v",)], "v string")
    names = ["email", "phone", "address", "credit_card", "ssn", "ip", "dob", "passport", "hash", "zzz"]
    r = df.select(*[mask_value("v", n).alias(n) for n in names]).first()
    assert r.email.endswith("@example.com") and r.ip == "0.0.0.0" and r.zzz == "MASKED"
    assert len(r.hash) == 7 + 64 and len(r.credit_card) == 19 and r.passport == "XXXXXXXX"
    assert df.select(mask_value("v", "hash", strict_reference=True)).first()[0] == "MASKED"


def test_change_log_and_counters(spark):
    df = spark.createDataFrame(
        [
            (1, "a@b.com", '{"e":"a@b.com"}', "{a@b.com,b}"),
            (2, "x", '{"k": 69}', "{a,b}"),
            (3, None, "not json", "x" * 60),
        ],
        "id int, a string, j string, t string",
    )
    log = change_log(df, NONE, keys=("id",), previews="sample")
    (row,) = log.collect()
    assert (row.id, row.event_type, row.content) == (1, "DataMasked", "Masked 3 fields in DataRow")
    assert [d.strategy for d in row.details] == ["email", "json (heuristic)", "array (heuristic)"]
    assert [d.column_idx for d in row.details] == [1, 2, 3]
    assert row.details[0].original == "a@***om" and row.details[1].masked == "(JSON Masked)"
    assert {r.strategy: r.n for r in masking_counters(log).collect()} == {"email": 1, "json": 1, "other": 1}
    wide = masking_counters_wide(log).first()
    assert (wide.total, wide.email, wide.json, wide.other, wide.phone) == (3, 1, 1, 1, 0)
    policy = MaskPolicy([Rule(None, "j", "json"), Rule(None, "t", "hash")])
    strategies = [
        [d.strategy for d in r.details]
        for r in change_log(df, policy, keys=("id",), event_type="MySqlDataMasked").orderBy("id").collect()
    ]
    assert strategies == [["email", "json", "hash"], ["hash"], ["json", "hash"]]
    raw = change_log(df, policy, keys=("id",), previews="raw").where("id = 3").first().details
    assert raw[1].original == "x" * 50 + "..."
    assert change_log(df, NONE).first().details[0].original is None


def test_log_agrees_with_mask(spark, sf):
    from maskframe.plans.queries import POLICY, customers

    df = customers(spark, sf)
    log = change_log(df, POLICY, "customers", keys=("c_custkey",))
    d = log.select("c_custkey", F.explode("details").alias("d")).select("c_custkey", "d.*")
    masked = mask(df, POLICY, "customers")
    for c in df.columns[1:]:
        expect = df.join(masked, "c_custkey").where(df[c] != masked[c]).count()
        assert d.where(F.col("column_name") == c).count() == expect


def test_coerced_log(spark):
    df = spark.sql("SELECT 1 AS id, DATE'1990-01-15' AS d, 1234567890123456 AS n, true AS b")
    log = change_log(df, NONE, keys=("id",), coerce=True)
    r = log.first()
    assert r.id == 1 and log.schema["id"].dataType == df.schema["id"].dataType
    assert [(x.column_name, x.strategy) for x in r.details] == [("d", "dob"), ("n", "credit_card")]


def test_masked_sql_and_observation(spark):
    spark.createDataFrame([("a@b.com", 1), ("a@b.com", 2)], "e string, n int").createOrReplaceTempView("t_e")
    r = mask_sql(spark, "SELECT e, sum(n) AS n FROM t_e WHERE e = 'a@b.com' GROUP BY e", NONE).collect()
    assert len(r) == 1 and r[0].n == 3 and r[0].e.endswith("@example.com")
    seen = Observation("seen")
    observed(spark.table("t_e"), MaskPolicy([Rule(None, "e", "ip")]), seen).collect()
    assert seen.get == {"rows": 2, "masked_e": 2}


def test_sql_functions(spark):
    register_functions(spark)
    r = spark.sql(
        "SELECT pii_type('a@b.com') a, pii_type('x') b, mask_value('v', 'ip') c, "
        "mask_value(CAST(NULL AS STRING), 'ip') d, mask_sample('abcdefgh') e, "
        "mask_json('{\"a\":\"10.0.0.1\"}') f, mask_text('AB1234567') g"
    ).first()
    assert tuple(r) == ("Email", None, "0.0.0.0", None, "ab***gh", '{"a":"0.0.0.0"}', "XXXXXXXX")


def test_partial_forms(spark):
    cases = [
        (lambda c: partial(c, "email"), "john.doe@mail.company.com", "j******e@****.*******.com"),
        (lambda c: partial(c, "email"), "jo@x.org", "**@*.org"),
        (lambda c: partial(c, "email"), "a@b@c", "***@***.***"),
        (lambda c: partial(c, "phone"), "+1 (555) 123-4567", "***-***-4567"),
        (lambda c: partial(c, "phone"), "123", "***-****"),
        (lambda c: partial(c, "credit_card"), "4532-1234-5678-9012", "****-****-****-9012"),
        (lambda c: partial(c, "address"), "123 Main St, New York, NY", "*** St, New York, NY"),
        (lambda c: partial(c, "address"), "Main", "*** Main"),
        (lambda c: partial(c, "json"), '{"ssn": "1", "n": 2, "o": {"a":"b"}}', '{"ssn":"***","n":2,"o":{"a":"b"}}'),
        (lambda c: partial(c, "json"), "{}", "{}"),
        (lambda c: partial(c, "json"), "nope", '{"***": "***"}'),
        (lambda c: partial(c, "other"), "x", "***"),
        (lambda c: quick(c, "email"), "john.doe@company.co.uk", "j***@*******.co.uk"),
        (lambda c: quick(c, "phone"), "12", "***-***-12"),
        (lambda c: quick(c, "credit_card"), "none", "****-****-****-****"),
        (lambda c: quick(c, "address"), "x", "*** Masked Address ***"),
        (lambda c: preview(c), "y" * 51, "y" * 50 + "..."),
    ]
    for fn, value, want in cases:
        assert one(spark, value, fn) == want
    assert one(spark, None, lambda c: partial(c, "json")) is None


def test_units(spark):
    df = spark.sql("SELECT * FROM VALUES (0), (500), (1536), (1048576), (1099511627776) AS t(b)")
    got = [r[0] for r in df.select(human_bytes(F.col("b"))).collect()]
    assert got == ["0 B", "500 B", "1.5 KB", "1 MB", "1 TB"]
    df = spark.sql("SELECT * FROM VALUES (250), (1250), (59999), (90000) AS t(m)")
    assert [r[0] for r in df.select(human_ms(F.col("m"))).collect()] == ["250ms", "1.3s", "60.0s", "1.5m"]


def test_leaf_scan(spark):
    df = spark.createDataFrame(
        [('{"a":["a@b.com",{"b":"10.0.0.1"}]}',), ("{a@b.com,x}",), ("AB1234567",), (None,)], "v string"
    )
    got = {r.pii_type: r.n_leaves for r in leaf_scan(df, "v").collect()}
    assert got == {"Email": 2, "IpAddress": 1, "Passport": 1}


def test_odd_and_repeated_names(spark):
    df = spark.createDataFrame([("a@b.com", "10.0.0.1", 7)], "`a.b` string, `we``ird` string, `it's` int")
    policy = MaskPolicy([Rule(None, "it's", "ssn")])
    r = mask(df, policy).first()
    assert r["a.b"].endswith("@example.com") and r["we`ird"] == "0.0.0.0" and r["it's"].startswith("XXX")
    log = change_log(df, policy, keys=("a.b",)).first()
    assert log["a.b"] == "a@b.com" and [d.column_name for d in log.details] == df.columns
    twice = df.select(F.col("`a.b`").alias("x"), F.col("`we``ird`").alias("x"), F.lit("k").alias("X"))
    out = mask(twice, MaskPolicy([Rule(None, "X", "hash")]))
    assert out.columns == ["x", "x", "X"] and tuple(out.first())[1] == "0.0.0.0"
    assert tuple(out.first())[2].startswith("sha256:")
    assert [d.column_idx for d in change_log(twice, MaskPolicy()).first().details] == [0, 1]
