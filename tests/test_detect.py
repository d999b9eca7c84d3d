from __future__ import annotations

import json
import random
import time

import regex

from maskframe.functions import patterns as P
from maskframe.functions.detect import (
    contains_pii,
    is_json,
    is_scannable,
    looks_like_pg_array,
    name_pii_type,
    pii_type,
    scannable,
)
from maskframe.functions.partial import mask_sample
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTORS = {
    "Email": ["test@example.com", "john.doe@company.org", "user+tag@domain.co.uk", "USER@EXAMPLE.COM"],
    "CreditCard": ["1234-5678-9012-3456", "1234 5678 9012 3456", "1234567890123456"],
    "Ssn": ["123-45-6789", "000-00-0000"],
    "Phone": ["+1-555-123-4567", "555-123-4567", "(555) 123-4567", "555.123.4567", "5551234567"],
    "IpAddress": ["192.168.1.1", "10.0.0.1", "255.255.255.255", "0.0.0.0"],
    "DateOfBirth": ["1990-01-15", "01/15/1990", "15-01-1990", "2000/12/31"],
    "Passport": ["AB1234567", "C12345678"],
    None: [
        "not-an-email", "missing@domain", "@nodomain.com", "spaces in@email.com",
        "1234-5678-9012", "not a credit card", "12345678901234567890", "123456789",
        "123-456-789", "12-345-6789", "phone", "12", "12345", "256.1.1.1", "192.168.1",
        "192.168.1.1.1", "1990", "Jan 15, 1990", "abc123456", "12345678", "John Doe",
        "123 Main Street", "Hello, World!", "", "a@b.com\n", "123-45-6789\n",
        "+44 20 7946 0958", None,
    ],
}


def classify(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", pii_type("v").alias("n"), pii_type(F.col("v")).alias("c")).orderBy("i")
    out = rows.collect()
    assert all(r.n == r.c for r in out)
    return [r.n for r in out]


def test_vectors(spark):
    values = [(v, t) for t, vs in VECTORS.items() for v in vs]
    assert classify(spark, [v for v, _ in values]) == [t for _, t in values]


def for_python(pattern):
    text = regex.sub(r"\\x\{([0-9a-f]+)\}", lambda m: rf"\u{int(m[1], 16):04x}", pattern)
    return regex.compile(text.replace(r"\z", r"\Z"))


EACH = {t: for_python(P.PATTERNS[t]) for t in P.PII_TYPES}


def by_patterns(v):
    return next((t for t in P.PII_TYPES if EACH[t].search(v)), None)


def test_joint_pattern_agrees_with_each_pattern_in_turn(spark):
    """Fuzz: values near the edges of the shapes, ASCII and not."""
    rng = random.Random(7)
    digits = ["0123456789", "0123456789٠١٢٣"]
    seps = ["", "-", "/", ".", " ", "\t", " ", "(", ")", "+"]
    values = []
    for _ in range(6000):
        pool = rng.choice(digits)
        parts = []
        if rng.random() < 0.3:
            parts.append(rng.choice(["+", "(", "A", "AB", "ABC", "a"]))
        for _ in range(rng.randint(1, 5)):
            parts.append("".join(rng.choice(pool) for _ in range(rng.choice([1, 2, 3, 4, 6, 7, 8]))))
            parts.append(rng.choice(seps))
        values.append("".join(parts))
    for _ in range(2000):
        d = lambda n: "".join(rng.choice(rng.choice(digits)) for _ in range(n))
        s = lambda: rng.choice(["", "-", ".", " ", " "])
        values.append(
            rng.choice(
                [
                    f"{d(4)}{s()}{d(4)}{s()}{d(4)}{s()}{d(4)}",
                    f"{d(3)}-{d(2)}-{d(4)}",
                    f"{rng.choice(['', '+1-', '+123.'])}{rng.choice(['', '('])}{d(3)}"
                    f"{rng.choice(['', ')'])}{s()}{d(3)}{s()}{d(4)}",
                    f"{d(4)}{rng.choice('-/')}{d(2)}{rng.choice('-/')}{d(2)}",
                    f"{d(2)}{rng.choice('-/')}{d(2)}{rng.choice('-/')}{d(4)}",
                    ".".join(str(rng.randint(0, 270)) for _ in range(4)),
                    f"X{d(7)}",
                    f"kK{d(2)}@x.cſ",
                ]
            )
        )
    got = classify(spark, values)
    want = [by_patterns(v) for v in values]
    assert [(v, g, w) for v, g, w in zip(values, got, want) if g != w] == []
    assert {w for w in want if w} == set(P.PII_TYPES)


def test_short_types_fit_the_byte_bounds():
    longest = "٠" * 4 + " " + "٠" * 4 + " " + "٠" * 4 + " " + "٠" * 4
    assert len(longest.encode()) <= P.SHORT_MAX_BYTES
    assert 16 * 4 + 3 * 3 <= P.SHORT_MAX_BYTES


NAMES = {
    "email": "Email", "user_email": "Email", "mail": "Email", "phone_number": "Phone",
    "mobile": "Phone", "hotel": "Phone", "cancelled": "Phone", "fax": "Phone", "ssn": "Ssn",
    "national_id": "Ssn", "credit_card_number": "CreditCard", "cc_num": "CreditCard",
    "ip_address": "IpAddress", "ip": "IpAddress", "dob": "DateOfBirth", "BirthDay": "DateOfBirth",
    "passport_number": "Passport", "username": None, "created_at": None, "shipping": None,
}


def test_names(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    got = {r.n: r.t for r in df.select("n", name_pii_type("n").alias("t")).collect()}
    assert got == NAMES


def test_scannable(spark):
    yes = ["text", "VARCHAR", "character varying", "bpchar", "name", "citext", "string"]
    no = ["integer", "timestamp", "json", "bytea"]
    assert all(is_scannable(t) for t in yes) and not any(is_scannable(t) for t in no)
    assert is_scannable(T.StringType()) and not is_scannable(T.LongType())
    df = spark.createDataFrame([("varchar(20)",), ("int",)], "t string")
    assert [r[0] for r in df.select(scannable("t")).collect()] == [True, False]


def test_mask_sample(spark):
    cases = {
        "abc": "***", "abcd": "****", "abcdefgh": "ab***gh", "test@example.com": "tes***com",
        "123-45-6789": "123***789", "äöüßäöüß€": "äöü***üß€", "": "",
    }
    df = spark.createDataFrame(list(cases.items()), "v string, w string")
    assert all(r[0] == r[1] for r in df.select(mask_sample("v"), "w").collect())


def test_is_json_is_the_whole_value(spark):
    values = [
        '{"a":1}', ' {"a": [1, {"b": null}]} \n', "[]", "[1,2]", '"x"', "12", '{"a":1,"a":2}',
        '{"a":1} x', '{"a":1},{"b":2}', '{"a":1}],[{"b":2}', "[1],[2]", '{"a":1},"w":{"b":2}',
        "{a,b}", '{"a"}', "[1,2", "", '{"a":1}}', "[1]]", "}{", '1},{"v":1', "1],[1", "nan",
        '{"a":01}', "{'a':1}", '{"a":"it\'s"}', '{"a\'":1, "b":\'x\'}', '{"a":"\\"\'"}',
    ]

    def valid(v):
        try:
            json.loads(v, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
            return True
        except ValueError:
            return False

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(is_json("v")).collect()]
    assert got == [valid(v) for v in values]


def test_pg_array_and_row_filter(spark):
    df = spark.createDataFrame([("{a,b}", 1), ('{"a":1}', 2), ("a@b.com", 3)], "v string, i int")
    shapes = [bool(r[0]) for r in df.orderBy("i").select(looks_like_pg_array("v")).collect()]
    assert shapes == [True, False, False]
    assert [r.i for r in df.where(contains_pii(df)).collect()] == [3]
    assert df.select("i").where(contains_pii(df.select("i"))).count() == 0


def test_container_hints_find_what_bodies_between_signs_are(spark):
    """The hints against patterns that try every body at every sign, over odd text; and deep text costs little more than its length."""
    rnd = random.Random(5)
    pieces = ["a@b.co", "123-45-6789", "10.0.0.1", "AB1234567", "+1-555-123-4567", "(555) 123-4567", '"', '"', "[", "]", "{", "}", ",", ":", " ", "\u3000", "\\", "x", "\t", "é"]
    rows = [("".join(rnd.choices(pieces, k=rnd.randint(0, 9))),) for _ in range(20_000)]
    ws, body = P.WS_CLASS, P._ANY_BODY
    hint = rf'\\|[\[{{,"][{ws}]*+{body}[{ws}]*+[\]}},"]'
    hit = rf'(?<!\\)"({body})"(?!{P._JSON_WS}:)'
    df = spark.createDataFrame(rows, "v string").select(
        F.col("v").rlike(P.ARRAY_HINT).alias("hint"), F.col("v").rlike(hint).alias("hint_was"),
        F.regexp_replace("v", P.JSON_HIT, "#$1#").alias("hit"), F.regexp_replace("v", hit, "#$1#").alias("hit_was"), "v",
    )
    got = df.collect()
    assert all(r.hint == r.hint_was and r.hit == r.hit_was for r in got)
    assert 1_000 < sum(r.hint for r in got) < 19_000 and sum(r.hit != r.v for r in got) > 100

    deep = spark.range(2_000, numPartitions=1).select(F.expr("concat(repeat('[', 1200), id, repeat(']', 1200))").alias("v"))

    def seconds(pattern):
        times = []
        for _ in range(3):
            began = time.perf_counter()
            assert deep.where(F.col("v").rlike(pattern)).count() == 0
            times.append(time.perf_counter() - began)
        return min(times)

    assert seconds(P.ARRAY_HINT) < seconds(hint) / 1.5
