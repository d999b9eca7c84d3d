from __future__ import annotations

import json

import pytest

from maskframe import (
    MaskPolicy,
    Rule,
    export_rules,
    import_rules,
    load_policy,
    reload,
    resolve_rules,
    resolved_rules_df,
    rules_df,
    rules_summary,
    save_policy,
    suggest_rules,
    uncovered,
)
from maskframe.operators.rules import append_rules, delete_rules

TEXT = """
masking_enabled: true
rules:
- table: users
  column: email
  strategy: email
- table: null
  column: address
  strategy: address
- column: test
  strategy: email
health_check:
  unhealthy_threshold: 5
audit:
  events: [rule_added]
"""


@pytest.fixture
def path(tmp_path):
    p = tmp_path / "policy.yaml"
    p.write_text(TEXT)
    return str(p)


def test_load_save_round_trip(spark, path, tmp_path):
    p = load_policy(path)
    assert p.rules[0] == Rule("users", "email", "email") and p.rules[2].table is None
    assert p.masking_enabled and p.health.unhealthy_threshold == 5 and p.health.healthy_threshold == 1
    assert p.audit.events == ("rule_added",) and p.limits.idle_timeout_secs == 300
    assert load_policy(path, spark) == p
    out = str(tmp_path / "out.yaml")
    save_policy(p, out)
    assert load_policy(out) == p


@pytest.mark.parametrize(
    "text",
    ["masking_enabled: true", "rules: 5", "rules:\n- column: a", "[1,", "rules: []\nmasking_enabled: 3", "7",
     "rules:\n- {table: 1, column: a, strategy: b}", "rules: [x]"],
)
def test_wrong_documents(tmp_path, path, text):
    p = tmp_path / "bad.yaml"
    p.write_text(text)
    with pytest.raises(ValueError):
        load_policy(str(p))
    old = load_policy(path)
    assert reload(old, str(p)) is old and reload(MaskPolicy(), path) == old
    assert reload(old, str(tmp_path / "absent")) is old


def test_minimal_document(tmp_path):
    p = tmp_path / "min.yaml"
    p.write_text("rules: []")
    assert load_policy(str(p)) == MaskPolicy()


def test_export_import(spark, tmp_path, path):
    p = load_policy(path)
    out = str(tmp_path / "rules.json")
    assert json.loads(export_rules(p, out))[1] == {"table": None, "column": "address", "strategy": "address"}
    assert import_rules(p, out).rules == p.rules * 2
    assert import_rules(p, out, spark).rules == p.rules * 2


def test_add_delete(path):
    p = load_policy(path).add(Rule("orders", "email", "hash"))
    assert p.rules[-1].strategy == "hash"
    assert [r.column for r in p.delete(index=0).rules] == ["address", "test", "email"]
    assert len(p.delete(column="email").rules) == 2
    assert p.delete(column="email", table="users").rules[-1].table == "orders"
    assert p.delete(column="email", table="nowhere") == p
    with pytest.raises(IndexError):
        p.delete(index=9)
    with pytest.raises(ValueError):
        p.delete()


def test_rules_as_data(spark, path):
    p = load_policy(path).add(Rule(None, "email", "hash"))
    rules = rules_df(spark, p)
    assert tuple(rules_summary(rules).first()) == (4, 3, 3)
    catalog = spark.createDataFrame(
        [("users", "email"), ("orders", "email"), ("users", "x"), ("t", "address")], "table string, column string"
    )
    got = {(r.table, r.column): (r.rule_idx, r.strategy) for r in resolved_rules_df(catalog, rules).collect()}
    assert got == {("users", "email"): (0, "email"), ("orders", "email"): (3, "hash"), ("t", "address"): (1, "address")}
    schema = spark.createDataFrame([("a", "b")], "email string, address string").schema
    assert resolve_rules(schema, p, "users") == {"email": "email", "address": "address"}
    assert append_rules(rules, rules).count() == 8
    assert sorted(r.rule_idx for r in append_rules(rules, rules).collect()) == list(range(8))
    assert delete_rules(rules, index=0).count() == 3
    assert delete_rules(rules, column="email").count() == 2
    assert delete_rules(rules, column="email", table="users").count() == 3


def test_suggest_and_uncovered(spark):
    found = spark.createDataFrame(
        [("t", "a", "Email"), ("t", "b", "Phone"), ("t", "c", "CreditCard"), ("u", "d", "Ssn")],
        "table string, column string, pii_type string",
    )
    assert {r.column: r.strategy for r in suggest_rules(found).collect()} == {
        "a": "email", "b": "phone", "c": "credit_card", "d": "hash",
    }
    rules = rules_df(spark, MaskPolicy([Rule("t", "a", "x"), Rule(None, "d", "x"), Rule("u", "b", "x")]))
    assert sorted(r.column for r in uncovered(found, rules).collect()) == ["b", "c"]
