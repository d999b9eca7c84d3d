"""Derived tables that hold personal data, as SQL text.

The driver tables hold little personal data, so the queries use views computed
from them.  The texts run unchanged in Spark SQL and in DuckDB, which is how
results are checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _pad(expr: str, n: int) -> str:
    return f"lpad(CAST({expr} AS VARCHAR(20)), {n}, '0')"


PII_CUSTOMERS = f"""
SELECT c_custkey,
  CASE WHEN c_custkey % 10 <> 0
    THEN concat('user', c_custkey, '@example.com') END AS email,
  concat('555-', {_pad('c_custkey % 1000', 3)}, '-', {_pad('c_custkey % 10000', 4)}) AS phone,
  concat({_pad('c_custkey % 900', 3)}, '-', {_pad('c_custkey % 100', 2)}, '-',
    {_pad('c_custkey % 10000', 4)}) AS ssn,
  concat('4532-', {_pad('c_custkey % 10000', 4)}, '-5678-',
    {_pad('(c_custkey * 7) % 10000', 4)}) AS credit_card,
  concat('10.', c_custkey % 256, '.', (c_custkey * 7) % 256, '.1') AS client_ip,
  concat('AB', {_pad('c_custkey % 10000000', 7)}) AS passport_no,
  concat('{{"user": {{"email": "user', c_custkey, '@example.com", "name": "N', c_custkey,
    '"}}, "n": ', c_custkey, '}}') AS profile,
  concat('{{"user', c_custkey, '@example.com",tag,"4532-1234-5678-',
    {_pad('c_custkey % 10000', 4)}, '"}}') AS tags,
  concat(c_custkey, ' Main St, Town ', c_nationkey, ', XY') AS address,
  c_mktsegment AS notes
FROM customer
"""

# Orders with the buyer's e-mail and a date of birth in text form.
PII_ORDERS = """
SELECT o_orderkey, o_custkey,
  CASE WHEN o_custkey % 10 <> 0
    THEN concat('user', o_custkey, '@example.com') END AS buyer_email,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS born,
  o_orderstatus AS status, o_totalprice
FROM orders
"""

# Audit rows: one per event.
AUDIT_ROWS = """
SELECT lpad(CAST(event_id AS VARCHAR(20)), 12, '0') AS id, ts AS "timestamp",
  CASE event_type WHEN 'signup' THEN 'rule_added' WHEN 'error' THEN 'auth_attempt'
    WHEN 'click' THEN 'api_access' WHEN 'view' THEN 'schema_query'
    ELSE 'database_scan' END AS event_type,
  CASE WHEN event_type <> 'error' THEN 'success'
    WHEN user_id % 3 = 0 THEN 'denied' ELSE 'failure' END AS outcome,
  CASE WHEN event_type = 'error' THEN 'api_key' END AS auth_method,
  concat('u', user_id) AS user_id
FROM events
"""

# A statement log: one per event.
STATEMENTS = """
SELECT event_id, ts, user_id AS connection_id,
  CASE event_type WHEN 'click' THEN concat('select * from t', user_id)
    WHEN 'purchase' THEN concat('  INSERT INTO t', user_id, ' VALUES (1)')
    WHEN 'signup' THEN concat('Update t', user_id, ' SET a = 1')
    WHEN 'error' THEN concat('DELETE FROM t', user_id)
    ELSE CASE WHEN event_id % 5 = 0 THEN '' ELSE 'WITH x AS (SELECT 1) SELECT 1' END
  END AS statement
FROM events
"""

# Probes: an error is a failed probe of the user's server.
PROBES = """
SELECT event_id, ts, user_id, event_type <> 'error' AS ok, value AS latency_ms FROM events
"""

# A catalog of columns and a rule list whose sizes follow the data.
CATALOG = """
SELECT concat('t_', p_partkey) AS "table", concat(
    CASE p_partkey % 12 WHEN 0 THEN 'user_email' WHEN 1 THEN 'phone_number'
      WHEN 2 THEN 'ssn' WHEN 3 THEN 'credit_card_number' WHEN 4 THEN 'ip_address'
      WHEN 5 THEN 'birth_day' WHEN 6 THEN 'passport_number' WHEN 7 THEN 'username'
      WHEN 8 THEN 'created_at' WHEN 9 THEN 'HOTEL_NAME' WHEN 10 THEN 'cancelled'
      ELSE 'mail' END,
    CASE WHEN p_partkey % 12 <> 11 AND p_size % 2 = 0
      THEN concat('_', p_size) ELSE '' END) AS "column"
FROM part
"""
RULES = """
SELECT o_orderkey AS rule_idx,
  CASE WHEN o_orderkey % 4 <> 0 OR o_orderkey < 100
    THEN concat('t_', (o_custkey * 7) % 3000) END AS "table",
  CASE o_custkey % 5 WHEN 0 THEN 'user_email' WHEN 1 THEN 'phone_number' WHEN 2 THEN 'mail'
    WHEN 3 THEN 'cancelled' ELSE concat('ssn_', o_custkey % 50) END AS "column",
  CASE o_orderkey % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'hash' ELSE 'phone' END AS strategy
FROM orders
"""

HOSTILE = """
SELECT c_custkey, concat('user', c_custkey, '@example.com') AS secret,
  CASE c_custkey % 6
    WHEN 0 THEN concat('{"a":"x', chr(1), 'y","e":"user', c_custkey, '@example.com"}')
    WHEN 1 THEN concat('{"e":"user', c_custkey, '@example.com"} and more}')
    WHEN 2 THEN concat('[["user', c_custkey, '@example.com"]')
    WHEN 3 THEN concat(repeat('[', 1200), '"user', c_custkey, '@example.com"', repeat(']', 1200))
    WHEN 4 THEN concat('{"e":"x","e":"user', c_custkey, '@example.com"}')
    ELSE concat('{"a', chr(9), 'b":"user', c_custkey, '@example.com"}')
  END AS cell
FROM customer
"""

# Orders as JSON documents: lists of objects and of values, odd names, empty containers, text that is no JSON.
JSON_ORDERS = """
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '{not json' ELSE concat(
    '{"buyer": {"mail": "user', o_custkey, '@example.com", "tries": [', o_orderkey % 7, ', null, true]}, ',
    '"items": [{"ip": "10.0.', o_custkey % 200, '.1", "no tes": "none"}, {"ip": "unknown"}], ',
    '"seen": ["AB', lpad(CAST(o_custkey % 10000000 AS VARCHAR(20)), 7, '0'), '", "x"], "empty": [], "none": {}}') END AS doc
FROM orders
"""

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in DRIVER_TABLES}


def derived(
    spark: SparkSession, sf_dir: str, text: str, source: str, spread: bool = False
) -> DataFrame:
    """One of the texts above over the table it reads.

    With ``spread`` the table's rows are dealt over all tasks first, in turn: millions
    of short rows can be one split of a file, however long the cells made of them are.
    """
    rows = table(spark, sf_dir, source)
    if spread:
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    body = text.replace('"table"', "`table`").replace('"column"', "`column`")
    body = body.replace('"timestamp"', "`timestamp`").replace("{", "{{").replace("}", "}}")
    return spark.sql(
        body.replace(f"FROM {source}", "FROM {src}"), src=rows
    )
