"""The same results as plain SQL for DuckDB, over the driver's tables.

These texts state what a query means without the library: patterns are tried
one after the other, nested values are built from their parts, and running
totals are windows over everything.
"""

from __future__ import annotations

from maskframe.functions import patterns as P
from maskframe.functions.strategies import CITIES
from maskframe.plans import fixtures as X

_FLAT = ("email", "phone", "ssn", "credit_card", "client_ip", "passport_no", "address", "notes")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pii(v: str) -> str:
    tests = " ".join(
        f"WHEN regexp_matches({v}, {_q(P.PATTERNS[t])}) THEN '{t}'" for t in P.PII_TYPES
    )
    return f"(CASE {tests} END)"


def _tokens(table: str, text: str) -> str:
    return (
        f"SELECT pii_type, count(*) AS n_tokens FROM (SELECT {pii('v')} AS pii_type FROM "
        f"(SELECT unnest(regexp_split_to_array({text}, '[{P.WS_CLASS}]+')) AS v FROM {table})) "
        "WHERE pii_type IS NOT NULL GROUP BY 1"
    )


def _hex(v: str, n: int) -> str:
    return f"substr(md5({v}), 1, {n})"


def _dec(v: str, n: int) -> str:
    return f"translate({_hex(v, n)}, 'abcdef', '012345')"


def _seed(v: str) -> str:
    return f"('0x' || {_hex(v, 15)})::BIGINT"


def fake(strategy: str, v: str, value: str | None = None) -> str:
    """``value`` is what is hashed, if it is more than ``v``."""
    h = value or v
    card = f"('4' || {_dec(h, 15)})"
    cities = ", ".join(_q(c) for c in CITIES)
    text = {
        "email": f"'user.' || {_hex(h, 15)} || '@example.com'",
        "phone": f"'555-' || substr({_dec(h, 7)}, 1, 3) || '-' || substr({_dec(h, 7)}, 4, 4)",
        "address": f"([{cities}])[{_seed(h)} % {len(CITIES)} + 1]",
        "credit_card": " || '-' || ".join(f"substr({card}, {i}, 4)" for i in (1, 5, 9, 13)),
        "ssn": f"'XXX-XX-' || lpad(({_seed(h)} % 10000)::VARCHAR, 4, '0')",
        "ip": "'0.0.0.0'",
        "dob": "'1900-01-01'",
        "passport": "'XXXXXXXX'",
        "hash": f"'sha256:' || sha256({h})",
    }.get(strategy, "'MASKED'")
    return f"(CASE WHEN {v} IS NOT NULL THEN {text} END)"


def masked(v: str, value: str | None = None) -> str:
    branches = " ".join(
        f"WHEN '{t}' THEN {fake(s, v, value)}" for t, s in P.TYPE_STRATEGY.items()
    )
    return f"(CASE {pii(v)} {branches} ELSE {v} END)"


def sample(v: str) -> str:
    return (
        f"(CASE WHEN length({v}) <= 4 THEN repeat('*', length({v})) WHEN length({v}) <= 8 "
        f"THEN left({v}, 2) || '***' || right({v}, 2) "
        f"WHEN {v} IS NOT NULL THEN left({v}, 3) || '***' || right({v}, 3) END)"
    )


_C = f"WITH c AS ({X.PII_CUSTOMERS}) "
_O = f"WITH o AS ({X.PII_ORDERS}) "
_CO = f"WITH c AS ({X.PII_CUSTOMERS}), o AS ({X.PII_ORDERS}) "

_MAIL = "('user' || c_custkey || '@example.com')"
_PROFILE = (
    f"'{{\"user\": {{\"email\": \"' || {fake('email', _MAIL)} || '\", \"name\": \"N' || c_custkey "
    "|| '\"}, \"n\": ' || c_custkey || '}'"
)
_TAG_CARD = "('4532-1234-5678-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0'))"
_TAGS = (
    f"'{{\"' || {fake('email', _MAIL)} || '\",tag,\"' || {fake('credit_card', _TAG_CARD)} || '\"}}'"
)

# Strategy per customer column under the flagship policy.
_BY_POLICY = {
    "email": "email", "phone": "phone", "ssn": "ssn", "credit_card": "credit_card",
    "client_ip": "hash", "passport_no": "passport", "profile": "json", "tags": "json",
    "address": "address", "notes": "no_such_strategy",
}
_COLUMNS = (
    "c_custkey", "email", "phone", "ssn", "credit_card", "client_ip",
    "passport_no", "profile", "tags", "address", "notes",
)


def _policy_cell(c: str) -> str:
    return _PROFILE if c == "profile" else fake(_BY_POLICY[c], c)


def _policy_log() -> str:
    """``(c_custkey, column_idx, column_name, strategy, original, masked)``."""
    parts = []
    for i, c in enumerate(_COLUMNS):
        if c == "c_custkey":
            continue
        cell = "'(JSON Masked)'" if c == "profile" else _policy_cell(c)
        parts.append(
            f"SELECT c_custkey, {i}::BIGINT AS column_idx, '{c}' AS column_name, "
            f"'{_BY_POLICY[c]}' AS strategy, {sample(c)} AS original, {cell} AS masked "
            f"FROM c WHERE {c} IS NOT NULL"
        )
    return " UNION ALL ".join(parts)


_KNOWN = (
    "email", "phone", "address", "credit_card", "ssn", "ip", "dob", "passport", "hash", "json",
)
_BUCKET = (
    "CASE WHEN strategy IN (" + ", ".join(_q(k) for k in _KNOWN) + ") THEN strategy ELSE 'other' END"
)
_COUNTS = f"SELECT {_BUCKET} AS strategy, count(*) AS n FROM ({_policy_log()}) GROUP BY 1"

# ---- discovery ---------------------------------------------------------------

_TEXT_COLUMNS = {
    "region": ("r_name",),
    "nation": ("n_name",),
    "customer": ("c_name", "c_mktsegment"),
    "supplier": ("s_name",),
    "part": ("p_name", "p_brand", "p_type"),
    "orders": ("o_orderstatus", "o_orderpriority"),
    "lineitem": ("l_returnflag", "l_linestatus"),
    "events": ("event_type", "props"),
    "documents": ("text", "lang", "source"),
    "pages": ("url", "html"),
    "benchmark": ("text",),
    "conversations": ("role", "text"),
    "pii_customers": _COLUMNS[1:],
    "pii_orders": ("buyer_email", "born", "status"),
}
_ALL_COLUMNS = {
    "benchmark": "item_id,text",
    "conversations": "conv_id,turn,role,text",
    "customer": "c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment",
    "documents": "doc_id,text,lang,source,n_chars",
    "embeddings": "vec_id,embedding,label",
    "events": "event_id,ts,user_id,event_type,value,props",
    "labels": "doc_id,quality,toxic",
    "lineitem": (
        "l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,"
        "l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate"
    ),
    "nation": "n_nationkey,n_name,n_regionkey",
    "orders": "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority",
    "pages": "page_id,url,html",
    "part": "p_partkey,p_name,p_brand,p_type,p_size,p_retailprice",
    "pii_customers": ",".join(_COLUMNS),
    "pii_orders": "o_orderkey,o_custkey,buyer_email,born,status,o_totalprice",
    "region": "r_regionkey,r_name",
    "supplier": "s_suppkey,s_name,s_nationkey,s_acctbal",
}
_N = {t: f"n_{s}" for t, s in P.TYPE_STRATEGY.items()}
_VIEWS = (
    f"WITH pii_customers AS ({X.PII_CUSTOMERS}), pii_orders AS ({X.PII_ORDERS}), "
)


def _column_profile(table: str, column: str, order: str | None = None) -> str:
    counts = ", ".join(f"count(*) FILTER (t = '{t}') AS {n}" for t, n in _N.items())
    first = f"arg_min(v, {order}) FILTER (t IS NOT NULL)" if order else (
        "min(v) FILTER (t IS NOT NULL)"
    )
    key = f"{order}, " if order else ""
    return (
        f"SELECT '{table}' AS \"table\", '{column}' AS \"column\", 'string' AS data_type, "
        f"count(*) AS row_count, count(t) AS match_count, {counts}, {first} AS v0 "
        f"FROM (SELECT {key}v, {pii('w')} AS t FROM (SELECT {key}{column} AS v, "
        f"trim({column}, {_q(P.WS_CHARS)}) AS w FROM {table}))"
    )


def _profile(columns: dict[str, tuple[str, ...]], order: str | None = None) -> str:
    union = " UNION ALL ".join(
        _column_profile(t, c, order) for t, names in columns.items() for c in names
    )
    top = f"greatest({', '.join(_N.values())})"
    best = " ".join(f"WHEN {n} = {top} THEN '{t}'" for t, n in _N.items())
    return (
        f"SELECT * EXCLUDE (v0), CASE WHEN match_count > 0 THEN CASE {best} END END "
        f"AS detected_type, {sample('v0')} AS sample FROM ({union})"
    )


def _by_name(v: str) -> str:
    low = f"lower({v})"
    tests = []
    for t, parts, wholes in P.NAME_HINTS:
        test = [f"contains({low}, '{p}')" for p in parts] + [f"{low} = '{w}'" for w in wholes]
        tests.append(f"WHEN {' OR '.join(test)} THEN '{t}'")
    return f"(CASE {' '.join(tests)} END)"


def _findings(profile: str, threshold: float) -> str:
    return f"""
SELECT "table", "column", k AS pii_type, round(conf * 100) / 100 AS confidence, sample,
  row_count, match_count, data_type
FROM (SELECT *,
    CASE WHEN nt IS NULL THEN c WHEN detected_type = nt THEN least(c + 0.3::DOUBLE, 1::DOUBLE)
      WHEN detected_type IS NOT NULL THEN c * 0.8::DOUBLE
      WHEN c < {threshold}::DOUBLE THEN 0.6::DOUBLE ELSE c END AS conf,
    coalesce(detected_type, CASE WHEN c < {threshold}::DOUBLE THEN nt END) AS k
  FROM (SELECT *, {_by_name('"column"')} AS nt,
      CASE WHEN row_count > 0 THEN match_count / row_count ELSE 0::DOUBLE END AS c
    FROM ({profile})))
WHERE k IS NOT NULL AND conf >= {threshold}::DOUBLE"""


_SCANNED = {t: c for t, c in _TEXT_COLUMNS.items() if t not in ("nation", "pages")}
_FOUND = _findings(_profile(_SCANNED), 0.5)
_CONTACTS = """contacts AS (SELECT notes AS email, ssn AS mobile,
  CASE WHEN c_custkey % 4 = 0 THEN phone END AS tel,
  CASE WHEN c_custkey % 5 = 0 THEN client_ip END AS note FROM pii_customers)"""

# ---- time --------------------------------------------------------------------


def _sessions(gap: int) -> str:
    return f"""
SELECT user_id, min(ts) AS start, max(ts) AS last_seen,
  max(ts) + INTERVAL {gap} SECOND AS "end", count(*) AS n_events
FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
  FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
      + INTERVAL {gap} SECOND THEN 0 ELSE 1 END AS fresh FROM events))
GROUP BY user_id, s"""


_CHANGES = f"""
SELECT ts, 0 AS a, 1 AS q, 0 AS m, 0 AS t FROM events
UNION ALL SELECT ts, 0, 0, CASE WHEN event_type = 'purchase' THEN 2 ELSE 0 END, 0 FROM events
UNION ALL SELECT start, 1, 0, 0, 1 FROM ({_sessions(300)})
UNION ALL SELECT "end", -1, 0, 0, 0 FROM ({_sessions(300)})"""


def _history(every: str, changes: str = _CHANGES) -> str:
    return f"""
SELECT g.step + INTERVAL '{every}' AS ts,
  CAST(sum(coalesce(s.a, 0)) OVER w AS BIGINT) AS active_connections,
  CAST(sum(coalesce(s.q, 0)) OVER w AS BIGINT) AS total_queries,
  CAST(sum(coalesce(s.m, 0)) OVER w AS BIGINT) AS total_masked,
  CAST(sum(coalesce(s.t, 0)) OVER w AS BIGINT) AS total_connections
FROM (SELECT unnest(generate_series(time_bucket(INTERVAL '{every}', min(ts), TIMESTAMP '1970-01-01'),
    time_bucket(INTERVAL '{every}', max(ts), TIMESTAMP '1970-01-01'), INTERVAL '{every}')) AS step
  FROM ({changes})) g
LEFT JOIN (SELECT time_bucket(INTERVAL '{every}', ts, TIMESTAMP '1970-01-01') AS step, sum(a) AS a, sum(q) AS q,
    sum(m) AS m, sum(t) AS t FROM ({changes}) GROUP BY 1) s ON g.step = s.step
WINDOW w AS (ORDER BY g.step)"""


def _health(bad: int, good: int) -> str:
    w = "PARTITION BY user_id ORDER BY ts, event_id"
    return f"""
SELECT event_id, ts, user_id, ok,
  coalesce(last_value(turn IGNORE NULLS) OVER ({w}), true) AS healthy,
  CAST(f AS BIGINT) AS consecutive_failures, CAST(s AS BIGINT) AS consecutive_successes, value
FROM (SELECT *, CASE WHEN f >= {bad} THEN false WHEN s >= {good} THEN true END AS turn
  FROM (SELECT *,
      CASE WHEN ok THEN 0 ELSE row_number() OVER (PARTITION BY user_id, oks, ok
        ORDER BY ts, event_id) END AS f,
      CASE WHEN ok THEN row_number() OVER (PARTITION BY user_id, bads, ok
        ORDER BY ts, event_id) ELSE 0 END AS s
    FROM (SELECT *, event_type <> 'error' AS ok,
        count(*) FILTER (event_type <> 'error') OVER ({w}) AS oks,
        count(*) FILTER (event_type = 'error') OVER ({w}) AS bads
      FROM events)))"""


_KIND = (
    "(CASE WHEN regexp_extract(statement, '^\\s*(\\S+)', 1) = '' THEN 'OTHER' "
    "ELSE upper(regexp_extract(statement, '^\\s*(\\S+)', 1)) END)"
)
_KIND_BUCKET = (
    f"(CASE WHEN {_KIND} IN ('SELECT', 'INSERT', 'UPDATE', 'DELETE') "
    f"THEN lower({_KIND}) ELSE 'other' END)"
)
_S = f"WITH s AS ({X.STATEMENTS}) "
_A = f"WITH a AS ({X.AUDIT_ROWS}) "
_NEWEST = 'ORDER BY "timestamp" DESC, id DESC LIMIT'
_R = f"WITH r AS ({X.RULES}) "


def _share(counts: str, key: str) -> str:
    return (
        f"SELECT {key}, n, round(n * 1000 / (SELECT sum(n) FROM k)) / 10 AS percent "
        f"FROM k WHERE n > 0"
    ).replace("FROM k", f"FROM ({counts}) k")


def _plain(*columns: str) -> str:
    return ", ".join(columns)


def _classified(source: str, table: str, column: str) -> str:
    return f"SELECT '{source}' AS source, {pii(column)} AS t FROM {table}"


_CLASSIFIED = " UNION ALL ".join(
    [
        _classified(f"{t}.{c}", t, c)
        for t, c in (
            ("documents", "text"), ("pages", "html"), ("pages", "url"),
            ("conversations", "text"), ("benchmark", "text"), ("events", "props"),
            ("customer", "c_name"),
        )
    ]
    + [
        _classified(f"pii_customers.{c}", "c", c)
        for c in ("email", "phone", "ssn", "credit_card", "client_ip", "passport_no", "notes")
    ]
)

_HEURISTIC_BUCKETS = (
    "email", "phone", "ssn", "credit_card", "ip", "passport",
)
_ONE = "count(*)"


def _bytes(v: str) -> str:
    units = ("B", "KB", "MB", "GB", "TB")
    out = []
    for i in reversed(range(len(units))):
        number = f"regexp_replace(round({v} / {float(1024**i)}::DOUBLE, 2)::VARCHAR, '\\.0$', '')"
        out.append(f"WHEN {v} >= {1024**i} THEN {number} || ' {units[i]}'")
    return f"(CASE {' '.join(out)} WHEN {v} = 0 THEN '0 B' END)"


def _tenths(v: str) -> str:
    t = f"CAST(floor({v} * 10 + 0.5) AS BIGINT)"
    return f"({t} // 10) || '.' || ({t} % 10)"


def _partial_email(v: str) -> str:
    return f"""CASE WHEN {v} IS NULL THEN NULL WHEN len(string_split({v}, '@')) <> 2
  THEN '***@***.***' ELSE
  (CASE WHEN length(split_part({v}, '@', 1)) > 2 THEN left({v}, 1)
    || repeat('*', length(split_part({v}, '@', 1)) - 2) || right(split_part({v}, '@', 1), 1)
    ELSE repeat('*', length(split_part({v}, '@', 1))) END) || '@'
  || regexp_replace(regexp_extract(split_part({v}, '@', 2), '^(.*)\\.[^.]*$', 1), '[^.]', '*', 'g')
  || '.' || regexp_extract(split_part({v}, '@', 2), '([^.]*)$', 1) END"""


def sql() -> dict[str, str]:
    log = f"({_policy_log()})"
    flat_masked = ", ".join(f"{masked(c)} AS {c}" for c in _FLAT)
    out = {
        "classify_customers": _C
        + "SELECT c_custkey, "
        + ", ".join(f"{pii(c)} AS {c}" for c in _COLUMNS[1:])
        + " FROM c",
        "classify_counts": _C
        + f"SELECT source, coalesce(t, 'none') AS pii_type, count(*) AS n FROM ({_CLASSIFIED}) "
        "GROUP BY 1, 2",
        "date_columns_as_dob": (
            f"SELECT {pii('v')} AS pii_type, count(*) AS n FROM "
            "(SELECT o_orderdate::DATE::VARCHAR AS v FROM orders) GROUP BY 1"
        ),
        "name_heuristics": (
            "SELECT coalesce(t, 'none') AS pii_type, coalesce(CASE t "
            + " ".join(f"WHEN '{t}' THEN '{s}'" for t, s in P.TYPE_STRATEGY.items())
            + " END, 'none') AS strategy, count(*) AS n FROM "
            + f"(SELECT {_by_name('\"column\"')} AS t FROM ({X.CATALOG})) GROUP BY 1, 2"
        ),
        "container_shapes": _C
        + "SELECT j AS json, p AS pg_array, count(*) AS n FROM ("
        "SELECT true AS j, false AS p FROM c UNION ALL SELECT false, true FROM c "
        "UNION ALL SELECT false, false FROM c UNION ALL SELECT false, false FROM c "
        "UNION ALL SELECT coalesce(json_valid(props), false), false FROM events) GROUP BY 1, 2",
        "leaf_scan_profiles": "SELECT 'Email' AS pii_type, count(*) AS n_leaves FROM customer",
        "leaf_scan_tags": (
            "SELECT unnest(['Email', 'CreditCard']) AS pii_type, "
            "unnest([count(*), count(*)]) AS n_leaves FROM customer"
        ),
        "pii_rows_filter": _O
        + f"SELECT o_orderkey, buyer_email, status FROM o WHERE {pii('buyer_email')} IS NOT NULL",
        "sql_functions": _C
        + f"SELECT c_custkey, {pii('ssn')} AS t, {fake('email', 'email')} AS e, "
        f"{sample('phone')} AS s FROM c",
        "mask_heuristic": _C + f"SELECT c_custkey, {flat_masked} FROM c",
        "mask_rules": _C
        + "SELECT c_custkey, "
        + ", ".join(f"{_policy_cell(c)} AS {c}" for c in _COLUMNS[1:])
        + " FROM c",
        "mask_rule_precedence": _C
        + f"SELECT c_custkey, {fake('address', 'email')} AS email, '0.0.0.0' AS notes FROM c",
        "mask_table_scope": _C + "SELECT c_custkey, notes, '0.0.0.0' AS address FROM c",
        "mask_ignore_table": _C + "SELECT c_custkey, '0.0.0.0' AS notes FROM c",
        "mask_disabled": _C + "SELECT * FROM c",
        "mask_unknown_strategy": _C
        + "SELECT c_custkey AS k, 'MASKED' AS c_custkey, 'MASKED' AS notes, "
        f"{masked('email')} AS email FROM c",
        "mask_hash": _C
        + f"SELECT c_custkey, {fake('hash', 'email')} AS email, 'MASKED' AS strict FROM c",
        "mask_ssn_ip_dob_passport": _CO
        + f"SELECT o_orderkey, {fake('ssn', 'ssn')} AS ssn, '0.0.0.0' AS client_ip, "
        "'1900-01-01' AS born, 'XXXXXXXX' AS passport_no FROM o JOIN c ON o_custkey = c_custkey",
        "mask_address_phone_card": _C
        + "SELECT c_custkey, "
        + ", ".join(f"{fake(c, c)} AS {c}" for c in ("address", "phone", "credit_card"))
        + " FROM c",
        "mask_salted": _C
        + f"SELECT c_custkey, {fake('email', 'email', _q('pepper') + ' || email')} AS email, "
        f"{fake('hash', 'phone', _q('pepper') + ' || phone')} AS phone FROM c",
        "mask_coerced_orders": (
            f"SELECT {masked('k')} AS o_orderkey, {masked('v')} AS o_orderdate, "
            f"{masked('o_orderpriority')} AS o_orderpriority FROM (SELECT o_orderkey::VARCHAR AS k, "
            "o_orderdate::DATE::VARCHAR AS v, o_orderpriority FROM orders)"
        ),
        "mask_lineitem_days": (
            f"SELECT {masked('v')} AS l_shipdate, l_returnflag, l_linestatus, count(*) AS n FROM "
            "(SELECT l_shipdate::DATE::VARCHAR AS v, l_returnflag, l_linestatus FROM lineitem) "
            "GROUP BY 1, 2, 3"
        ),
        "mask_documents": (
            f"SELECT doc_id, md5({masked('text')}) AS digest, {masked('source')} AS source "
            "FROM documents"
        ),
        "mask_consistent_join": _CO
        + f"SELECT c_custkey, {fake('email', 'email')} AS email, count(*) AS n_orders, "
        "CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS spent "
        "FROM c JOIN o ON email = buyer_email GROUP BY c_custkey, email",
        "mask_sql_result": _CO
        + f"SELECT {fake('email', 'email')} AS email, count(*) AS n FROM c JOIN o "
        "ON email = buyer_email WHERE email LIKE 'user1%' GROUP BY c.email",
        "mask_json_cells": _C + f"SELECT c_custkey, {_PROFILE} AS profile FROM c",
        "mask_json_rule_invalid": _C
        + f"SELECT c_custkey, {_PROFILE} AS profile, 'MASKED' AS notes FROM c",
        "mask_pg_array_cells": _C + f"SELECT c_custkey, {_TAGS} AS tags FROM c",
        "mask_array_native": _C
        + f"SELECT c_custkey, {fake('ssn', 'ssn')} || '|' || notes || '|0.0.0.0' AS a FROM c",
        "mask_struct_map_native": _C
        + f"SELECT c_custkey, {fake('ssn', 'ssn')} AS ssn, notes, 'XXXXXXXX' AS passport_no, "
        "'0.0.0.0' AS ip FROM c",
        "events_props_untouched": "SELECT event_id, props FROM events",
        "partial_masks": _C
        + f"SELECT c_custkey, {_partial_email('email')} AS email, "
        "'***-***-' || right(phone, 4) AS phone, "
        "'****-****-****-' || right(credit_card, 4) AS credit_card, "
        "'*** St, Town ' || c_nationkey || ', XY' AS address, "
        "'{\"user\":{\"email\":\"user' || c_custkey || '@example.com\",\"name\":\"N' "
        "|| c_custkey || '\"},\"n\":' || c_custkey || '}' AS profile, "
        "'{\"***\": \"***\"}' AS not_json, '***@***.***' AS not_email, '***-****' AS not_phone, "
        "'****-****-****-****' AS not_card, '***' AS other "
        "FROM c JOIN customer USING (c_custkey)",
        "quick_masks": _C
        + "SELECT c_custkey, CASE WHEN email IS NOT NULL THEN 'u***@*******.com' END AS email, "
        "'***-***-' || right(phone, 4) AS phone, '****-****-****-****' AS card, "
        "'*** Masked Address ***' AS address, '{\"***\": \"***\"}' AS profile FROM c",
        "sample_mask": (
            f"SELECT p_partkey, {sample('p_name')} AS name, {sample('p_brand')} AS brand, "
            f"{sample('p_size::VARCHAR')} AS size FROM part"
        ),
        "value_preview": (
            "SELECT doc_id, CASE WHEN length(text) > 50 THEN left(text, 50) || '...' "
            "ELSE text END AS shown FROM documents"
        ),
        "rules_first_match": f"WITH r AS ({X.RULES}), k AS ({X.CATALOG}) "
        'SELECT k."table", k."column", min(r.rule_idx) AS rule_idx, '
        "arg_min(r.strategy, r.rule_idx) AS strategy FROM k JOIN r ON r.\"column\" = k.\"column\" "
        'AND (r."table" IS NULL OR r."table" = k."table") GROUP BY 1, 2',
        "rules_delete_by_column": _R
        + "SELECT \"column\", count(*) AS n FROM r WHERE \"column\" <> 'mail' AND NOT "
        "(\"column\" = 'user_email' AND \"table\" IS NOT DISTINCT FROM 't_7') GROUP BY 1",
        "rules_delete_by_index": _R + "SELECT * REPLACE (CASE WHEN rule_idx > 3 THEN rule_idx - 1 ELSE rule_idx END AS rule_idx) "
        "FROM r WHERE rule_idx <> 3",
        "rules_delete_twice": _R
        + "SELECT * REPLACE (rule_idx - 2 AS rule_idx) FROM r WHERE rule_idx > 1",
        "rules_import_append": _R
        + "SELECT * FROM r UNION ALL SELECT rule_idx + 1 + (SELECT max(rule_idx) FROM r), "
        '"table", "column", strategy FROM r WHERE "table" IS NULL',
        "rules_summary": _R
        + 'SELECT count(*) AS total, count(*) FILTER ("table" IS NULL) AS global_rules, '
        "count(DISTINCT strategy) AS strategies FROM r",
        "rules_suggested": _VIEWS
        + f"f AS ({_FOUND}) SELECT \"table\", \"column\", CASE pii_type WHEN 'Email' THEN 'email' "
        "WHEN 'Phone' THEN 'phone' WHEN 'CreditCard' THEN 'credit_card' ELSE 'hash' END "
        "AS strategy FROM f",
        "findings_uncovered": _VIEWS
        + f"f AS ({_FOUND}) SELECT \"table\", \"column\", pii_type FROM f WHERE \"column\" <> "
        "'phone' AND NOT (\"table\" = 'pii_customers' AND \"column\" = 'ssn')",
        "change_log_rows": _C
        + "SELECT c_custkey, 'DataMasked' AS event_type, 'Masked ' || count(*) OVER "
        "(PARTITION BY c_custkey) || ' fields in DataRow' AS content, column_idx, column_name, "
        f"strategy, original, masked FROM {log}",
        "change_log_heuristic": _C
        + "SELECT 'Masked ' || (7 + CASE WHEN email IS NOT NULL THEN 1 ELSE 0 END) "
        "|| ' fields in DataRow' AS content, count(*) AS n FROM c GROUP BY 1",
        "masking_counts": _C + _COUNTS,
        "masking_counts_wide": _C
        + "SELECT count(email) AS email, count(*) AS phone, 0::BIGINT AS address, "
        "count(*) AS credit_card, count(*) AS ssn, count(*) AS ip, 0::BIGINT AS dob, "
        "count(*) AS passport, 0::BIGINT AS hash, count(*) AS json, count(*) AS other, "
        "count(email) + 7 * count(*) AS total FROM c",
        "strategy_share": _C + _share(_COUNTS, "strategy"),
        "scan_profile": _VIEWS + f"p AS ({_profile(_TEXT_COLUMNS)}) SELECT * FROM p",
        "scan_findings": _VIEWS + f"f AS ({_FOUND}) SELECT * FROM f",
        "scan_findings_low_threshold": f"WITH pii_customers AS ({X.PII_CUSTOMERS}), {_CONTACTS} "
        + _findings(_profile({"contacts": ("email", "mobile", "tel", "note")}), 0.2),
        "scan_sampled": f"WITH pii_customers AS (SELECT * FROM ({X.PII_CUSTOMERS}) "
        "ORDER BY c_custkey LIMIT 100) "
        + _findings(_profile({"pii_customers": _COLUMNS[1:]}, "c_custkey"), 0.5),
        "scan_summary": _VIEWS
        + f"f AS ({_findings(_profile(_TEXT_COLUMNS), 0.5)}) SELECT 'completed' AS status, "
        f"{len(_ALL_COLUMNS)}::BIGINT AS tables_scanned, 0::BIGINT AS tables_hidden, "
        f"{sum(len(c.split(',')) for c in _ALL_COLUMNS.values())}::BIGINT AS columns_scanned, "
        "count(*) AS findings FROM f",
        "scan_type_breakdown": _VIEWS
        + f"p AS ({_profile(_TEXT_COLUMNS)}) SELECT \"table\", \"column\", "
        f"{', '.join(_N.values())}, match_count FROM p WHERE match_count > 0",
        "schema_report": _VIEWS
        + "x AS ("
        + " UNION ALL ".join(
            f"SELECT '{t}' AS \"table\", {len(c.split(','))}::BIGINT AS n_columns, "
            f"'{c}' AS columns, count(*) AS row_count FROM {t}"
            for t, c in _ALL_COLUMNS.items()
            if t != "region"
        )
        + ") SELECT * FROM x",
        "row_counts": " UNION ALL ".join(
            f"SELECT '{t}' AS \"table\", count(*) AS row_count FROM {t}" for t in X.DRIVER_TABLES
        ),
        "audit_latest": _A + f"SELECT * FROM a {_NEWEST} 100",
        "audit_by_type": _A
        + f"SELECT * FROM a WHERE event_type = 'auth_attempt' {_NEWEST} 50",
        "audit_by_outcome": _A + f"SELECT * FROM a WHERE outcome = 'denied' {_NEWEST} 50",
        "audit_unknown_filter": _A + f"SELECT * FROM a {_NEWEST} 20",
        "audit_admitted": _A
        + "SELECT * FROM a WHERE event_type IN ('rule_added', 'auth_attempt')",
        "audit_retention": _A + f"SELECT * FROM a {_NEWEST} 1000",
        "audit_response": _A
        + f"SELECT count(*) AS count, max(id) AS newest, min(id) AS oldest "
        f"FROM (SELECT * FROM a {_NEWEST} 25)",
        "audit_rollup": _A
        + "SELECT event_type, count(*) FILTER (outcome = 'success') AS success, "
        "count(*) FILTER (outcome = 'failure') AS failure, "
        "count(*) FILTER (outcome = 'denied') AS denied, count(*) AS total FROM a GROUP BY 1",
        "audit_round_trip": _A
        + "SELECT event_type, auth_method, count(*) AS n FROM a GROUP BY 1, 2",
        "log_details": _O
        + "SELECT 'buyer_email' AS column_name, 'email' AS strategy, count(buyer_email) AS n "
        "FROM o UNION ALL SELECT 'born', 'dob', count(born) FROM o",
        "recent_activity": _S
        + "SELECT * FROM (SELECT ts, connection_id, 'Query' AS event_type FROM s UNION ALL "
        "SELECT ts, user_id, 'DataMasked' FROM events WHERE event_type = 'purchase') "
        "ORDER BY ts DESC, connection_id DESC, event_type LIMIT 100",
        "statement_types": _S + f"SELECT {_KIND} AS kind, count(*) AS n FROM s GROUP BY 1",
        "statement_counters": _S
        + "SELECT count(*) AS total, "
        + ", ".join(
            f"count(*) FILTER (k = '{k}') AS \"{k}\""
            for k in ("select", "insert", "update", "delete", "other")
        )
        + f" FROM (SELECT {_KIND_BUCKET} AS k FROM s)",
        "statement_share": _S
        + _share(f"SELECT {_KIND_BUCKET} AS kind, count(*) AS n FROM s GROUP BY 1", "kind"),
        "history_last_60": f"SELECT * EXCLUDE (total_connections) FROM ({_history('5 seconds')}) "
        "ORDER BY ts DESC LIMIT 60",
        "history_by_minute": f"SELECT * EXCLUDE (total_connections) FROM ({_history('1 minute')})",
        "history_7s": f"SELECT * EXCLUDE (total_connections) FROM ({_history('7 seconds')}) "
        "ORDER BY ts DESC LIMIT 500",
        "history_by_day": f"SELECT * EXCLUDE (total_connections) FROM ({_history('1 day')})",
        "active_sessions": "SELECT ts, active_connections, total_connections FROM ("
        + _history(
            "1 minute",
            f"SELECT start AS ts, 1 AS a, 0 AS q, 0 AS m, 1 AS t FROM ({_sessions(300)}) "
            f"UNION ALL SELECT \"end\", -1, 0, 0, 0 FROM ({_sessions(300)})",
        )
        + ")",
        "latency_quantiles": "SELECT event_type, quantile_disc(value, 0.5) AS p50, "
        "quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 "
        "FROM events GROUP BY 1",
        "latency_summary": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, "
        "min(value) AS low, max(value) AS high FROM events GROUP BY 1",
        "labelled_counters": _A
        + "SELECT event_type, outcome, count(*) AS n FROM a GROUP BY 1, 2",
        "stats_row": f"WITH s AS ({X.STATEMENTS}), c AS ({X.PII_CUSTOMERS}), k AS ({_COUNTS}) "
        "SELECT 0::BIGINT AS active_connections, "
        f"(SELECT count(*) FROM ({_sessions(300)})) AS total_connections, "
        "(SELECT CAST(sum(n) AS BIGINT) FROM k) AS masked, "
        "(SELECT CAST(sum(n) AS BIGINT) FROM k WHERE strategy = 'json') AS masked_json, "
        "(SELECT count(*) FROM s) AS n_queries, "
        f"(SELECT count(*) FROM s WHERE {_KIND} = 'SELECT') AS n_select, 60::BIGINT AS points",
        "human_units": f"SELECT doc_id, {_bytes('(n_chars * n_chars)')} AS size, "
        "CASE WHEN n_chars * 10 < 1000 THEN (n_chars * 10) || 'ms' "
        f"WHEN n_chars * 10 < 60000 THEN {_tenths('(n_chars * 10 / 1000)')} || 's' "
        f"ELSE {_tenths('(n_chars * 10 / 60000)')} || 'm' END AS took FROM documents",
        "idle_sessions": _sessions(3600),
        "health_state": "SELECT event_id, ts, user_id, ok, healthy, "
        "CASE WHEN healthy THEN 'ok' ELSE 'degraded' END AS status, consecutive_failures, "
        f"consecutive_successes FROM ({_health(3, 1)})",
        "health_report": "SELECT user_id, max(ts) AS last_check, "
        + ", ".join(
            f"arg_max({c}, ts) AS {a}"
            for c, a in (
                ("healthy", "healthy"),
                ("consecutive_failures", "consecutive_failures"),
                ("consecutive_successes", "consecutive_successes"),
                ("CASE WHEN healthy THEN 'ok' ELSE 'degraded' END", "status"),
                ("value", "latency_ms"),
            )
        )
        + f" FROM ({_health(2, 2)}) GROUP BY 1",
        "rate_flag": "SELECT event_id, ts, event_type, row_number() OVER (PARTITION BY event_type, "
        "time_bucket(INTERVAL '5 minutes', ts) ORDER BY ts, event_id) > 3 AS rejected FROM events",
        "rate_counts": "SELECT event_type, time_bucket(INTERVAL '5 minutes', ts) AS start, "
        "least(count(*), 3) AS accepted, greatest(count(*) - 3, 0) AS rejected "
        "FROM events GROUP BY 1, 2",
        "stream_mask_equals_batch": (
            f"SELECT event_id, '1900-01-01' AS day, props FROM events"
        ),
        "stream_counters": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type AS key, "
        "count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= "
        "(SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2",
        "stream_counters_all": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type AS key, "
        "count(*) AS n FROM events GROUP BY 1, 2",
        "mask_json_hostile": "SELECT c_custkey, false AS leaks FROM customer",
        "token_scan_documents": _tokens("documents", "text"),
        "token_scan_pages": _tokens("pages", "html"),
        "docs_with_pii": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM "
        f"(SELECT doc_id, unnest(regexp_split_to_array(text, '[{P.WS_CLASS}]+')) AS v FROM documents) "
        f"WHERE {pii('v')} IS NOT NULL)",
        "stream_masked_with_log": f"SELECT event_id, {fake('hash', 'event_type')} AS event_type, "
        f"{fake('hash', 'event_type')} AS logged FROM events",
        "stream_health": "SELECT event_id, user_id, healthy, consecutive_failures, "
        f"consecutive_successes FROM ({_health(3, 1)})",
    }
    from maskframe.plans import oracles_text, oracles_time

    return out | oracles_text.sql() | oracles_time.sql()
