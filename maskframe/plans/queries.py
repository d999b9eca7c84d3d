"""The registered queries: every operator over the driver tables.

Each takes ``(spark, sf_dir)`` and reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.functions.detect import (
    contains_pii,
    is_json,
    looks_like_pg_array,
    name_pii_type,
    pii_type,
    strategy_of,
)
from maskframe.functions.nested import (
    leaf_scan,
    mask_json,
    mask_nested,
    mask_pg_array,
    mask_text,
)
from maskframe.functions.prose import holds_personal_data, redact_text, token_scan
from maskframe.functions.partial import mask_sample, partial, preview, quick
from maskframe.functions.sql import register_functions
from maskframe.functions.strategies import mask_value
from maskframe.functions.units import human_bytes, human_ms
from maskframe.operators import audit as A
from maskframe.operators import discover as D
from maskframe.operators import ordered as O
from maskframe.operators import rules as R
from maskframe.operators import stats as K
from maskframe.operators.mask import (
    change_log,
    mask,
    mask_sql,
    masking_counters,
    masking_counters_wide,
)
from maskframe.plans import fixtures as X
from maskframe.policy import AuditConfig, MaskPolicy, Rule
from maskframe.sources import tables as S
from maskframe.sources.sinks import work_dir, write_audit
from maskframe.streaming import streams as ST

Query = Callable[[SparkSession, str], DataFrame]

# Rules of the flagship query, in order of precedence.
POLICY = MaskPolicy(
    (
        Rule("orders", "phone", "hash"),
        Rule("customers", "phone", "phone"),
        Rule(None, "email", "email"),
        Rule(None, "phone", "ssn"),
        Rule(None, "address", "address"),
        Rule(None, "notes", "no_such_strategy"),
        Rule(None, "profile", "json"),
        Rule(None, "tags", "json"),
        Rule("customers", "client_ip", "hash"),
    )
)
NO_RULES = MaskPolicy()
FULL = D.ScanConfig(sample_size=None)
_registry: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _registry[fn.__name__] = fn
    return fn


def customers(spark: SparkSession, d: str) -> DataFrame:
    return X.derived(spark, d, X.PII_CUSTOMERS, "customer")


def orders(spark: SparkSession, d: str) -> DataFrame:
    return X.derived(spark, d, X.PII_ORDERS, "orders")


def audit_rows(spark: SparkSession, d: str) -> DataFrame:
    return X.derived(spark, d, X.AUDIT_ROWS, "events")


def statement_log(spark: SparkSession, d: str) -> DataFrame:
    return X.derived(spark, d, X.STATEMENTS, "events")


def probes(spark: SparkSession, d: str) -> DataFrame:
    return X.derived(spark, d, X.PROBES, "events")


def scan_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """All driver tables and the derived ones."""
    return {
        **X.tables(spark, d),
        "pii_customers": customers(spark, d),
        "pii_orders": orders(spark, d),
    }


def _flat(df: DataFrame) -> DataFrame:
    return df.drop("profile", "tags")


# ---- detection ---------------------------------------------------------------


@query
def classify_customers(spark, d):
    """Type of every cell."""
    df = customers(spark, d)
    return df.select("c_custkey", *[pii_type(c).alias(c) for c in df.columns[1:]])


@query
def classify_counts(spark, d):
    """D1 over the text of every document, page and turn, and of customer cells."""
    parts = [
        X.table(spark, d, t).select(F.lit(f"{t}.{c}").alias("source"), pii_type(c).alias("t"))
        for t, c in (
            ("documents", "text"), ("pages", "html"), ("pages", "url"),
            ("conversations", "text"), ("benchmark", "text"), ("events", "props"),
            ("customer", "c_name"),
        )
    ]
    df = customers(spark, d)
    parts += [
        df.select(F.lit(f"pii_customers.{c}").alias("source"), pii_type(c).alias("t"))
        for c in ("email", "phone", "ssn", "credit_card", "client_ip", "passport_no", "notes")
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("source", F.coalesce("t", F.lit("none")).alias("pii_type")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def date_columns_as_dob(spark, d):
    """A date column in text form."""
    df = S.stringify(X.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("t")))
    return df.groupBy(pii_type("t").alias("pii_type")).agg(F.count(F.lit(1)).alias("n"))


@query
def name_heuristics(spark, d):
    """Types and strategies suggested by column names."""
    named = X.derived(spark, d, X.CATALOG, "part").withColumn("t", name_pii_type("column"))
    return named.groupBy(
        F.coalesce("t", F.lit("none")).alias("pii_type"),
        F.coalesce(strategy_of("t"), F.lit("none")).alias("strategy"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query
def container_shapes(spark, d):
    """JSON text, array text or neither."""
    df = customers(spark, d).select(
        F.explode(F.array("profile", "tags", "email", "notes")).alias("v")
    ).unionByName(X.table(spark, d, "events").select(F.col("props").alias("v")))
    return df.groupBy(
        F.coalesce(is_json("v"), F.lit(False)).alias("json"),
        F.coalesce(looks_like_pg_array("v"), F.lit(False)).alias("pg_array"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query
def token_scan_documents(spark, d):
    """Types among the tokens of whole texts."""
    return token_scan(X.table(spark, d, "documents"), "text")


@query
def token_scan_pages(spark, d):
    """The same in web pages."""
    return token_scan(X.table(spark, d, "pages"), "html")


@query
def docs_with_pii(spark, d):
    """Documents any token of which is personal data."""
    docs = X.table(spark, d, "documents")
    return docs.where(holds_personal_data("text")).select("doc_id", "lang")


@query
def redact_documents(spark, d):
    """Whole texts with tags in place of personal data."""
    return X.table(spark, d, "documents").select("doc_id", redact_text("text").alias("text"))


@query
def redact_pages(spark, d):
    """The same in web pages."""
    return X.table(spark, d, "pages").select("page_id", redact_text("html").alias("html"))


@query
def redact_conversations(spark, d):
    """Texts that hold none stay as they are."""
    turns = X.table(spark, d, "conversations")
    return turns.select("conv_id", "turn", redact_text("text").alias("text"))


@query
def mask_json_hostile(spark, d):
    """Containers that are broken, deep or hold control characters leak nothing."""
    hostile = X.derived(spark, d, X.HOSTILE, "customer", spread=True)
    masked = hostile.select("c_custkey", "secret", mask_text("cell").alias("masked"))
    return masked.select("c_custkey", F.contains("masked", "secret").alias("leaks"))


@query
def leaf_scan_profiles(spark, d):
    """Types among the leaves of JSON cells."""
    return leaf_scan(customers(spark, d), "profile")


@query
def leaf_scan_tags(spark, d):
    """Types among the elements of array cells."""
    return leaf_scan(customers(spark, d), "tags")


@query
def pii_rows_filter(spark, d):
    """Rows with any detectable value."""
    df = orders(spark, d).select("o_orderkey", "buyer_email", "status")
    return df.where(contains_pii(df))


@query
def sql_functions(spark, d):
    """The SQL names of the scalar functions."""
    register_functions(spark)
    return spark.sql(
        "SELECT c_custkey, pii_type(ssn) AS t, mask_value(email, 'email') AS e, "
        "mask_sample(phone) AS s FROM {t}",
        t=customers(spark, d),
    )


# ---- masking -----------------------------------------------------------------


@query
def mask_heuristic(spark, d):
    """T1 without rules, flat cells."""
    return mask(_flat(customers(spark, d)), NO_RULES)


@query
def mask_rules(spark, d):
    """Rules first, heuristics for the rest."""
    return mask(customers(spark, d), POLICY, table="customers")


@query
def mask_rule_precedence(spark, d):
    """The first rule wins and needs no pattern."""
    policy = MaskPolicy(
        (Rule(None, "email", "address"), Rule(None, "email", "email"), Rule(None, "notes", "ip"))
    )
    return mask(customers(spark, d).select("c_custkey", "email", "notes"), policy)


@query
def mask_table_scope(spark, d):
    """R2: a rule of another table does not apply."""
    policy = MaskPolicy((Rule("orders", "notes", "ip"), Rule("customers", "address", "ip")))
    df = customers(spark, d).select("c_custkey", "notes", "address")
    return mask(df, policy, table="customers")


@query
def mask_ignore_table(spark, d):
    """R2: every rule applies to every table."""
    policy = MaskPolicy((Rule("orders", "notes", "ip"),))
    df = customers(spark, d).select("c_custkey", "notes")
    return mask(df, policy, table="customers", ignore_table=True)


@query
def mask_disabled(spark, d):
    """Switched off, rows stay."""
    policy, _ = POLICY.set_enabled(False)
    return mask(customers(spark, d), policy, table="customers")


@query
def mask_unknown_strategy(spark, d):
    """M9: unknown strategies give the constant, also on numbers."""
    policy = MaskPolicy((Rule(None, "notes", "whatever"), Rule(None, "c_custkey", "other")))
    df = customers(spark, d).select(F.col("c_custkey").alias("k"), "c_custkey", "notes", "email")
    return mask(df, policy)


@query
def mask_hash(spark, d):
    """Digest, and the constant in strict mode."""
    df = customers(spark, d).select(
        "c_custkey", "email", mask_value("notes", "hash", strict_reference=True).alias("strict")
    )
    return mask(df, MaskPolicy((Rule(None, "email", "hash"),)))


@query
def mask_ssn_ip_dob_passport(spark, d):
    """M5-M8."""
    df = orders(spark, d).join(
        customers(spark, d), F.col("o_custkey") == F.col("c_custkey")
    ).select("o_orderkey", "ssn", "client_ip", "born", "passport_no")
    return mask(df, NO_RULES)


@query
def mask_address_phone_card(spark, d):
    """M2-M4."""
    df = customers(spark, d)
    return df.select(
        "c_custkey",
        mask_value("address", "address").alias("address"),
        mask_value("phone", "phone").alias("phone"),
        mask_value("credit_card", "credit_card").alias("credit_card"),
    )


@query
def mask_salted(spark, d):
    """A salt changes every fake."""
    df = customers(spark, d).select("c_custkey", "email", "phone")
    return mask(df, MaskPolicy((Rule(None, "phone", "hash"),)), salt="pepper")


@query
def mask_coerced_orders(spark, d):
    """T1 with coercion: dates and numbers in text form are searched too."""
    df = X.table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority"
    )
    return mask(df, NO_RULES, coerce=True)


@query
def mask_lineitem_days(spark, d):
    """T1 with coercion over the largest table, counted per result."""
    df = X.table(spark, d, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("l_shipdate"), "l_returnflag", "l_linestatus"
    )
    return (
        mask(df, NO_RULES, coerce=True)
        .groupBy("l_shipdate", "l_returnflag", "l_linestatus")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def mask_documents(spark, d):
    """T1 over long text cells: nothing but whole values is masked."""
    df = X.table(spark, d, "documents").select("doc_id", "text", "source")
    return mask(df, NO_RULES).select("doc_id", F.md5("text").alias("digest"), "source")


@query
def mask_consistent_join(spark, d):
    """T5: masked keys still join."""
    people = mask(customers(spark, d).select("c_custkey", "email"), NO_RULES)
    bought = mask(
        orders(spark, d).select("o_totalprice", F.col("buyer_email").alias("email")), NO_RULES
    )
    return (
        people.join(bought, "email")
        .groupBy("c_custkey", "email")
        .agg(
            F.count(F.lit(1)).alias("n_orders"),
            F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spent"),
        )
    )


@query
def mask_sql_result(spark, d):
    """T4: the query runs on raw values, its result is masked."""
    text = (
        "SELECT c.email, count(*) AS n FROM {o} o JOIN {c} c "
        "ON o.buyer_email = c.email WHERE c.email LIKE 'user1%' GROUP BY c.email"
    )
    tables = {"o": orders(spark, d), "c": customers(spark, d)}
    return mask_sql(spark, text, NO_RULES, tables=tables)


# ---- nested values -----------------------------------------------------------


@query
def mask_json_cells(spark, d):
    """Leaves of JSON text."""
    return customers(spark, d).select("c_custkey", mask_json("profile").alias("profile"))


@query
def mask_json_rule_invalid(spark, d):
    """The json strategy on text that is not JSON."""
    df = customers(spark, d).select("c_custkey", "profile", "notes")
    policy = MaskPolicy((Rule(None, "profile", "json"), Rule(None, "notes", "json")))
    return mask(df, policy)


@query
def mask_pg_array_cells(spark, d):
    """Elements of array text."""
    return customers(spark, d).select("c_custkey", mask_pg_array("tags").alias("tags"))


@query
def mask_array_native(spark, d):
    """A native array, shown as text."""
    df = customers(spark, d).select("c_custkey", F.array("ssn", "notes", "client_ip").alias("a"))
    masked = mask_nested("a", df.schema["a"].dataType)
    return df.select("c_custkey", F.array_join(masked, "|", "null").alias("a"))


@query
def mask_struct_map_native(spark, d):
    """Structs and map values, taken apart again."""
    df = customers(spark, d).select(
        "c_custkey",
        F.struct("ssn", "notes", F.struct("passport_no").alias("deep")).alias("s"),
        F.create_map(F.lit("10.0.0.1"), F.col("client_ip")).alias("m"),
    )
    return mask(df, NO_RULES).select(
        "c_custkey",
        F.col("s.ssn").alias("ssn"),
        F.col("s.notes").alias("notes"),
        F.col("s.deep.passport_no").alias("passport_no"),
        F.col("m")["10.0.0.1"].alias("ip"),
    )


@query
def events_props_untouched(spark, d):
    """JSON without personal data keeps every byte and is not counted."""
    df = X.table(spark, d, "events").select("event_id", "props")
    return mask(df, NO_RULES).unionByName(
        change_log(df, NO_RULES, keys=("event_id",)).select("event_id", F.lit("").alias("props"))
    )


# ---- partial masks -----------------------------------------------------------


@query
def partial_masks(spark, d):
    """M12-M17."""
    return customers(spark, d).select(
        "c_custkey",
        partial("email", "email").alias("email"),
        partial("phone", "phone").alias("phone"),
        partial("credit_card", "credit_card").alias("credit_card"),
        partial("address", "address").alias("address"),
        partial("profile", "json").alias("profile"),
        partial("notes", "json").alias("not_json"),
        partial("notes", "email").alias("not_email"),
        partial("notes", "phone").alias("not_phone"),
        partial("notes", "credit_card").alias("not_card"),
        partial("notes", "zzz").alias("other"),
    )


@query
def quick_masks(spark, d):
    """M18, M19."""
    return customers(spark, d).select(
        "c_custkey",
        quick("email", "email").alias("email"),
        quick("phone", "phone").alias("phone"),
        quick("notes", "credit_card").alias("card"),
        quick("address", "address").alias("address"),
        quick("profile", "json").alias("profile"),
    )


@query
def sample_mask(spark, d):
    """M11 over values of all lengths."""
    return X.table(spark, d, "part").select(
        "p_partkey",
        mask_sample("p_name").alias("name"),
        mask_sample("p_brand").alias("brand"),
        mask_sample(F.col("p_size").cast("string")).alias("size"),
    )


@query
def value_preview(spark, d):
    """Previews of whole documents."""
    return X.table(spark, d, "documents").select("doc_id", preview("text").alias("shown"))


# ---- rules -------------------------------------------------------------------


@query
def rules_first_match(spark, d):
    """R1 as data: first rule per catalog column."""
    catalog = X.derived(spark, d, X.CATALOG, "part")
    return R.resolved_rules_df(catalog, X.derived(spark, d, X.RULES, "orders"))


@query
def rules_delete_by_column(spark, d):
    """Delete by column and table; then the list is counted."""
    rules = X.derived(spark, d, X.RULES, "orders")
    left = R.delete_rules(R.delete_rules(rules, column="mail"), column="user_email", table="t_7")
    return left.groupBy("column").agg(F.count(F.lit(1)).alias("n"))


@query
def rules_delete_by_index(spark, d):
    """R7."""
    return R.delete_rules(X.derived(spark, d, X.RULES, "orders"), index=3)


@query
def rules_delete_twice(spark, d):
    """A position counts what is left."""
    once = R.delete_rules(X.derived(spark, d, X.RULES, "orders"), index=0)
    return R.delete_rules(once, index=0)


@query
def rules_import_append(spark, d):
    """Rules are appended with their duplicates."""
    rules = X.derived(spark, d, X.RULES, "orders")
    return R.append_rules(rules, rules.where(F.col("table").isNull()))


@query
def rules_summary(spark, d):
    """R9."""
    return R.rules_summary(X.derived(spark, d, X.RULES, "orders"))


@query
def rules_suggested(spark, d):
    """A rule per finding."""
    return R.suggest_rules(scan_findings(spark, d))


@query
def findings_uncovered(spark, d):
    """Findings without a rule."""
    found = scan_findings(spark, d).select("table", "column", "pii_type")
    rules = X.derived(spark, d, X.RULES, "orders").select(
        F.when(F.col("rule_idx") % 2 == 0, F.lit("pii_customers")).alias("table"),
        F.when(F.col("rule_idx") % 2 == 0, F.lit("ssn")).otherwise("phone").alias("column"),
    )
    return R.uncovered(found, rules)


# ---- change log and counters -------------------------------------------------


@query
def change_log_rows(spark, d):
    """Entries and their details."""
    log = change_log(
        customers(spark, d), POLICY, "customers", keys=("c_custkey",), previews="sample"
    )
    return A.details(log).select(
        "c_custkey", "event_type", "content", F.col("column_idx").cast("bigint"),
        "column_name", "strategy", "original", "masked",
    )


@query
def change_log_heuristic(spark, d):
    """One count per field, JSON and arrays included."""
    log = change_log(customers(spark, d), NO_RULES)
    return log.groupBy("content").agg(F.count(F.lit(1)).alias("n"))


@query
def masking_counts(spark, d):
    """Counters in long form."""
    return masking_counters(change_log(customers(spark, d), POLICY, "customers"))


@query
def masking_counts_wide(spark, d):
    """K3: counters in one row."""
    return masking_counters_wide(change_log(customers(spark, d), NO_RULES))


@query
def strategy_share(spark, d):
    """K4."""
    return K.shares(masking_counters(change_log(customers(spark, d), POLICY, "customers")), "strategy")


# ---- discovery ---------------------------------------------------------------


@query
def scan_profile(spark, d):
    """All text columns of all tables."""
    return D.profile(scan_tables(spark, d), FULL)


@query
def scan_findings(spark, d):
    """P1-P7."""
    cfg = D.ScanConfig(sample_size=None, exclude_tables=("nation", "pages"))
    return D.scan(scan_tables(spark, d), cfg)


@query
def scan_findings_low_threshold(spark, d):
    """Names without matches, and weak matches."""
    tables = {
        "contacts": customers(spark, d).select(
            F.col("notes").alias("email"),
            F.col("ssn").alias("mobile"),
            F.when(F.col("c_custkey") % 4 == 0, F.col("phone")).alias("tel"),
            F.when(F.col("c_custkey") % 5 == 0, F.col("client_ip")).alias("note"),
        )
    }
    return D.scan(tables, D.ScanConfig(sample_size=None, confidence_threshold=0.2))


@query
def scan_sampled(spark, d):
    """An ordered sample of 100 rows, and the first matching value."""
    cfg = D.ScanConfig(sample_size=100, order_by={"pii_customers": "c_custkey"})
    return D.scan({"pii_customers": customers(spark, d)}, cfg)


@query
def scan_summary(spark, d):
    """P8."""
    return D.scan_summary(scan_tables(spark, d), FULL)


@query
def scan_type_breakdown(spark, d):
    """P12."""
    return D.type_breakdown(scan_tables(spark, d), FULL)


@query
def schema_report(spark, d):
    """Columns and rows of every table."""
    report = S.schema_report(scan_tables(spark, d), exclude=("region",))
    names = F.array_join(F.transform("columns", lambda c: c["column"]), ",")
    return report.select(
        "table",
        F.size("columns").cast("bigint").alias("n_columns"),
        names.alias("columns"),
        "row_count",
    )


@query
def row_counts(spark, d):
    """P10."""
    return S.row_counts(X.tables(spark, d))


# ---- audit -------------------------------------------------------------------


@query
def audit_latest(spark, d):
    """A2."""
    return A.latest(audit_rows(spark, d))


@query
def audit_by_type(spark, d):
    """A3."""
    return A.latest(audit_rows(spark, d), 50, event_type="auth_attempt")


@query
def audit_by_outcome(spark, d):
    """A4."""
    return A.latest(audit_rows(spark, d), 50, outcome="denied")


@query
def audit_unknown_filter(spark, d):
    """A3, A4: an unknown type filters nothing."""
    return A.latest(audit_rows(spark, d), 20, event_type="no_such", outcome="denied")


@query
def audit_admitted(spark, d):
    """A1."""
    cfg = AuditConfig(events=("rule_added", "auth_attempt"))
    return A.admit(audit_rows(spark, d), cfg)


@query
def audit_retention(spark, d):
    """A6."""
    return A.retain(audit_rows(spark, d), A.KEPT_AUDIT_ROWS)


@query
def audit_response(spark, d):
    """A5: the number of entries and the newest and oldest of them."""
    r = A.audit_response(audit_rows(spark, d), 25)
    return r.select(
        "count",
        F.element_at("entries", 1)["id"].alias("newest"),
        F.element_at("entries", -1)["id"].alias("oldest"),
    )


@query
def audit_rollup(spark, d):
    """A10."""
    return A.rollup(audit_rows(spark, d))


@query
def audit_round_trip(spark, d):
    """Written as JSON lines, read back and counted."""
    path = work_dir(spark, "audit")
    write_audit(audit_rows(spark, d), path)
    back = spark.read.schema(
        "id string, timestamp timestamp_ntz, event_type string, outcome string, "
        "auth_method string, user_id string"
    ).json(path)
    return back.groupBy("event_type", "auth_method").agg(F.count(F.lit(1)).alias("n"))


@query
def log_details(spark, d):
    """Details of heuristic entries per strategy."""
    log = change_log(orders(spark, d), NO_RULES, keys=("o_orderkey",))
    return A.details(log).groupBy("column_name", "strategy").agg(F.count(F.lit(1)).alias("n"))


@query
def recent_activity(spark, d):
    """The newest entries of statement and masking logs."""
    statements = K.statements(
        statement_log(spark, d).withColumn("text", F.col("statement")), "ts", "connection_id", "text"
    )
    seen = statements.select("ts", "connection_id", F.lit("Query").alias("event_type"))
    bought = X.table(spark, d, "events").where("event_type = 'purchase'")
    log = change_log(
        bought, MaskPolicy((Rule(None, "event_type", "hash"),)), "events", keys=("ts", "user_id")
    ).withColumnRenamed("user_id", "connection_id")
    return A.activity(seen, log, "ts", "connection_id")


# ---- statistics --------------------------------------------------------------


@query
def statement_types(spark, d):
    """K1."""
    return (
        statement_log(spark, d)
        .groupBy(K.statement_type(F.col("statement")).alias("kind"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def statement_counters(spark, d):
    """K2."""
    return K.statement_counters(statement_log(spark, d))


@query
def statement_share(spark, d):
    """K5."""
    kind = K.statement_bucket(K.statement_type(F.col("statement")))
    counts = statement_log(spark, d).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return K.shares(counts, "kind")


def _changes(spark, d) -> DataFrame:
    masked = X.table(spark, d, "events").select(
        "ts", F.when(F.col("event_type") == "purchase", 2).otherwise(0).alias("n")
    )
    return K.tally(
        queries=statement_log(spark, d),
        masked=masked,
        sessions=O.idle_sessions(X.table(spark, d, "events"), "user_id"),
    )


@query
def history_last_60(spark, d):
    """K6: the newest 60 points."""
    return K.history(_changes(spark, d))


@query
def history_by_minute(spark, d):
    """K6, K7: all points, at one-minute steps."""
    return K.for_chart(K.history(_changes(spark, d), every="1 minute", keep=None))


@query
def history_7s(spark, d):
    """K6: a step that divides neither a minute nor an hour; the newest 500 points."""
    return K.history(_changes(spark, d), every="7 seconds", keep=500)


@query
def history_by_day(spark, d):
    """K6: steps longer than an hour."""
    return K.history(_changes(spark, d), every="1 day", keep=None)


@query
def active_sessions(spark, d):
    """K8: open sessions at every minute."""
    sessions = O.idle_sessions(X.table(spark, d, "events"), "user_id")
    return K.active(sessions, "start", "end", every="1 minute")


@query
def latency_summary(spark, d):
    """K9: exact measures; the quantiles are approximate and tested apart."""
    s = K.latency(X.table(spark, d, "events"), "event_type", "value")
    return s.select("event_type", "n", F.round("mean", 6).alias("mean"), "low", "high")


@query
def latency_quantiles(spark, d):
    """K9: approximate quantiles."""
    s = K.latency(X.table(spark, d, "events"), "event_type", "value")
    return s.select("event_type", "p50", "p95", "p99")


@query
def labelled_counters(spark, d):
    """K10."""
    return K.labelled(audit_rows(spark, d), "event_type", "outcome")


@query
def stats_row(spark, d):
    """Everything in one row."""
    s = K.stats(
        O.idle_sessions(X.table(spark, d, "events"), "user_id"),
        change_log(customers(spark, d), POLICY, "customers"),
        statement_log(spark, d),
        K.history(_changes(spark, d)),
    )
    return s.select(
        "active_connections",
        "total_connections",
        F.col("masking.total").alias("masked"),
        F.col("masking.json").alias("masked_json"),
        F.col("queries.total").alias("n_queries"),
        F.col("queries.select").alias("n_select"),
        F.size("history").cast("bigint").alias("points"),
    )


@query
def human_units(spark, d):
    """K12."""
    return X.table(spark, d, "documents").select(
        "doc_id",
        human_bytes(F.col("n_chars") * F.col("n_chars")).alias("size"),
        human_ms(F.col("n_chars") * 10).alias("took"),
    )


# ---- time order and streams --------------------------------------------------


@query
def idle_sessions(spark, d):
    """ST3."""
    return O.idle_sessions(X.table(spark, d, "events"), "user_id", gap_seconds=3600)


@query
def health_state(spark, d):
    """ST4: state after every probe."""
    return O.health_state(probes(spark, d), "user_id", "ok", "event_id").drop("latency_ms")


@query
def health_report(spark, d):
    """ST4: last state per server."""
    states = O.health_state(probes(spark, d), "user_id", "ok", "event_id", bad=2, good=2)
    return O.health_report(states, "user_id", "event_id", extra=("latency_ms",))


@query
def rate_flag(spark, d):
    """ST5: rows beyond the limit."""
    return O.rate_flag(
        X.table(spark, d, "events").select("event_id", "ts", "event_type"),
        "event_type", 3, "event_id", per="5 minutes",
    )


@query
def rate_counts(spark, d):
    """ST5: accepted and rejected per period."""
    return O.rate_counts(X.table(spark, d, "events"), "event_type", 3, per="5 minutes")


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = X.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _run(sdf: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain a bounded stream into files and read them."""
    spark = sdf.sparkSession
    out = work_dir(spark, name)
    q = (
        sdf.writeStream.outputMode(mode)
        .option("checkpointLocation", work_dir(spark, f"{name}-checkpoint"))
        .trigger(availableNow=True)
        .format("parquet")
        .start(out)
    )
    q.awaitTermination()
    return spark.read.schema(sdf.schema).parquet(out)


@query
def stream_mask_equals_batch(spark, d):
    """ST1: the same projection on a stream."""
    sdf = _event_stream(spark, d).select(
        "event_id", F.col("ts").cast("date").cast("string").alias("day"), "props"
    )
    return _run(ST.mask_stream(sdf, NO_RULES), "masked")


@query
def stream_counters(spark, d):
    """ST2, ST8: rows per window; the watermark closes all but the last window."""
    sdf = _event_stream(spark, d).select("ts", "event_type")
    counted = ST.stream_counters(sdf, "event_type", window="1 day", delay="1 hour")
    return _run(counted, "counters").select(
        F.col("start").cast("timestamp_ntz").alias("start"), "key", "n"
    )


@query
def stream_counters_all(spark, d):
    """ST2, ST8: every row counts, the last window and late rows too."""
    out = work_dir(spark, "counters")
    sdf = _event_stream(spark, d).select("ts", "event_type")
    ST.run_counters(
        sdf, "event_type", out, work_dir(spark, "checkpoint"), window="1 day"
    ).awaitTermination()
    counted = ST.read_counters(spark, out)
    return counted.select(F.col("start").cast("timestamp_ntz").alias("start"), "key", "n")


@query
def stream_masked_with_log(spark, d):
    """ST6, ST7, S9: masked rows and change log from one pass, rules from a file."""
    policy_path = work_dir(spark, "policy")
    rules = MaskPolicy((Rule(None, "event_type", "hash"),))
    spark.createDataFrame([(_policy_text(rules),)], "value string").coalesce(1).write.text(
        policy_path
    )
    out, log = work_dir(spark, "rows"), work_dir(spark, "log")
    sdf = _event_stream(spark, d).select("event_id", "event_type")
    ST.run_masked(
        sdf, policy_path, out, work_dir(spark, "cp"), log_out=log, keys=("event_id",)
    ).awaitTermination()
    rows = spark.read.parquet(out).select("event_id", "event_type")
    logged = spark.read.parquet(log).select(
        "event_id", F.col("details")[0]["masked"].alias("logged")
    )
    return rows.join(logged, "event_id")


def _policy_text(policy: MaskPolicy) -> str:
    import json

    return json.dumps(policy.to_dict())


@query
def stream_health(spark, d):
    """ST4 on a stream: state is carried from batch to batch."""
    out, state = work_dir(spark, "health"), work_dir(spark, "health-state")
    sdf = _event_stream(spark, d).select(
        "event_id", "ts", "user_id", (F.col("event_type") != "error").alias("ok")
    )
    ST.run_health(
        sdf, "user_id", "ok", "event_id", out, state, work_dir(spark, "health-cp")
    ).awaitTermination()
    return spark.read.parquet(out).select(
        "event_id", "user_id", "healthy", "consecutive_failures", "consecutive_successes"
    )


def registered() -> dict[str, Query]:
    from maskframe.plans import queries_text, queries_time  # noqa: F401  they register their own

    return dict(_registry)
