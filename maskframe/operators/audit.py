"""Audit rows: building, admission, queries and retention."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.policy import AuditConfig

# The names used in audit rows.
EVENT_TYPES = (
    "auth_attempt", "config_change", "rule_added", "rule_deleted",
    "rules_imported", "config_reload", "database_scan", "schema_query",
    "api_access",
)
OUTCOMES = ("success", "failure", "denied")
AUTH_METHODS = ("api_key", "jwt", "none")

KEPT_AUDIT_ROWS = 1000
KEPT_LOG_ROWS = 100

AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("outcome", T.StringType(), False),
        T.StructField("client_ip", T.StringType(), True),
        T.StructField("auth_method", T.StringType(), True),
        T.StructField("user_id", T.StringType(), True),
        T.StructField("endpoint", T.StringType(), True),
        T.StructField("method", T.StringType(), True),
        T.StructField("details", T.StringType(), True),
        T.StructField("error", T.StringType(), True),
    ]
)


def audit_row(
    spark: SparkSession, event_type: str, outcome: str = "success", details=None, **fields
) -> DataFrame:
    """One typed audit row; ``details`` may be any JSON value."""
    if event_type not in EVENT_TYPES:
        raise ValueError(f"event type {event_type!r}")
    if outcome not in OUTCOMES:
        raise ValueError(f"outcome {outcome!r}")
    if fields.get("auth_method") not in (None, *AUTH_METHODS):
        raise ValueError(f"auth method {fields['auth_method']!r}")
    row = {
        "id": str(uuid.uuid4()),
        "timestamp": datetime.now(timezone.utc),
        "event_type": event_type,
        "outcome": outcome,
        "details": None if details is None else json.dumps(details),
        **fields,
    }
    return spark.createDataFrame([tuple(row.get(f.name) for f in AUDIT_SCHEMA)], AUDIT_SCHEMA)


def auth_success(spark, method: str, user_id: str | None = None) -> DataFrame:
    return audit_row(spark, "auth_attempt", auth_method=method, user_id=user_id)


def auth_failure(spark, method: str, error: str) -> DataFrame:
    return audit_row(spark, "auth_attempt", "failure", auth_method=method, error=error)


def auth_denied(spark) -> DataFrame:
    return audit_row(
        spark, "auth_attempt", "denied", auth_method="none",
        error="No authentication credentials provided",
    )


def config_change(spark, details) -> DataFrame:
    return audit_row(spark, "config_change", details=details)


def rule_added(spark, rule) -> DataFrame:
    return audit_row(spark, "rule_added", details=rule)


def rule_deleted(spark, details) -> DataFrame:
    return audit_row(spark, "rule_deleted", details=details)


def rules_imported(spark, count: int) -> DataFrame:
    return audit_row(spark, "rules_imported", details={"rules_count": count})


def config_reload(spark, count: int) -> DataFrame:
    return audit_row(spark, "config_reload", details={"rules_count": count})


def database_scan(spark, database: str, findings: int) -> DataFrame:
    details = {"database": database, "findings_count": findings}
    return audit_row(spark, "database_scan", details=details)


def schema_query(spark, database: str, tables: int) -> DataFrame:
    details = {"database": database, "tables_count": tables}
    return audit_row(spark, "schema_query", details=details)


def admit(audit: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Rows that the configuration lets into the log."""
    if not cfg.enabled:
        return audit.where(F.lit(False))
    return audit.where(F.col("event_type").isin(*cfg.events)) if cfg.events else audit


def latest(
    audit: DataFrame,
    n: int = 100,
    event_type: str | None = None,
    outcome: str | None = None,
) -> DataFrame:
    """Newest ``n`` rows, of one type if given, else of one outcome if given.

    An unknown type or outcome filters nothing.  Every task keeps its own
    newest ``n`` rows, so no sort of the whole log takes place.
    """
    if event_type is not None:
        if event_type in EVENT_TYPES:
            audit = audit.where(F.col("event_type") == event_type)
    elif outcome in OUTCOMES:
        audit = audit.where(F.col("outcome") == outcome)
    return audit.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def retain(audit: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` rows of the whole log."""
    return latest(audit, n)


def audit_response(audit: DataFrame, n: int = KEPT_LOG_ROWS, **filters) -> DataFrame:
    """One row: the number of the newest ``n`` entries and the entries themselves."""
    entries = latest(audit, n, **filters)
    row = F.struct(*entries.columns)
    newest_first = F.sort_array(F.collect_list(F.struct("timestamp", "id", row.alias("e"))), False)
    return entries.agg(
        F.count(F.lit(1)).alias("count"),
        F.transform(newest_first, lambda x: x["e"]).alias("entries"),
    )


def details(log: DataFrame) -> DataFrame:
    """One row per changed field of a change log; entries without any stay."""
    rest = [c for c in log.columns if c != "details"]
    return log.select(*rest, F.explode_outer("details").alias("d")).select(
        *rest, "d.column_idx", "d.column_name", "d.strategy", "d.original", "d.masked"
    )


def recent(log: DataFrame, ts: str, tie: str, n: int = KEPT_LOG_ROWS) -> DataFrame:
    """Newest ``n`` entries of a log of any kind."""
    return log.orderBy(F.desc(ts), F.desc(tie)).limit(n)


def activity(
    statements: DataFrame, masked: DataFrame, ts: str, tie: str, n: int = KEPT_LOG_ROWS
) -> DataFrame:
    """The newest ``n`` entries of a statement log and a masking log together.

    Both have ``ts``, ``tie`` and ``event_type``.  Each log is cut to its own newest
    entries before the two are merged.
    """
    names = [ts, tie, "event_type"]
    both = recent(statements.select(*names), ts, tie, n).unionByName(
        recent(masked.select(*names), ts, tie, n)
    )
    return both.orderBy(F.desc(ts), F.desc(tie), "event_type").limit(n)


def cube(audit: DataFrame) -> DataFrame:
    """Rows per event type and outcome, per type, per outcome and in all.

    ``level`` says which: 0 for type and outcome, 1 for a type, 2 for an outcome, 3 for
    the total; what a subtotal runs over is null.  One pass; the four sets of groups are
    combined in every map task.
    """
    t, o = F.col("event_type"), F.col("outcome")
    grouped = audit.groupingSets([[t, o], [t], [o], []], t, o)
    return grouped.agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n")
    ).select("level", "event_type", "outcome", "n")


def rollup(audit: DataFrame) -> DataFrame:
    """Rows per event type, by outcome and in total."""
    return audit.groupBy("event_type").agg(
        *[F.count(F.when(F.col("outcome") == o, F.lit(1))).alias(o) for o in OUTCOMES],
        F.count(F.lit(1)).alias("total"),
    )
