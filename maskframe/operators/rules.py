"""Rules as data: resolution, bookkeeping and suggestions from findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolved_rules_df(columns: DataFrame, rules: DataFrame) -> DataFrame:
    """First matching rule of every ``(table, column)`` that has one.

    Rules are first reduced to the earliest one per scope, table or global, so
    each catalog row meets at most one rule of each and no pairs are formed.
    """
    earliest = F.min(F.struct("rule_idx", "strategy"))
    local = (
        rules.where(F.col("table").isNotNull())
        .groupBy("table", "column")
        .agg(earliest.alias("__local"))
    )
    everywhere = (
        rules.where(F.col("table").isNull()).groupBy("column").agg(earliest.alias("__global"))
    )
    # least() skips nulls and orders structs by rule_idx.
    first = F.least("__local", "__global")
    return (
        columns.join(local, ["table", "column"], "left")
        .join(everywhere, ["column"], "left")
        .withColumn("__first", first)
        .where(F.col("__first").isNotNull())
        .select(
            "table",
            "column",
            F.col("__first.rule_idx").alias("rule_idx"),
            F.col("__first.strategy").alias("strategy"),
        )
    )


def append_rules(rules: DataFrame, more: DataFrame) -> DataFrame:
    """Append rules after the last one, duplicates included."""
    last = rules.agg(F.coalesce(F.max("rule_idx"), F.lit(-1))).scalar()
    return rules.unionByName(more.withColumn("rule_idx", F.col("rule_idx") + 1 + last))


def delete_rules(
    rules: DataFrame,
    index: int | None = None,
    column: str | None = None,
    table: str | None = None,
) -> DataFrame:
    """Delete by position, or by column [and table]; the rest keep their order.

    A position counts the rules that are there, whatever their numbers.  Rules
    behind it move up by one number; a position that does not exist is an error
    when the result is read.  Only ``index + 1`` numbers are ranked.
    """
    if index is not None:
        if index < 0:
            raise ValueError(f"no rule at position {index}")
        there = rules.select("rule_idx").orderBy("rule_idx").limit(index + 1)
        doomed_idx = there.agg(
            F.when(F.count(F.lit(1)) == index + 1, F.max("rule_idx")).otherwise(
                F.raise_error(F.lit(f"no rule at position {index}")).cast("bigint")
            )
        ).scalar()
        before, number = F.col("rule_idx") < F.col("__doomed"), F.col("rule_idx")
        return (
            rules.withColumn("__doomed", doomed_idx)
            .where(F.col("rule_idx") != F.col("__doomed"))
            .withColumn("rule_idx", F.when(before, number).otherwise(number - 1))
            .select(*rules.columns)
        )
    if column is None:
        raise ValueError("give an index or a column")
    doomed = F.col("column") == column
    if table is not None:
        doomed = doomed & F.col("table").eqNullSafe(table)
    return rules.where(~doomed)


def rules_summary(rules: DataFrame) -> DataFrame:
    """One row: rules, global rules, distinct strategies."""
    return rules.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("table").isNull(), F.lit(1))).alias("global_rules"),
        F.countDistinct("strategy").alias("strategies"),
    )


def suggest_rules(findings: DataFrame) -> DataFrame:
    """A rule per finding; types without a shape-keeping strategy are hashed."""
    kind = F.col("pii_type")
    strategy = (
        F.when(kind == "Email", F.lit("email"))
        .when(kind == "Phone", F.lit("phone"))
        .when(kind == "CreditCard", F.lit("credit_card"))
        .otherwise("hash")
    )
    return findings.select("table", "column", strategy.alias("strategy"))


def uncovered(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings that no rule covers.

    Rules are reduced to one row per column first, combined before the shuffle:
    whether a global rule names it, and the tables whose own rules do.  The one
    left join stays above a union of tables, and no rule is read per table.
    """
    covered = rules.groupBy("column").agg(
        F.max(F.col("table").isNull()).alias("__everywhere"),
        F.collect_set("table").alias("__tables"),
    )
    known = F.coalesce("__everywhere", F.lit(False)) | F.coalesce(
        F.array_contains("__tables", F.col("table")), F.lit(False)
    )
    return findings.join(covered, ["column"], "left").where(~known).select(*findings.columns)
