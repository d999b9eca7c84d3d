"""Rows and what was in force at their time: as-of joins, and masking by rules with a history.

Rows and changes are put in one order of time, which is cut into ranges.  Within a range
the last change is carried to the rows behind it; a range that begins without one takes
the last change of the ranges before it, of which there is one small row each.  There is
no join on a range of times, and no key or span of time is ever brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.functions.nested import TEXT_TYPES, mask_text_sql
from maskframe.functions.prose import mask_prose_sql
from maskframe.functions.sqltext import case, lit, quote
from maskframe.functions.strategies import BUILT_IN, FALLBACK, fake_sql
from maskframe.operators.mask import _json_rule_sql
from maskframe.operators.ranks import placed


def as_of(rows: DataFrame, changes: DataFrame, ts: str, at: str, value: str, name: str) -> DataFrame:
    """``rows`` with the ``value`` of the last change at or before their time ``ts``, as ``name``.

    ``changes`` have a time ``at``; of several at one time the one with the greatest value
    counts.  Rows before the first change, and rows without a time, get a null; changes
    without a time are no changes.
    """
    kind = rows.schema[ts].dataType
    held = rows.select(
        F.col(ts).alias("__t"),
        F.lit(1).alias("__row"),
        F.lit(None).cast(changes.schema[value].dataType).alias("__v"),
        F.struct(*[F.col(quote(c)) for c in rows.columns]).alias("__r"),
    )
    moves = changes.where(F.col(at).isNotNull()).select(
        F.col(at).cast(kind).alias("__t"),
        F.lit(0).alias("__row"),
        F.col(value).alias("__v"),
        F.lit(None).cast(held.schema["__r"].dataType).alias("__r"),
    )
    both = placed(held.unionByName(moves), ["__t", "__row", "__v"])
    move = F.when(F.col("__row") == 0, F.struct(F.col("__v").alias("v")))
    so_far = Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("__in", F.last(move, True).over(so_far)).where("__row = 1")
    ends = both.groupBy("__part").agg(F.max_by(move, F.when(move.isNotNull(), F.col("__place"))).alias("__end"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    carried = ends.select("__part", F.last("__end", True).over(earlier).alias("__before"))
    found = inside.join(carried, "__part").withColumn("__now", F.coalesce("__in", "__before"))
    return found.select("__r.*", F.when(F.col("__t").isNotNull(), F.col("__now.v")).alias(name))


def rules_in_force(history: DataFrame, table: str | None = None) -> DataFrame:
    """One row per version of a rule list: ``valid_from`` and its ``rules`` that concern a table, first match first.

    ``history`` has ``valid_from``, ``rule_idx``, ``table``, ``column``, ``strategy``, a row for each
    rule of each version; a version without rules is one row without a column.
    """
    mine = F.col("column").isNotNull() & (F.col("table").isNull() | F.col("table").eqNullSafe(F.lit(table)))
    listed = F.collect_list(F.when(mine, F.struct("rule_idx", "column", "strategy")))
    return history.groupBy("valid_from").agg(F.array_sort(listed).alias("rules"))


def _by_name(v: str, strategy: str, salt: str) -> str:
    """SQL text: a value masked by the strategy that another expression names."""
    named = [(f"{strategy} = {lit(s)}", fake_sql(v, s, salt)) for s in BUILT_IN if s != "json"]
    named += [
        (f"{strategy} = 'json'", _json_rule_sql(v, salt)),
        (f"{strategy} = 'prose'", mask_prose_sql(v, salt)),
    ]
    return case([(f"{v} IS NOT NULL", case(named, otherwise=lit(FALLBACK)))])


def mask_as_of(
    df: DataFrame, history: DataFrame, ts: str, table: str | None = None, salt: str = "", version: str | None = None
) -> DataFrame:
    """Mask every row by the rules that were in force at its time ``ts``.

    ``history`` is as for ``rules_in_force``.  A text column that the version in force has no
    rule for, or a row before the first version, is masked by what its value looks
    like.  Columns of other types that any version has a rule for become text.
    ``version`` names a column for the version's time.
    """
    versions = rules_in_force(history, table)
    current = "__valid_from"
    timed = as_of(df, versions, ts, "valid_from", "valid_from", current)
    # Names of columns only: no more than the table has.
    ruled = {r[0] for r in history.select("column").where(F.col("column").isin(*df.columns)).distinct().collect()}
    joined = timed.join(versions.withColumnRenamed("valid_from", current).withColumnRenamed("rules", "__rules"), current, "left")
    text = joined.select(
        *[
            F.col(quote(f.name)).cast("string").alias(f.name)
            if f.name in ruled and not isinstance(f.dataType, TEXT_TYPES)
            else F.col(quote(f.name))
            for f in df.schema.fields
        ],
        current,
        "__rules",
    )

    def masked(f: T.StructField) -> Column:
        v = quote(f.name)
        if not isinstance(f.dataType, TEXT_TYPES) and f.name not in ruled:
            return F.col(v)
        looks = mask_text_sql(v, salt) if isinstance(f.dataType, TEXT_TYPES) else v
        if f.name not in ruled:
            return F.expr(looks).alias(f.name)
        rule = f"get(filter(__rules, r -> r.column = {lit(f.name)}), 0).strategy"
        # The strategy is found once and named in the branches.
        return F.expr(f"get(transform(array({rule}), _s -> CASE WHEN _s IS NULL THEN {looks} ELSE {_by_name(v, '_s', salt)} END), 0)").alias(f.name)

    extra = [F.col(current).alias(version)] if version else []
    return text.select(*[masked(f) for f in df.schema.fields], *extra)
