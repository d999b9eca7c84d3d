"""Discovery inside JSON columns, by path.

Cells are parsed once into variants.  A step takes every container apart into its
members, counts the leaves it finds by column and path, and hands the containers among
them to the next step; there are as many steps as the deepest cell has levels, and no
cell is brought together with another.  Positions in lists are one path, ``[*]``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskframe.functions import patterns as P
from maskframe.functions.detect import is_json_sql, looks_like_json_sql, name_pii_type, pii_type_sql
from maskframe.functions.partial import mask_sample
from maskframe.functions.sqltext import case, lit, quote
from maskframe.operators.discover import COUNT_NAMES, _dominant
from maskframe.sources.sinks import staged
from maskframe.sources.tables import visible

# A member's step of the path: plain names after a point, others quoted in brackets.
_STEP = (
    "CASE WHEN key IS NULL THEN '[*]' WHEN key RLIKE '^[A-Za-z_][A-Za-z0-9_]*$' "
    "THEN concat('.', key) ELSE to_json(array(key)) END"
)


def _containers(tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """``table``, ``column``, ``path``, ``v``: the JSON cells of the named columns that are objects or lists."""
    parts = []
    for name, df in visible(tables).items():
        for c in columns.get(name, ()):
            text = quote(c)
            shaped = f"{looks_like_json_sql('t')} AND {is_json_sql('t')}"
            cells = df.selectExpr(f"CAST({text} AS STRING) AS t").where(shaped)
            parts.append(
                cells.select(
                    F.lit(name).alias("table"),
                    F.lit(c).alias("column"),
                    F.lit("$").alias("path"),
                    F.try_parse_json("t").alias("v"),
                ).where("v IS NOT NULL")
            )
    if not parts:
        raise ValueError("no column to take apart")
    return reduce(DataFrame.unionByName, parts)


def _opened(containers: DataFrame) -> DataFrame:
    """The members of containers: their path, and what they are."""
    members = containers.selectExpr("`table`", "`column`", "path", "v AS parent").lateralJoin(
        _exploded(containers.sparkSession)
    )
    kind = F.schema_of_variant("value")
    return members.select(
        "table",
        "column",
        F.expr(f"concat(path, {_STEP})").alias("path"),
        F.col("value").alias("v"),
        (kind.startswith("OBJECT") | kind.startswith("ARRAY")).alias("more"),
        (kind == "STRING").alias("said"),
    )


def _exploded(spark) -> DataFrame:
    return spark.tvf.variant_explode(F.col("parent").outer())


def _leaves(members: DataFrame) -> DataFrame:
    """Leaves per column and path, and how many are of each type; counted in every map task first."""
    leaves = members.where("NOT more").selectExpr(
        "`table`", "`column`", "path", "CASE WHEN said THEN variant_get(v, '$', 'string') END AS s"
    )
    typed = leaves.selectExpr("*", f"{pii_type_sql(f'trim(BOTH {lit(P.WS_CHARS)} FROM s)')} AS t")
    hits = [F.count(F.when(F.col("t") == t, F.lit(1))).alias(n) for t, n in zip(P.PII_TYPES, COUNT_NAMES)]
    first = F.min(F.when(F.col("t").isNotNull(), F.col("s"))).alias("first_value")
    return typed.groupBy("table", "column", "path").agg(F.count(F.lit(1)).alias("n_leaves"), *hits, first)


def scan_paths(tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """Per table, column and path of a leaf: leaves, matches, dominant type, and what the path's last name suggests.

    ``columns`` names the text columns of each table that may hold JSON.  Cells that are not
    JSON objects or lists are not counted here; ``scan`` sees them.  Null and empty
    containers have no leaves; JSON nulls, numbers and booleans are leaves without a match.
    """
    found, left = [], staged(_opened(_containers(tables, columns)), "json-members")
    while True:
        found.append(_leaves(left))
        deeper = left.where("more").select("table", "column", "path", "v")
        if deeper.isEmpty():
            break
        left = staged(_opened(deeper), "json-members")
    counted = reduce(DataFrame.unionByName, found)
    matches: Column = reduce(lambda a, b: a + b, [F.col(n) for n in COUNT_NAMES])
    last = F.regexp_extract("path", r"\.([A-Za-z_][A-Za-z0-9_]*)(?:\[\*\])*$", 1)
    return counted.select(
        "table",
        "column",
        "path",
        "n_leaves",
        matches.alias("match_count"),
        _dominant().alias("detected_type"),
        name_pii_type(last).alias("suggested_type"),
        mask_sample("first_value").alias("sample"),
    )
