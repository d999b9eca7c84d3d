"""Discovery: which columns of which tables hold personal data?

A table is read once.  Its cells are classified in a projection and counted by
column before anything is shuffled, so every task sends one small row per column
and no group can grow hot, whatever the values are.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.functions import patterns as P
from maskframe.functions.detect import is_scannable, name_pii_type, pii_type_sql
from maskframe.functions.partial import mask_sample
from maskframe.functions.sqltext import lit, quote
from maskframe.operators.ordered import LIMITED
from maskframe.operators.ranks import ranked
from maskframe.sources.tables import sample_fraction, sample_rows, visible


@dataclass(frozen=True)
class ScanConfig:
    """What to read and what to report; whole tables unless a sample is asked for.

    ``sample_size`` is a number of rows per table, ``fraction`` a share of each, ``bottom_k`` a
    number of rows that are the same however a table is partitioned.  ``order_by`` names, per
    table, the column that says which row is the first; without it the sample
    shown is the smallest matching value.
    """

    sample_size: int | None = None
    exclude_tables: tuple[str, ...] = ()
    confidence_threshold: float = 0.5
    fraction: float | None = None
    order_by: dict[str, str] = field(default_factory=dict)
    hide_system: bool = False
    bottom_k: int | None = None


def _count_name(t: str) -> str:
    return f"n_{P.TYPE_STRATEGY[t]}"


COUNT_NAMES = tuple(_count_name(t) for t in P.PII_TYPES)


# Cells are counted by the number of their column; its names come in one row for each.
_NAMES = ("table", "column", "data_type")
_NO_NAMES = tuple(f"CAST(NULL AS STRING) AS `{c}`" for c in _NAMES)


def _typed_cells(df: DataFrame, fields: list, first: int, order: str | None) -> DataFrame:
    """A row for each cell: number of its column, text, type, place in the order.

    The classifier is written once for the whole table, however wide it is.
    """
    place = f", 'o', {quote(order)}" if order else ""
    cells = ", ".join(
        f"named_struct('k', {first + i}, 'v', CAST({quote(f.name)} AS STRING){place})"
        for i, f in enumerate(fields)
    )
    return _classified(df.selectExpr(f"inline(array({cells}))"), ["k", "v", *(["o"] if order else [])])


def _classified(cells: DataFrame, kept: list[str]) -> DataFrame:
    return cells.selectExpr(*kept, f"trim(BOTH {lit(P.WS_CHARS)} FROM v) AS w").selectExpr(
        *kept, f"{pii_type_sql('w')} AS t", "1 AS n", *_NO_NAMES
    )


def bottom_k(tables: list[tuple[int, DataFrame, list]], n: int) -> DataFrame:
    """``first``, ``cells``: the ``n`` rows of each table whose hashes over all columns are the smallest.

    ``tables`` are (number of the first column, rows, fields whose text is wanted).  The
    sample depends on a table's rows alone, not on their order or partitions; of equal
    rows any is as good as another.  All tables go through one exchange: every task sends
    its own smallest rows of each table, if Spark can limit the ranking before it
    (up to 1,000 rows), and else the rows meet by places in ranges of the hashes.
    """

    def hashed(c: T.StructField) -> Column:
        v = F.col(quote(c.name))
        nested = isinstance(c.dataType, (T.MapType, T.VariantType)) or "map<" in c.dataType.simpleString()
        return F.to_json(v) if nested else v

    parts = []
    for first, df, fields in tables:
        every = [hashed(c) for c in df.schema.fields]
        parts.append(
            df.select(
                F.lit(first).alias("first"),
                F.xxhash64(*every).alias("h"),
                F.xxhash64(F.lit(1), *every).alias("i"),
                F.array(*[F.col(quote(f.name)).cast("string") for f in fields]).alias("cells"),
            )
        )
    rows = reduce(DataFrame.unionByName, parts)
    if n <= LIMITED:
        rank = F.row_number().over(Window.partitionBy("first").orderBy("h", "i"))
        ranks = rows.withColumn("rank", rank)
    else:
        ranks = ranked(rows, ["first"], ["h", "i"])
    return ranks.where(F.col("rank") <= n).select("first", "cells")


def _drawn_cells(rows: DataFrame) -> DataFrame:
    found = rows.select("first", F.posexplode("cells").alias("at", "v"))
    return found.select((F.col("first") + F.col("at")).alias("k"), "v")


def _counted(cells: DataFrame, ordered: bool) -> DataFrame:
    """Counts per column; every task sends one row for each of its columns."""
    hit = "CASE WHEN t IS NOT NULL THEN {} END"
    first = f"min_by(v, {hit.format('o')})" if ordered else f"min({hit.format('v')})"
    # The names are collected from the one row that has them.  A collecting aggregate also
    # keeps Spark from sorting all cells by column, as it does for a smallest text alone.
    names = F.collect_list(F.when(F.col("n") == 0, F.struct(*_NAMES)))
    counts = cells.groupBy("k").agg(
        names.alias("names"),
        F.sum("n").alias("row_count"),
        *[
            F.count(F.when(F.col("t") == t, F.lit(1))).alias(_count_name(t))
            for t in P.PII_TYPES
        ],
        F.expr(first).alias("first_value"),
    )
    return counts.select("*", *[F.col("names")[0][c].alias(c) for c in _NAMES])


def _dominant() -> Column:
    """Most frequent type; ties go to the type that is tried first."""
    top = F.greatest(*COUNT_NAMES)
    out = None
    for t in P.PII_TYPES:
        hit = (F.col(_count_name(t)) == top) & (top > 0)
        out = F.when(hit, F.lit(t)) if out is None else out.when(hit, F.lit(t))
    return out


def profile(tables: dict[str, DataFrame], cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """Per text column: rows, matches, matches per type, dominant type, sample.

    Nulls and blanks count as rows.  All tables go through one exchange (one for
    each type of ``order_by`` columns).
    """
    columns, cells, drawn = [], {}, []
    for name, df in visible(tables, cfg.exclude_tables, cfg.hide_system).items():
        fields = [f for f in df.schema.fields if is_scannable(f.dataType)]
        if not fields:
            continue
        if cfg.bottom_k is not None:
            drawn.append((len(columns), df, fields))
            columns += [(name, f.name, f.dataType.simpleString(), None) for f in fields]
            continue
        order = cfg.order_by.get(name)
        used = [quote(f.name) for f in fields]
        if order and order not in [f.name for f in fields]:
            used.append(quote(order))
        data = df.select(*used)
        if cfg.fraction is not None:
            data = sample_fraction(data, cfg.fraction)
        else:
            data = sample_rows(data, cfg.sample_size, order)
        kind = df.schema[order].dataType.simpleString() if order else None
        part = _typed_cells(data, fields, len(columns), order)
        cells.setdefault(kind, []).append(part)
        columns += [(name, f.name, f.dataType.simpleString(), kind) for f in fields]
    if not columns:
        raise ValueError("no text column to scan")
    if drawn:
        cells[None] = [_classified(_drawn_cells(bottom_k(drawn, cfg.bottom_k)), ["k", "v"])]
    spark = next(iter(tables.values())).sparkSession
    numbered = spark.createDataFrame(
        [(k, *c) for k, c in enumerate(columns)],
        "k int, table string, column string, data_type string, kind string",
    )
    counted = []
    for kind, parts in cells.items():
        # A row for each column that counts nothing and has its names, so that empty
        # tables are listed and no join with the names is needed.
        empty = numbered.where(F.col("kind").eqNullSafe(F.lit(kind))).selectExpr(
            "k",
            "CAST(NULL AS STRING) AS v",
            *([f"CAST(NULL AS {kind}) AS o"] if kind else []),
            "CAST(NULL AS STRING) AS t",
            "0 AS n",
            "`table`",
            "`column`",
            "data_type",
        )
        counted.append(_counted(reduce(DataFrame.unionByName, [*parts, empty]), kind is not None))
    long = reduce(DataFrame.unionByName, counted)
    matches = reduce(lambda a, b: a + b, [F.col(n) for n in COUNT_NAMES])
    return long.select(
        "table",
        "column",
        "data_type",
        "row_count",
        matches.alias("match_count"),
        *COUNT_NAMES,
        _dominant().alias("detected_type"),
        mask_sample("first_value").alias("sample"),
    )


def findings(profiled: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Score a profile: data, column name and both together."""
    share = F.when(
        F.col("row_count") > 0, F.col("match_count") / F.col("row_count")
    ).otherwise(F.lit(0.0))
    data, name, c = F.col("detected_type"), F.col("__name"), F.col("__share")
    # A column name without matches counts only while its share is below the threshold.
    by_name = name.isNotNull() & data.isNull() & (c < threshold)
    confidence = (
        F.when(name.isNull(), c)
        .when(data.isNotNull() & (name == data), F.least(c + 0.3, F.lit(1.0)))
        .when(data.isNotNull(), c * 0.8)
        .when(by_name, F.lit(0.6))
        .otherwise(c)
    )
    return (
        profiled.withColumn("__name", name_pii_type("column"))
        .withColumn("__share", share)
        .withColumn("__confidence", confidence)
        .withColumn("pii_type", F.when(by_name, name).otherwise(data))
        .where(F.col("pii_type").isNotNull() & (F.col("__confidence") >= threshold))
        .select(
            "table",
            "column",
            "pii_type",
            (F.round(F.col("__confidence") * 100) / 100).alias("confidence"),
            "sample",
            "row_count",
            "match_count",
            "data_type",
        )
    )


def scan(tables: dict[str, DataFrame], cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """Findings over a set of tables."""
    return findings(profile(tables, cfg), cfg.confidence_threshold)


def scan_summary(
    tables: dict[str, DataFrame],
    cfg: ScanConfig = ScanConfig(),
    found: DataFrame | None = None,
) -> DataFrame:
    """One row: status, tables scanned and hidden, columns scanned, findings.

    All columns of a scanned table count, also those of other types.
    """
    chosen = visible(tables, cfg.exclude_tables, cfg.hide_system)
    hidden = len(visible(tables, cfg.exclude_tables)) - len(chosen)
    n_columns = sum(len(df.columns) for df in chosen.values())
    found = scan(tables, cfg) if found is None else found
    return found.agg(F.count(F.lit(1)).alias("findings")).select(
        F.lit("completed").alias("status"),
        F.lit(len(chosen)).cast("bigint").alias("tables_scanned"),
        F.lit(hidden).cast("bigint").alias("tables_hidden"),
        F.lit(n_columns).cast("bigint").alias("columns_scanned"),
        "findings",
    )


def type_breakdown(
    tables: dict[str, DataFrame], cfg: ScanConfig = ScanConfig()
) -> DataFrame:
    """Matches per type for every column that has any."""
    return (
        profile(tables, cfg)
        .where(F.col("match_count") > 0)
        .select("table", "column", *COUNT_NAMES, "match_count")
    )
