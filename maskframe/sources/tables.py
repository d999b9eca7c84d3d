"""Tables to scan: reading, sampling, text form and the column catalog."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("table", T.StringType(), False),
        T.StructField("column", T.StringType(), False),
        T.StructField("data_type", T.StringType(), False),
        T.StructField("is_nullable", T.BooleanType(), False),
        T.StructField("max_length", T.IntegerType(), True),
        T.StructField("ordinal", T.IntegerType(), False),
    ]
)


def read_tables(
    spark: SparkSession, source: str, names: list[str], fmt: str = "parquet", **options
) -> dict[str, DataFrame]:
    """Tables by name.

    ``fmt`` is a file format (``source`` is a folder with one ``name.fmt`` or
    ``name`` entry per table), ``table`` (``source`` is a catalog schema) or
    ``jdbc`` (``source`` is the URL; pass what ``jdbc_plan`` gives so that the read is
    not one task, or read a table by ``spark.read.jdbc`` with ``jdbc_predicates``).
    """
    if fmt == "table":
        return {n: spark.table(f"{source}.{n}") for n in names}
    if fmt == "jdbc":
        reader = spark.read.format("jdbc").options(url=source, **options)
        return {n: reader.option("dbtable", n).load() for n in names}
    reader = spark.read.format(fmt).options(**options)
    return {n: reader.load(_entry(spark, source, n, fmt)) for n in names}


def jdbc_predicates(column: str, cuts: list) -> list[str]:
    """Conditions that deal the rows of a database table to tasks: every row meets exactly one.

    ``cuts`` are rising values of ``column``, such as its quantiles, which follow skewed
    keys where equal steps between the extremes do not.  Rows below the first cut,
    above the last and without a value are in; equal cuts count once.
    """

    def text(v) -> str:
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return str(v)
        return "'" + str(v).replace("'", "''") + "'"

    edges = sorted(set(cuts))
    if not edges:
        return ["1 = 1"]
    between = [f"{column} >= {text(a)} AND {column} < {text(b)}" for a, b in zip(edges, edges[1:])]
    return [f"{column} < {text(edges[0])} OR {column} IS NULL", *between, f"{column} >= {text(edges[-1])}"]


def jdbc_plan(rows: int, low: int, high: int, column: str, rows_per_task: int = 500_000, most: int = 256) -> dict[str, str]:
    """Reader options that deal a table of about ``rows`` rows by an evenly filled number column.

    As many tasks as ``rows_per_task`` asks for, at most one for each value and at most
    ``most``, which is also the number of connections the database sees at once.
    """
    if high < low:
        raise ValueError(f"bounds {low} and {high}")
    wanted = max(1, -(-rows // rows_per_task))
    parts = min(wanted, most, high - low + 1)
    return {
        "partitionColumn": column,
        "lowerBound": str(low),
        "upperBound": str(high + 1),
        "numPartitions": str(parts),
    }


def _entry(spark: SparkSession, source: str, name: str, fmt: str) -> str:
    """``name.fmt`` if the folder has it, else ``name``, on any file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{source}/{name}.{fmt}")
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return f"{source}/{name}.{fmt}" if fs.exists(path) else f"{source}/{name}"


def sample_rows(df: DataFrame, n: int | None, order_by: str | None = None) -> DataFrame:
    """``n`` rows in no order, or the first by ``order_by``; all rows for None.

    Always lazy: nothing is read until the result is.
    """
    if n is None:
        return df
    if order_by is not None:
        return df.orderBy(order_by).limit(n)
    return df.limit(n)


def sample_fraction(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """A repeatable share of the rows, drawn in every partition."""
    return df.sample(fraction=fraction, seed=seed)


def stringify(df: DataFrame) -> DataFrame:
    """Every atomic column as text; nested columns as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)

    def text(f: T.StructField) -> Column:
        c = df[f"`{f.name}`"]
        c = F.to_json(c) if isinstance(f.dataType, nested) else c.cast("string")
        return c.alias(f.name)

    return df.select(*[text(f) for f in df.schema.fields])


def _is_system(name: str) -> bool:
    """LIKE 'pg_%' or 'sql_%': the underscore stands for any one character."""
    return re.match(r"(?s)(?:pg|sql).", name) is not None


def visible(
    tables: dict[str, DataFrame], exclude=(), hide_system: bool = False
) -> dict[str, DataFrame]:
    """Tables that are not excluded, by name.

    ``hide_system`` is for PostgreSQL catalogs, whose own tables go by name; in
    any other catalog such a name is a user's.
    """
    return {
        n: tables[n]
        for n in sorted(tables)
        if n not in exclude and not (hide_system and _is_system(n))
    }


def columns_df(
    spark: SparkSession, tables: dict[str, DataFrame], hide_system: bool = False
) -> DataFrame:
    """Catalog of columns, ordered by table and position.

    This is metadata: its size is the number of columns, not of rows.
    """
    rows = [
        (
            name,
            f.name,
            f.dataType.simpleString(),
            f.nullable,
            getattr(f.dataType, "length", None),
            i,
        )
        for name, df in visible(tables, hide_system=hide_system).items()
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA).orderBy("table", "ordinal")


def row_counts(tables: dict[str, DataFrame], hide_system: bool = False) -> DataFrame:
    """Exact rows per table; reads no column."""
    out = None
    for name, df in visible(tables, hide_system=hide_system).items():
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table"), "row_count"
        )
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no tables")
    return out


def footer_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Exact rows per Parquet table, from the footers of its files.

    The count is pushed into the reader, which opens no row group, and all tables are
    counted in one job.  Spark pushes aggregates into its newer file reader only, so the
    count runs in a session of its own with that reader; one row per table comes back.
    """
    plan = footer_plan(spark, paths)
    schema = "`table` string, row_count long"
    return spark.createDataFrame([tuple(r) for r in plan.collect()], schema)


def footer_plan(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The counting query itself, in its own session."""
    if not paths:
        raise ValueError("no tables")
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    out = None
    for name, path in sorted(paths.items()):
        one = own.read.parquet(path).agg(F.count("*").alias("row_count"))
        one = one.select(F.lit(name).alias("table"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def known_counts(spark: SparkSession, names: list[str]) -> DataFrame:
    """Rows per catalog table: from fresh statistics, and counted where there are none.

    Statistics are fresh if the size they name is the size of the table's files now.
    """
    rows, stale = [], []
    for name in names:
        found = _statistics(spark, name)
        if found is not None and found[0] == _size(spark, name):
            rows.append((name, found[1]))
        else:
            stale.append(name)
    known = spark.createDataFrame(rows, "`table` string, row_count long")
    if not stale:
        return known
    return known.unionByName(row_counts({n: spark.table(n) for n in stale}))


def _described(spark: SparkSession, table: str, what: str) -> str | None:
    found = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where(F.col("col_name") == what).first()
    return found["data_type"] if found else None


def _statistics(spark: SparkSession, table: str) -> tuple[int, int] | None:
    """Bytes and rows that the catalog has for a table."""
    text = _described(spark, table, "Statistics") or ""
    found = re.search(r"(\d+) bytes, (\d+) rows", text)
    return (int(found.group(1)), int(found.group(2))) if found else None


def _size(spark: SparkSession, table: str) -> int | None:
    """Bytes of a table's visible files."""
    where = _described(spark, table, "Location")
    if where is None:
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listFiles(path, True)
    total = 0
    while files.hasNext():
        status = files.next()
        if not status.getPath().getName().startswith(("_", ".")):
            total += status.getLen()
    return total


def catalog_row_count(spark: SparkSession, table: str) -> int | None:
    """Row count in the catalog's statistics, or None if there is none."""
    found = _statistics(spark, table)
    return found[1] if found else None


def schema_report(
    tables: dict[str, DataFrame], exclude=(), hide_system: bool = False, counts: DataFrame | None = None
) -> DataFrame:
    """Per table: its columns and its row count, sorted by name.

    ``counts`` (``table``, ``row_count``) are counts that are known already, from footers or
    statistics; then no table is read.
    """
    chosen = visible(tables, exclude, hide_system)
    if counts is not None and chosen:
        spark = next(iter(chosen.values())).sparkSession
        listed = [
            (n, [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields])
            for n, df in chosen.items()
        ]
        kind = "`table` string, columns array<struct<`column`: string, data_type: string, is_nullable: boolean>>"
        return spark.createDataFrame(listed, kind).join(counts, "table", "left").orderBy("table")
    out = None
    for name, df in chosen.items():
        columns = F.array(
            *[
                F.struct(
                    F.lit(f.name).alias("column"),
                    F.lit(f.dataType.simpleString()).alias("data_type"),
                    F.lit(f.nullable).alias("is_nullable"),
                )
                for f in df.schema.fields
            ]
        )
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table"), columns.alias("columns"), "row_count"
        )
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no tables")
    return out.orderBy("table")
