"""Places of rows in an order, without bringing a group together.

Rows are dealt to ranges of the order and sorted there, and the result is written, so
a row's range never changes.  A group that spans several ranges is known by one small
row for each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskframe.sources.sinks import staged


def placed(df: DataFrame, order: list[str], part: str = "__part", place: str = "__place") -> DataFrame:
    """The rows with the number of their range and their place in it, by ``order``; ranges follow each other."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = staged(sorted_.withColumn(place, F.monotonically_increasing_id()), "placed")
    return numbered.withColumn(part, F.shiftright(place, 33).cast("int")).withColumn(
        place, F.col(place).bitwiseAND((1 << 33) - 1)
    )


def ranked(df: DataFrame, by: list[str], order: list[str], rank: str = "rank") -> DataFrame:
    """Number of each row, from 1, among the rows with equal ``by`` (not null) in the order of ``order``."""
    rows = placed(df, [*by, *order])
    keys = [*by, "__part"]
    parts = rows.groupBy(*keys).agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    place = F.col("__place") - F.col("__first") + F.col("__before") + 1
    return rows.join(parts.drop("__n"), keys).withColumn(rank, place).select(*df.columns, rank)
