"""Token bucket: a key's bucket is filled by the first row that comes a period or more after the last fill.

Fills follow each other: which row fills depends on the fill before it.  Every time of
a key knows the time that would fill next if it filled itself, the first one a period
later; the times that do fill are those that the key's first time leads to.  They are
found by pointer doubling: jumps of 1, 2, 4, … fills are joins on (key, time), and the
jumps are then taken from the longest down.  The number of rounds is the logarithm of
the longest chain.  No key is ever brought together: times meet by (key, time) or by
(key, clock period), of which a period has at most as many as it has microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.operators.ordered import LIMITED
from maskframe.operators.ranks import ranked
from maskframe.operators.stats import step_micros
from maskframe.sources.sinks import staged

#: Clock periods in a block, when the next period that has rows is looked for.
BLOCK = 4096


def _micros(df: DataFrame, ts: str) -> Column:
    plain = isinstance(df.schema[ts].dataType, T.TimestampNTZType)
    origin = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{0}`)"
    return F.expr((origin if plain else "unix_micros(`{0}`)").format(ts))


def _later(times: DataFrame) -> DataFrame:
    """``k``, ``p``, ``later``: the key's first time in the clock periods behind ``p``, for each ``p`` that has rows or follows one.

    Two levels: inside a block of periods, and over the blocks.
    """
    asked = times.select("k", (F.col("p") + 1).alias("p"), F.lit(None).cast("long").alias("t"))
    periods = times.select("k", "p", "t").unionByName(asked).groupBy("k", "p").agg(F.min("t").alias("low"))
    periods = periods.withColumn("b", F.expr(f"(p - pmod(p, {BLOCK})) div {BLOCK}"))

    def behind(by: list[str], order: str) -> Column:
        back = Window.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
        return F.last("low", True).over(back)

    blocks = periods.groupBy("k", "b").agg(F.min("low").alias("low"))
    blocks = blocks.select("k", "b", behind(["k"], "b").alias("beyond"))
    near = periods.withColumn("near", behind(["k", "b"], "p"))
    return near.join(blocks, ["k", "b"]).select("k", "p", F.coalesce("near", "beyond").alias("later"))


def next_fills(times: DataFrame, size: int) -> DataFrame:
    """``k``, ``t``, ``n``: the key's first time that is ``size`` or more behind ``t``, where there is one.

    ``times`` has different times ``t`` of every ``k`` and their clock period ``p``.  The time
    looked for lies in the period after ``p``, or it is the first of the periods behind that.
    """
    asks = times.select("k", (F.col("p") + 1).alias("p"), F.col("t").alias("asker"), (F.col("t") + size).alias("at"))
    both = times.select("k", "p", F.lit(None).cast("long").alias("asker"), F.col("t").alias("at")).unionByName(asks)
    # From the period's end back; at equal times the row stands before the question it answers.
    back = Window.partitionBy("k", "p").orderBy(F.desc("at"), F.col("asker").isNotNull())
    seen = F.last(F.when(F.col("asker").isNull(), F.col("at")), True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("n", seen).where("asker is not null")
    found = found.join(_later(times), ["k", "p"], "left")
    return found.select("k", F.col("asker").alias("t"), F.coalesce("n", "later").alias("n")).where("n is not null")


def fills(times: DataFrame, size: int) -> DataFrame:
    """``k``, ``t`` of the times that fill: each key's first, and from each the next one ``size`` or more later."""
    jumps = [staged(next_fills(times, size), "fills")]
    while True:
        one, two = jumps[-1], jumps[-1].select("k", F.col("t").alias("n"), F.col("n").alias("m"))
        longer = staged(one.join(two, ["k", "n"]).select("k", "t", F.col("m").alias("n")), "fills")
        if longer.isEmpty():
            break
        jumps.append(longer)
    reached = times.groupBy("k").agg(F.min("t").alias("t"))
    for jump in reversed(jumps):
        reached = staged(reached.unionByName(reached.join(jump, ["k", "t"]).select("k", F.col("n").alias("t"))), "filled")
    return reached


def token_bucket(df: DataFrame, key: str, n: int, id: str, ts: str = "ts", per: str = "1 second") -> DataFrame:
    """Mark the rows that find a key's bucket empty as ``rejected``.

    A bucket holds ``n`` tokens, a row takes one if there is one, and the first row that
    comes ``per`` or more after the last fill fills the bucket first; the first row of a key
    does.  Rows of one time are taken in the order of the unique ``id``.  Null keys are one
    key; a row without a time takes no token and has a null.
    """
    size = step_micros(per)
    # Null keys are equal inside a struct.
    rows = df.select(F.struct(F.col(key)).alias("k"), _micros(df, ts).alias("t"), F.col(id).alias("id")).where("t is not null")
    rows = rows.withColumn("p", F.expr(f"(t - pmod(t, {size})) div {size}"))
    times = staged(rows.select("k", "t", "p").distinct(), "times")
    filled = fills(times, size).select("k", F.col("t").alias("fill"))
    # A row is less than a period behind its fill, so its clock period is the fill's or the next one.
    first = F.expr(f"(fill - pmod(fill, {size})) div {size}")
    filled = filled.select("k", "fill", F.explode(F.array(first, first + 1)).alias("p"))
    since = rows.join(filled, ["k", "p"]).where((F.col("fill") <= F.col("t")) & (F.col("t") < F.col("fill") + size))
    since = since.select("k", "fill", "t", "id")
    if n <= LIMITED:
        order = Window.partitionBy("k", "fill").orderBy("t", "id")
        numbered = since.withColumn("rank", F.row_number().over(order))
    else:
        numbered = ranked(since, ["k", "fill"], ["t", "id"])
    accepted = numbered.where(F.col("rank") <= n).select(F.col("id").alias(id), F.lit(True).alias("__ok"))
    rejected = F.when(F.col(ts).isNotNull(), F.col("__ok").isNull())
    return df.join(accepted, id, "left").select(*df.columns, rejected.alias("rejected"))
