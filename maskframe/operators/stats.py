"""Counters, shares and time series over statements, logs and sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.functions import patterns as P
from maskframe.operators.mask import masking_counters_wide

# Statement kinds with a counter of their own.
STATEMENT_KINDS = ("SELECT", "INSERT", "UPDATE", "DELETE")


def statements(df: DataFrame, ts: str, connection: str, text: str) -> DataFrame:
    """A query log as ``(ts, connection_id, statement)``."""
    return df.select(
        F.col(ts).alias("ts"),
        F.col(connection).alias("connection_id"),
        F.col(text).alias("statement"),
    )


def statement_type(c: Column) -> Column:
    """First word of a statement in upper case; ``OTHER`` if there is none."""
    word = F.regexp_extract(c, rf"^[{P.WS_CLASS}]*+([^{P.WS_CLASS}]+)", 1)
    return F.when(F.coalesce(word, F.lit("")) == "", F.lit("OTHER")).otherwise(F.upper(word))


def statement_bucket(kind: Column) -> Column:
    return F.when(kind.isin(*STATEMENT_KINDS), F.lower(kind)).otherwise("other")


def statement_counters(df: DataFrame, text: str = "statement") -> DataFrame:
    """One row: statements in total and per kind."""
    kind = df.select(statement_bucket(statement_type(F.col(text))).alias("k"))
    names = [k.lower() for k in STATEMENT_KINDS] + ["other"]
    return kind.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count(F.when(F.col("k") == n, F.lit(1))).alias(n) for n in names],
    )


def shares(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Percent of the total, one decimal; zero counts are dropped.

    The total is a scalar over the counters, which are few.
    """
    total = counts.agg(F.sum(n)).scalar()
    percent = F.round(F.col(n) * 1000 / total) / 10
    return counts.where(F.col(n) > 0).select(key, n, percent.alias("percent"))


def tally(
    queries: DataFrame | None = None,
    masked: DataFrame | None = None,
    sessions: DataFrame | None = None,
    ts: str = "ts",
    n_masked: str = "n",
    start: str = "start",
    end: str = "end",
) -> DataFrame:
    """Changes of the three totals as ``(ts, active, queries, masked)`` rows."""

    def row(df: DataFrame, t: str, active=0, n_queries=0, fields=F.lit(0)) -> DataFrame:
        return df.select(
            F.col(t).alias("ts"),
            (F.lit(active) if isinstance(active, int) else active).cast("bigint").alias("active"),
            F.lit(n_queries).cast("bigint").alias("queries"),
            fields.cast("bigint").alias("masked"),
        )

    parts = []
    if queries is not None:
        parts.append(row(queries, ts, n_queries=1))
    if masked is not None:
        parts.append(row(masked, ts, fields=F.col(n_masked)))
    if sessions is not None:
        # Both ends of a session come from one pass; an open one has no end.
        ends = F.inline(
            F.array(
                F.struct(F.col(start).alias("ts"), F.lit(1).alias("d")),
                F.struct(F.col(end).alias("ts"), F.lit(-1).alias("d")),
            )
        )
        both = sessions.select(ends).where(F.col("ts").isNotNull())
        parts.append(row(both, "ts", active=F.col("d")))
    return reduce(DataFrame.unionByName, parts)


# Microseconds of the units that a step may have.
_UNITS = {
    "microsecond": 1,
    "millisecond": 1000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "week": 604_800_000_000,
}
# Steps in a block of the running sum.
_BLOCK = 1000
#: A grid of more steps is refused unless its ends are given: one wrong time makes it endless.
MOST_STEPS = 50_000_000


def step_micros(every: str) -> int:
    """A step such as ``5 seconds`` or ``1 hour 30 minutes`` in microseconds."""
    words = every.lower().split()
    total = 0
    for n, unit in zip(words[::2], words[1::2], strict=True):
        if unit.rstrip("s") not in _UNITS:
            raise ValueError(f"not a fixed length of time: {every!r}")
        total += int(n) * _UNITS[unit.rstrip("s")]
    if total <= 0:
        raise ValueError(f"not a step: {every!r}")
    return total


class _Steps:
    """Steps by number, counted from 1970, for either kind of timestamp."""

    def __init__(self, df: DataFrame, ts: str, every: str) -> None:
        self.size = step_micros(every)
        self.plain = isinstance(df.schema[ts].dataType, T.TimestampNTZType)

    def number_text(self, t: str) -> str:
        origin = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {0})"
        micros = (origin if self.plain else "unix_micros({0})").format(t)
        return f"({micros} - pmod({micros}, {self.size})) div {self.size}"

    def number(self, t: str) -> Column:
        return F.expr(self.number_text(f"`{t}`"))

    def span(self, df: DataFrame, ts: str, start=None, end=None) -> DataFrame:
        """One row: the first and the last step of a grid."""

        def edge(found: Column, given) -> Column:
            if given is None:
                return found
            kind = "timestamp_ntz" if self.plain else "timestamp"
            return F.expr(str(self.number_text(f"CAST('{given}' AS {kind})")))

        first, last = edge(F.min(self.number(ts)), start), edge(F.max(self.number(ts)), end)
        span = df.agg(first.alias("first"), last.alias("last"))
        if start is not None and end is not None:
            return span
        wide = F.col("last") - F.col("first") >= MOST_STEPS
        said = F.concat(F.lit("a grid of "), F.col("last") - F.col("first") + 1, F.lit(" steps: give its start and end"))
        return span.withColumn("last", F.when(wide, F.raise_error(said).cast("long")).otherwise(F.col("last")))

    def end(self, step: str) -> Column:
        """The time at which a step ends."""
        micros = f"({step} + 1) * {self.size}"
        return F.expr(
            f"timestampadd(MICROSECOND, {micros}, TIMESTAMP_NTZ'1970-01-01 00:00:00')"
            if self.plain
            else f"timestamp_micros({micros})"
        )


def cumulative(
    df: DataFrame,
    measures: list[str],
    ts: str = "ts",
    every: str = "5 seconds",
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Running totals at every step of a regular grid, idle steps included.

    The point at time ``t`` holds all changes before ``t``; steps of any fixed
    length are counted from 1970.  Rows are summed per step first, so a step that
    holds a third of all rows is one row.  The running sum then has two levels:
    inside a block of steps, and over the totals of the blocks.

    The grid goes from the step of ``start`` to that of ``end``; without them, from the
    first to the last change, and one of more than MOST_STEPS is an error.  Changes
    before the grid count at its first point, changes behind it do not.
    """
    by = _Steps(df, ts, every)
    sums = [F.sum(m).alias(m) for m in measures]
    span = by.span(df, ts, start, end)
    steps = df.groupBy(by.number(ts).alias("step")).agg(*sums)
    if start is not None:
        steps = steps.groupBy(F.greatest("step", span.select("first").scalar()).alias("step")).agg(*sums)
    # The span is a pass of its own that reads nothing but the time column.
    blocks = span.where("first is not null").select(
        "first", "last", F.explode(F.expr(f"sequence(first div {_BLOCK} - 1, last div {_BLOCK} + 1)")).alias("block")
    )
    inner = f"sequence(block * {_BLOCK}, block * {_BLOCK} + {_BLOCK - 1})"
    grid = (
        blocks.repartition("block")
        .select("block", "first", "last", F.explode(F.expr(inner)).alias("step"))
        .where(F.col("step").between(F.col("first"), F.col("last")))
        .select("block", "step")
    )
    inside = Window.partitionBy("block").orderBy("step")
    within = grid.join(steps, "step", "left").select(
        "block",
        "step",
        *[F.sum(F.coalesce(m, F.lit(0))).over(inside).alias(m) for m in measures],
    )
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        within.groupBy("block")
        .agg(*[F.max_by(m, "step").alias(m) for m in measures])
        .select(
            "block",
            *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"__{m}") for m in measures],
        )
    )
    return within.join(carried, "block").select(
        by.end("step").alias("ts"),
        *[(F.col(m) + F.col(f"__{m}")).alias(m) for m in measures],
    )


def history(
    changes: DataFrame,
    every: str = "5 seconds",
    keep: int | None = 60,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Points of active sessions and total queries and masked fields.

    The newest ``keep`` points, newest first; all points, from ``start`` to ``end`` if
    given, for None.
    """
    measures = ["active", "queries", "masked"]
    points = (
        cumulative(changes, measures, every=every, start=start, end=end)
        if keep is None
        else _newest(changes, measures, every, keep)
    )
    points = points.select(
        "ts",
        F.col("active").alias("active_connections"),
        F.col("queries").alias("total_queries"),
        F.col("masked").alias("total_masked"),
    )
    return points if keep is None else points.orderBy(F.desc("ts")).limit(keep)


def _newest(df: DataFrame, measures: list[str], every: str, keep: int) -> DataFrame:
    """The last ``keep`` points of ``cumulative`` without computing the others.

    All steps before the tail are added to its first one, so at most ``keep``
    groups leave each task and the running sum is over ``keep`` rows.
    """
    by = _Steps(df, "ts", every)
    span = df.agg(F.min(by.number("ts")).alias("first"), F.max(by.number("ts")).alias("last"))
    tail = span.where("first is not null").select(
        F.greatest(F.col("last") - (keep - 1), F.col("first")).alias("first"), "last"
    )
    grid = tail.select(F.explode(F.sequence("first", "last")).alias("step"))
    steps = (
        df.withColumn("step", F.greatest(by.number("ts"), tail.select("first").scalar()))
        .groupBy("step")
        .agg(*[F.sum(m).alias(m) for m in measures])
    )
    order = Window.orderBy("step")
    return grid.join(steps, "step", "left").select(
        by.end("step").alias("ts"),
        *[F.sum(F.coalesce(m, F.lit(0))).over(order).alias(m) for m in measures],
    )


def for_chart(points: DataFrame) -> DataFrame:
    """History points, oldest first."""
    return points.orderBy("ts")


def active(
    df: DataFrame,
    start: str,
    end: str,
    every: str = "5 seconds",
    first: str | None = None,
    last: str | None = None,
) -> DataFrame:
    """Open and opened sessions at every step; an open session has a null end.

    ``start`` and ``end`` are columns; ``first`` and ``last`` are the ends of the grid, as for
    ``cumulative``.
    """
    ends = F.inline(
        F.array(
            F.struct(F.col(start).alias("ts"), F.lit(1).alias("a"), F.lit(1).alias("t")),
            F.struct(F.col(end).alias("ts"), F.lit(-1).alias("a"), F.lit(0).alias("t")),
        )
    )
    changes = (
        df.select(ends)
        .where(F.col("ts").isNotNull())
        .select(
            "ts",
            F.col("a").cast("bigint").alias("active_connections"),
            F.col("t").cast("bigint").alias("total_connections"),
        )
    )
    return cumulative(changes, ["active_connections", "total_connections"], every=every, start=first, end=last)


def latency(df: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean, extremes and approximate quantiles per key.

    All of them merge partial results, so a hot key is no hot task.
    """
    q = F.percentile_approx(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.lit(10000))
    return (
        df.groupBy(by)
        .agg(
            F.count(value).alias("n"),
            F.avg(value).alias("mean"),
            F.min(value).alias("low"),
            F.max(value).alias("high"),
            q.alias("__q"),
        )
        .select(
            by, "n", "mean", "low", "high",
            F.col("__q")[0].alias("p50"),
            F.col("__q")[1].alias("p95"),
            F.col("__q")[2].alias("p99"),
        )
    )


def latency_sketches(
    df: DataFrame, by: str, value: str, ts: str = "ts", every: str = "1 minute", k: int = 400
) -> DataFrame:
    """A quantile sketch (KLL, about ``k`` values a level) of every key and step that has values.

    The sketches are what is stored; a row's value is never needed again.  They are made
    in every map task and merged, so a hot key is no hot task.
    """
    steps = _Steps(df, ts, every)
    values = df.select(F.col(by).alias(by), steps.number(ts).alias("step"), F.col(value).cast("double").alias("v"))
    made = values.where("v is not null").groupBy(by, "step").agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("v", F.lit(k)).alias("sketch")
    )
    return made.select(by, steps.end("step").alias("ts"), "n", "sketch")


def merge_latency(
    sketches: DataFrame,
    by: str,
    quantiles: tuple[float, ...] = (0.5, 0.95, 0.99),
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Quantiles per key over any span of stored sketches; reads nothing but the sketches.

    ``start`` (exclusive) and ``end`` (inclusive) are compared with the ends of the steps.
    """
    if start is not None:
        sketches = sketches.where(F.col("ts") > F.lit(start).cast(sketches.schema["ts"].dataType))
    if end is not None:
        sketches = sketches.where(F.col("ts") <= F.lit(end).cast(sketches.schema["ts"].dataType))
    merged = sketches.groupBy(by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("s"))
    names = [f"p{100 * q:g}".replace(".", "_") for q in quantiles]
    return merged.select(
        by,
        "n",
        *[F.kll_sketch_get_quantile_double("s", F.lit(q)).alias(a) for q, a in zip(quantiles, names)],
    )


def labelled(df: DataFrame, *by: str) -> DataFrame:
    """Rows per label."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def stats(
    sessions: DataFrame,
    log: DataFrame,
    queries: DataFrame,
    points: DataFrame | None = None,
    keep: int = 60,
) -> DataFrame:
    """One row with sessions, masking counters, query counters and history.

    ``sessions`` has ``start`` and ``end``; of ``points``, a ``history`` result, the
    newest ``keep`` go into the row.
    """
    counted = sessions.agg(
        F.count(F.when(F.col("end").isNull(), F.lit(1))).alias("active_connections"),
        F.count(F.lit(1)).alias("total_connections"),
    )
    counters = masking_counters_wide(log).select(F.struct("*").alias("s"))
    kinds = statement_counters(queries).select(F.struct("*").alias("s"))
    out = counted.select(
        "active_connections",
        "total_connections",
        counters.scalar().alias("masking"),
        kinds.scalar().alias("queries"),
    )
    if points is None:
        return out
    points = points.orderBy(F.desc("ts")).limit(keep)
    listed = points.agg(F.sort_array(F.collect_list(F.struct(*points.columns)), False))
    return out.withColumn("history", listed.scalar())
