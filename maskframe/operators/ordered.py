"""Operators over time order: idle sessions, health state, rate limit.

Each is written so that one key with a third of all rows is not one task: rows
are combined per time bucket first, or a key's rows are cut into time blocks
and only one short summary row per block is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskframe.operators.ranks import placed, ranked

#: Up to so many rows a group Spark limits a ranking before its shuffle.
LIMITED = 1000


def _bucket(ts: str, size: str) -> Column:
    return F.window(F.col(ts), size)["start"]


def idle_sessions(
    df: DataFrame, key: str, ts: str = "ts", gap_seconds: int = 300
) -> DataFrame:
    """Sessions of a key: a pause of ``gap_seconds`` or more ends one.

    Two rows in one bucket as wide as the gap are always closer than the gap,
    so each bucket becomes one row before anything is put in order; what is
    ordered per key is at most one row per bucket.
    """
    buckets = df.groupBy(key, _bucket(ts, f"{gap_seconds} seconds").alias("__b")).agg(
        F.min(ts).alias("__a"), F.max(ts).alias("__z"), F.count(F.lit(1)).alias("__n")
    )
    by_time = Window.partitionBy(key).orderBy("__a")
    gap = F.make_dt_interval(secs=F.lit(gap_seconds))
    fresh = F.col("__a") >= F.lag("__z").over(by_time) + gap
    return (
        buckets.withColumn("__fresh", F.coalesce(fresh, F.lit(True)).cast("bigint"))
        .withColumn("__session", F.sum("__fresh").over(by_time))
        .groupBy(key, "__session")
        .agg(
            F.min("__a").alias("start"),
            F.max("__z").alias("last_seen"),
            F.sum("__n").alias("n_events"),
        )
        .select(
            key, "start", "last_seen", (F.col("last_seen") + gap).alias("end"), "n_events"
        )
    )


def rate_flag(
    df: DataFrame, key: str, n: int, id: str, ts: str = "ts", per: str = "1 second"
) -> DataFrame:
    """Mark rows beyond the first ``n`` of a key in each period as rejected.

    Periods are aligned to the clock; ``token_bucket`` has them begin with a row.  The
    first ``n`` rows are found by a ranking with a limit, of which every task sends
    at most ``n`` rows per group, or, for limits that Spark does not apply early, by
    their places in ranges of the order; the other rows are recognised by their
    absence, joined on the unique ``id``, so no group is ever brought together whole.
    """
    rows = df.select(
        F.struct(F.col(key)).alias("__k"),
        _bucket(ts, per).alias("__p"),
        F.col(ts).alias("__t"),
        F.col(id).alias("__id"),
    )
    if n <= LIMITED:
        order = Window.partitionBy("__k", "__p").orderBy("__t", "__id")
        numbered = rows.withColumn("__rank", F.row_number().over(order))
    else:
        numbered = ranked(rows, ["__k", "__p"], ["__t", "__id"], "__rank")
    accepted = numbered.where(F.col("__rank") <= n).select(
        F.col("__id").alias(id), F.lit(True).alias("__ok")
    )
    return df.join(accepted, id, "left").select(
        *df.columns, F.col("__ok").isNull().alias("rejected")
    )


def rate_counts(df: DataFrame, key: str, n: int, ts: str = "ts", per: str = "1 second"):
    """Accepted and rejected rows per key and period; works on streams too."""
    total = F.col("n")
    return (
        df.groupBy(F.window(ts, per).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            key,
            F.col("w.start").alias("start"),
            F.least(total, F.lit(n).cast("bigint")).alias("accepted"),
            F.greatest(total - n, F.lit(0).cast("bigint")).alias("rejected"),
        )
    )


_STATE = ("healthy", "consecutive_failures", "consecutive_successes")


def health_state(
    df: DataFrame,
    key: str,
    ok: str,
    id: str,
    ts: str = "ts",
    bad: int = 3,
    good: int = 1,
    block: str | None = None,
    state: DataFrame | None = None,
) -> DataFrame:
    """State after every probe: ``bad`` failures in a row make a key unhealthy,
    ``good`` successes in a row make it healthy, and it starts healthy.

    A key's probes are cut into blocks: ranges of the order by key, time and id, which
    a burst of one key cannot overfill, or, with ``block``, spans of time.  Streaks
    inside a block are exact but for the block's first streak, which may go on from
    earlier blocks; one summary row per block is enough to carry streaks and state
    over, and is joined back.  ``state`` continues from earlier results: one row per key
    with the three state columns.
    """
    by_time = Window.partitionBy(key, "__block").orderBy(ts, id)
    up = F.col(ok)
    pos = F.row_number().over(by_time)
    cut = placed(df, [key, ts, id], "__block") if block is None else df.withColumn("__block", _bucket(ts, block))
    rows = (
        cut.withColumn("__pos", pos.cast("bigint"))
        .withColumn("__ok_at", F.last(F.when(up, F.col("__pos")), True).over(by_time))
        .withColumn("__bad_at", F.last(F.when(~up, F.col("__pos")), True).over(by_time))
    )
    at = F.col("__pos")
    ok_at, bad_at = F.col("__ok_at"), F.col("__bad_at")
    first_streak = ok_at.isNull() | bad_at.isNull()
    flips_down = ~first_streak & (at - F.coalesce(ok_at, F.lit(0)) >= bad)
    flips_up = ~first_streak & (at - F.coalesce(bad_at, F.lit(0)) >= good)
    blocks = rows.groupBy(key, "__block").agg(
        F.count(F.lit(1)).alias("__n"),
        F.max("__ok_at").alias("__last_ok"),
        F.max("__bad_at").alias("__last_bad"),
        F.max(F.when(at == 1, up)).alias("__first_ok"),
        F.count(F.when(first_streak, F.lit(1))).alias("__lead"),
        # The last change after the first streak; even positions of this code
        # are changes to unhealthy, odd ones to healthy.
        F.max(F.when(flips_up, at * 2 + 1).when(flips_down, at * 2)).alias("__flip"),
    )
    past = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    if state is None:
        seeded = blocks.withColumns(
            {
                "__h0": F.lit(True),
                "__f0": F.lit(0).cast("bigint"),
                "__s0": F.lit(0).cast("bigint"),
            }
        )
    else:
        known = state.select(
            key,
            F.col("healthy").alias("__h0"),
            F.col("consecutive_failures").alias("__f0"),
            F.col("consecutive_successes").alias("__s0"),
        )
        seeded = blocks.join(known, key, "left").na.fill(
            {"__h0": True, "__f0": 0, "__s0": 0}
        )
    n_before = F.coalesce(F.sum("__n").over(past), F.lit(0))
    counted = seeded.withColumn("__before", n_before)
    before = F.col("__before")
    ok_before = F.max(before + F.col("__last_ok")).over(past)
    bad_before = F.max(before + F.col("__last_bad")).over(past)
    carried = counted.withColumn(
        "__fails", before - F.coalesce(ok_before, -F.col("__f0"))
    ).withColumn("__oks", before - F.coalesce(bad_before, -F.col("__s0")))
    lead_flip = F.when(
        F.col("__first_ok") & (F.col("__oks") + F.col("__lead") >= good), F.lit(True)
    ).when(~F.col("__first_ok") & (F.col("__fails") + F.col("__lead") >= bad), F.lit(False))
    block_flip = F.coalesce(F.col("__flip") % 2 == 1, lead_flip)
    summary = (
        carried.withColumn("__block_flip", block_flip)
        .withColumn(
            "__was", F.coalesce(F.last("__block_flip", True).over(past), F.col("__h0"))
        )
        .select(key, "__block", "__fails", "__oks", "__was")
    )
    zero = F.lit(0).cast("bigint")
    fails = F.when(up, zero).otherwise(at - F.coalesce(ok_at, -F.col("__fails")))
    oks = F.when(~up, zero).otherwise(at - F.coalesce(bad_at, -F.col("__oks")))
    turn = F.when(F.col("consecutive_failures") >= bad, F.lit(False)).when(
        F.col("consecutive_successes") >= good, F.lit(True)
    )
    return (
        rows.join(summary, [key, "__block"])
        .withColumn("consecutive_failures", fails)
        .withColumn("consecutive_successes", oks)
        .withColumn("__turn", turn)
        .withColumn(
            "healthy", F.coalesce(F.last("__turn", True).over(by_time), F.col("__was"))
        )
        .select(
            *df.columns,
            "healthy",
            F.when(F.col("healthy"), F.lit("ok")).otherwise("degraded").alias("status"),
            "consecutive_failures",
            "consecutive_successes",
        )
    )


def health_report(
    states: DataFrame, key: str, id: str, ts: str = "ts", extra: tuple[str, ...] = ()
) -> DataFrame:
    """Last state per key, with the values of ``extra`` at that time.

    Combined in every map task before the shuffle.
    """
    names = (*_STATE, "status", *extra)
    newest = F.max(F.struct(F.col(ts).alias("t"), F.col(id).alias("i"), *names)).alias("m")
    return states.groupBy(key).agg(newest).select(
        key, F.col("m.t").alias("last_check"), *[F.col(f"m.{n}").alias(n) for n in names]
    )
