"""Retention of an audit log that is stored by day.

A log keeps its newest rows.  Rows per day say at which day the log is cut: older days
are dropped as whole folders, only the day of the cut is written again, and the files
of all newer days stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.operators.ranks import ranked
from maskframe.sources.sinks import AUDIT_JSON, staged

#: The folder of rows without a time.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


@dataclass
class Retained:
    """What a cut did: rows that are left, days that went, and the day that was written again."""

    rows: int
    dropped: list[date | None] = field(default_factory=list)
    rewritten: date | None = None


def read_log(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "json") -> DataFrame:
    """A log stored by day, with its ``day``."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    days = T.StructType([*schema.fields, T.StructField("day", T.DateType())])
    return spark.read.schema(days).format(fmt).load(path)


def retain_days(spark: SparkSession, path: str, n: int, schema: T.StructType | str, fmt: str = "json") -> Retained:
    """Keep the newest ``n`` rows of a log that ``write_audit(by_day=True)`` wrote.

    Newest is by ``timestamp``, then ``id``; rows without a time are the oldest.  The day of
    the cut is written anew first and replaces only its own folder, then older folders go:
    a run that fails in between leaves rows too many, never too few, and can be repeated.
    What comes to the driver is one number for each day.
    """
    log = read_log(spark, path, schema, fmt)
    counts = {r["day"]: r["count"] for r in log.groupBy("day").count().collect()}
    days = sorted((d for d in counts if d is not None), reverse=True) + [None] * (None in counts)
    done = Retained(0)
    cut = None
    for day in days:
        left = n - done.rows
        if left <= 0:
            done.dropped.append(day)
        elif counts[day] > left:
            cut, done.rows = (day, left), n
        else:
            done.rows += counts[day]
    if cut is not None:
        day, left = cut
        part = log.where(F.col("day").eqNullSafe(F.lit(day).cast("date")))
        numbered = ranked(part.withColumn("__day", F.lit(0)), ["__day"], ["timestamp", "id"], "__rank")
        kept = staged(numbered.where(F.col("__rank") > counts[day] - left).drop("__rank", "__day"), "kept-day")
        writer = kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        options = AUDIT_JSON if fmt == "json" else {}
        writer.options(**options).partitionBy("day").format(fmt).save(path)
        done.rewritten = day
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for day in done.dropped:
        name = NO_DAY if day is None else day.isoformat()
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/day={name}"), True)
    return done
