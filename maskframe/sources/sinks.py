"""Sinks for masked rows and audit rows, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.operators.mask import mask
from maskframe.policy import MaskPolicy


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path under the cluster's shared folder (``spark.checkpoint.dir``).

    Only a local session that names none gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="maskframe-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """A table written under the shared folder and read again.

    For rounds that build on each other: what follows neither computes the table
    again nor carries its plan, and survives lost executors.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_masked(
    df: DataFrame,
    policy: MaskPolicy,
    path: str,
    fmt: str = "parquet",
    mode: str = "errorifexists",
    table: str | None = None,
    partition_by: tuple[str, ...] = (),
    **kw,
) -> None:
    """Write the masked rows; one pass, no shuffle."""
    writer = mask(df, policy, table, **kw).write.format(fmt).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


#: How audit rows are written as JSON: without null fields, times to the microsecond.
AUDIT_JSON = {
    "ignoreNullFields": "true",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
}


def write_audit(audit: DataFrame, path: str, by_day: bool = False) -> None:
    """Append one JSON object per line; null fields are left out.

    ``by_day`` keeps one folder per day, so that old days can be dropped
    without rewriting anything.
    """
    if by_day:
        audit = audit.withColumn("day", F.to_date("timestamp"))
    writer = audit.write.mode("append").options(**AUDIT_JSON)
    (writer.partitionBy("day") if by_day else writer).json(path)
