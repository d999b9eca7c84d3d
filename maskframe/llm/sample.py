"""Bounded, repeatable samples for training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_label(rows: DataFrame, label: str, most: int) -> DataFrame:
    """At most about ``most`` rows of each label, those with the smallest hash of ``doc_id``.

    ``rows`` has ``doc_id`` and the label.  Only one number for each label comes to the
    driver: the share of its rows to take.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    dealt = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    taken = F.lit(False)
    for value, n in counts.items():
        taken = taken | ((F.col(label) == F.lit(value)) & (dealt < F.lit(most / n)))
    return rows.where(taken)
