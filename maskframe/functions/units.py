"""Numbers as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The units of ``human_bytes``.
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB")


def human_bytes(c: Column) -> Column:
    """Bytes in the largest fitting unit, at most two decimals: ``1.5 KB``."""
    out = None
    for i in reversed(range(len(BYTE_UNITS))):
        number = F.round(c / F.lit(float(1024**i)), 2).cast("string")
        text = F.concat(F.regexp_replace(number, r"\.0$", ""), F.lit(f" {BYTE_UNITS[i]}"))
        fits = c >= 1024**i
        out = F.when(fits, text) if out is None else out.when(fits, text)
    return out.when(c == 0, "0 B")


def human_ms(c: Column) -> Column:
    """Milliseconds as ``250ms``, ``1.5s`` or ``2.0m``."""
    ms = c.cast("double")
    return (
        F.when(ms < 1000, F.format_string("%.0fms", ms))
        .when(ms < 60000, F.format_string("%.1fs", ms / 1000))
        .when(ms.isNotNull(), F.format_string("%.1fm", ms / 60000))
    )
