"""SQL names for the scalar functions, from ``pii_type`` to ``redact_text``.

They are SQL-bodied temporary functions, which Spark inlines into the plan; no
Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from maskframe.functions.detect import pii_type_sql
from maskframe.functions.nested import mask_json_sql, mask_text_sql
from maskframe.functions.partial import mask_sample_sql
from maskframe.functions.prose import mask_prose_sql, redact_text_sql
from maskframe.functions.sqltext import case, lit
from maskframe.functions.strategies import BUILT_IN, FALLBACK, fake_sql


def _mask_by_name(v: str, s: str) -> str:
    named = [(f"{s} = {lit(n)}", fake_sql(v, n)) for n in BUILT_IN if n != "json"]
    return case([(f"{v} IS NOT NULL", case(named, otherwise=lit(FALLBACK)))])


def register_functions(spark: SparkSession) -> None:
    """Make the functions available to SQL text in this session."""
    for signature, body in (
        ("pii_type(v STRING)", pii_type_sql("v")),
        ("mask_value(v STRING, strategy STRING)", _mask_by_name("v", "strategy")),
        ("mask_sample(v STRING)", mask_sample_sql("v")),
        ("mask_json(v STRING)", mask_json_sql("v")),
        ("mask_text(v STRING)", mask_text_sql("v")),
        ("mask_prose(v STRING)", mask_prose_sql("v")),
        ("redact_text(v STRING)", redact_text_sql("v")),
    ):
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS STRING RETURN {body}"
        )
