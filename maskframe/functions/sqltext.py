"""Spark SQL text for expressions that are applied to many columns.

A masked column is a tree of a few hundred nodes.  Written as SQL text it is one
call to Spark per column instead of one per node, and the same text serves the
DataFrame API, lambdas over nested values and SQL-bodied functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote(name: str) -> str:
    """A column name as an identifier."""
    return "`" + name.replace("`", "``") + "`"


def lit(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def case(branches: list[tuple[str, str]], otherwise: str | None = None) -> str:
    body = " ".join(f"WHEN {test} THEN {result}" for test, result in branches)
    return f"CASE {body}{f' ELSE {otherwise}' if otherwise is not None else ''} END"


def matches(v: str, pattern: str) -> str:
    return f"{v} RLIKE {lit(pattern)}"


def bind(c: Column | str, text: Callable[[str], str]) -> Column:
    """Apply SQL text to a column.

    A column given by name is written into the text.  Any other expression
    becomes a lambda variable: it is evaluated once, however often the text
    names it.
    """
    if isinstance(c, str):
        return F.expr(text(quote(c)))
    return F.call_function("transform", F.array(c), F.expr(f"_v -> {text('_v')}"))[0]
