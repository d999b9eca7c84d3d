"""Detection: which of the seven types is a value, and what shape has it?

Functions take a column name or any ``Column``.  Nothing here shuffles and
nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.functions import patterns as P
from maskframe.functions.sqltext import bind, case, lit, matches


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def by_known_short(v: str, result: Callable[[str], str]) -> str:
    """SQL text: the type of a value that is known to match ``SHORT_PATTERN``.

    The six shapes do not overlap, so first character, length and separators
    tell them apart without trying their patterns again.
    """
    dots = f"length({v}) - length(replace({v}, '.', ''))"
    dashed = f"substring({v}, 4, 1) = '-' AND substring({v}, 7, 1) = '-'"
    return case(
        [
            (f"ascii({v}) BETWEEN 65 AND 90", result("Passport")),
            (f"startswith({v}, '+') OR startswith({v}, '(')", result("Phone")),
            (f"length({v}) >= 16", result("CreditCard")),
            (f"{dots} = 3", result("IpAddress")),
            (
                f"length({v}) = 10 AND (contains({v}, '-') OR contains({v}, '/'))",
                result("DateOfBirth"),
            ),
            (f"length({v}) = 11 AND {dashed}", result("Ssn")),
        ],
        otherwise=result("Phone"),
    )


def by_known_type(v: str, result: Callable[[str], str]) -> str:
    """SQL text: the type of a value that is known to match some pattern."""
    return case([(f"contains({v}, '@')", result("Email"))], by_known_short(v, result))


def case_by_type(v: str, result: Callable[[str], str]) -> str:
    """SQL text: ``result(type)`` for the first type that ``v`` matches, else null.

    At most one regex runs per value, whatever the results are: only e-mails
    hold "@", and every other type is short and matched by one joint pattern.
    """
    email = case([(matches(v, P.PATTERNS['Email']), result("Email"))])
    gate = (
        f"octet_length({v}) BETWEEN {P.SHORT_MIN_BYTES} AND {P.SHORT_MAX_BYTES} "
        f"AND {matches(v, P.SHORT_PATTERN)}"
    )
    return case([(f"contains({v}, '@')", email), (gate, by_known_short(v, result))])


def pii_type_sql(v: str) -> str:
    return case_by_type(v, lit)


def pii_type(c: Column | str) -> Column:
    """Name of the first matching type, or null."""
    return bind(c, pii_type_sql)


def _matches(t: str) -> Callable[[Column | str], Column]:
    def test(c: Column | str) -> Column:
        return _col(c).rlike(P.PATTERNS[t])

    test.__doc__ = f"True where the whole value has the shape of {t}."
    return test


is_email = _matches("Email")
is_credit_card = _matches("CreditCard")
is_ssn = _matches("Ssn")
is_ip = _matches("IpAddress")
is_dob = _matches("DateOfBirth")
is_phone = _matches("Phone")
is_passport = _matches("Passport")


def name_pii_type_sql(v: str) -> str:
    low = f"lower({v})"

    def test(parts, wholes) -> str:
        tests = [f"contains({low}, {lit(p)})" for p in parts]
        tests += [f"{low} = {lit(w)}" for w in wholes]
        return " OR ".join(tests)

    return case([(test(parts, wholes), lit(t)) for t, parts, wholes in P.NAME_HINTS])


def name_pii_type(c: Column | str) -> Column:
    """Type suggested by a column *name*, or null."""
    return bind(c, name_pii_type_sql)


def is_scannable(dt: T.DataType | str) -> bool:
    """True for character types; accepts a Spark type or a type name."""
    if isinstance(dt, T.DataType):
        return isinstance(dt, (T.StringType, T.CharType, T.VarcharType))
    return dt.strip().lower() in (*P.SCANNABLE_TYPE_NAMES, "string")


def scannable(c: Column | str) -> Column:
    """``is_scannable`` over a column of type names (lengths are ignored)."""
    bare = F.regexp_replace(F.lower(F.trim(_col(c))), r"\(.*\)$", "")
    return bare.isin(*P.SCANNABLE_TYPE_NAMES, "string")


def strategy_of(c: Column | str) -> Column:
    """Masking strategy of a type name."""
    return bind(
        c, lambda v: case([(f"{v} = {lit(t)}", lit(s)) for t, s in P.TYPE_STRATEGY.items()])
    )


_JSON_WS = lit(" \t\r\n")


def looks_like_json_sql(v: str) -> str:
    head, tail = f"ltrim({_JSON_WS}, {v})", f"rtrim({_JSON_WS}, {v})"
    return (
        f"((startswith({head}, '{{') AND endswith({tail}, '}}')) "
        f"OR (startswith({head}, '[') AND endswith({tail}, ']')))"
    )


def looks_like_json(c: Column | str) -> Column:
    """Brackets at both ends, white space around them ignored."""
    return bind(c, looks_like_json_sql)


def is_json_sql(v: str) -> str:
    quotes = f"(NOT contains({v}, '\\'') OR {matches(v, P.JSON_QUOTES)})"
    controls = f"(NOT {matches(v, '[' + chr(92) + 'x00-' + chr(92) + 'x1f]')} OR {matches(v, P.JSON_CONTROLS)})"
    return (
        f"coalesce({matches(v, P.JSON_START)} AND {quotes} AND {controls} "
        f"AND coalesce(json_array_length(concat('[', {v}, ']')) = 1, false) "
        f"AND size(json_object_keys(concat('{{\"v\":', {v}, '}}'))) = 1, false)"
    )


def is_json(c: Column | str) -> Column:
    """True where the whole value is one JSON document.

    Spark's JSON readers stop after the first value, so trailing text would
    pass.  Put inside a list the value must be its only element, and put inside
    an object it must be its only member: text that escapes from one wrapper is
    an error in the other.  They also accept single quotes and, inside literals,
    raw control characters, which JSON does not.
    """
    return bind(c, is_json_sql)


def looks_like_pg_array_sql(v: str) -> str:
    return f"(startswith({v}, '{{') AND endswith({v}, '}}') AND NOT {is_json_sql(v)})"


def looks_like_pg_array(c: Column | str) -> Column:
    """``{...}`` that is not JSON."""
    return bind(c, looks_like_pg_array_sql)


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_scannable(f.dataType)]


def contains_pii(df: DataFrame, columns: Iterable[str] | None = None) -> Column:
    """Row predicate: does any string column hold a detectable value?"""
    names = list(columns) if columns is not None else string_columns(df)
    return reduce(
        lambda a, b: a | b, [pii_type(n).isNotNull() for n in names], F.lit(False)
    )
