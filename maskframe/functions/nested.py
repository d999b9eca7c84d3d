"""Masking inside a value: JSON text, array text and native nested columns.

JSON and array text is cut into tokens by one regex, only tokens that hold
personal data are replaced, and the tokens are joined again.  All other bytes
stay as they are, at any depth, without a parser and without Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.functions import patterns as P
from maskframe.functions.detect import (
    by_known_type,
    case_by_type,
    is_json_sql,
    looks_like_json_sql,
    pii_type_sql,
    string_columns,
)
from maskframe.functions.sqltext import bind, case, lit, matches, quote
from maskframe.functions.strategies import fake_of_type

TEXT_TYPES = (T.StringType, T.CharType, T.VarcharType)


def fake_or_null(v: str, salt: str = "") -> str:
    """SQL text: the fake of a detected value, null for any other value."""
    return case_by_type(v, lambda t: fake_of_type(v, t, salt))


def _quoted_fake(v: str, salt: str) -> str:
    return case_by_type(v, lambda t: f"concat('\"', {fake_of_type(v, t, salt)}, '\"')")


def _json_leaf(tok: str) -> str:
    """Decoded text of a string-value token, null for every other token."""
    decoded = case(
        [(f"contains({tok}, '\\\\')", f"get_json_object(concat('{{\"v\":', {tok}, '}}'), '$.v')")],
        otherwise=f"substring({tok}, 2, length({tok}) - 2)",
    )
    return case([(f"startswith({tok}, '\"') AND endswith({tok}, '\"')", decoded)])


def _json_tokens(v: str) -> str:
    return f"regexp_extract_all({v}, {lit(P.JSON_TOKEN)}, 0)"


def _array_leaf(inner: str) -> str:
    """Text of a trimmed element: unquoted and unescaped."""
    quoted = f"startswith({inner}, '\"') AND endswith({inner}, '\"') AND length({inner}) >= 2"
    bare = case([(quoted, f"substring({inner}, 2, length({inner}) - 2)")], otherwise=inner)
    plain = f"replace(replace({bare}, '\\\\\"', '\"'), '\\\\\\\\', '\\\\')"
    return case([(f"contains({inner}, '\\\\')", plain)], otherwise=bare)


def _array_pairs(v: str) -> str:
    """Tokens of array text with their decoded text, trimmed once.

    Commas and elements too short to be of any type have no text.
    """
    text = case([("octet_length(_t) >= 6", f"trim(BOTH {lit(P.WS_CHARS)} FROM _t)")])
    trimmed = f"transform({_array_tokens(v)}, _t -> named_struct('tok', _t, 'val', {text}))"
    return (
        f"transform({trimmed}, _s -> named_struct('tok', _s.tok, "
        f"'val', {case([('_s.val IS NOT NULL', _array_leaf('_s.val'))])}))"
    )


def _array_tokens(v: str) -> str:
    body = f"substring({v}, 2, length({v}) - 2)"
    return f"regexp_extract_all({body}, {lit(P.ARRAY_TOKEN)}, 0)"


def _replaced(pairs: str, salt: str) -> str:
    """Join tokens, those whose decoded text is personal data replaced."""
    out = f"transform({pairs}, _p -> coalesce({_quoted_fake('_p.val', salt)}, _p.tok))"
    return f"array_join({out}, '')"


# Text that holds it already goes the other way.
_MARK = "\\u0001"


def _mask_json_hits(v: str, salt: str) -> str:
    """Only the hits are looked at; the text between them is kept as it is.

    The hits are marked in one pass, so that every second part is one.
    """
    marked = f"regexp_replace({v}, {lit(P.JSON_HIT)}, '{_MARK}$1{_MARK}')"
    fake = by_known_type("_h", lambda t: fake_of_type("_h", t, salt))
    parts = (
        f"transform(split({marked}, '{_MARK}'), (_h, _i) -> "
        + case([("_i % 2 = 1", f"concat('\"', {fake}, '\"')")], otherwise="_h")
        + ")"
    )
    return f"array_join({parts}, '')"


def _mask_json_tokens(v: str, salt: str) -> str:
    """Every literal is decoded: needed where escapes may hide personal data."""
    pairs = f"transform({_json_tokens(v)}, _t -> named_struct('tok', _t, 'val', {_json_leaf('_t')}))"
    return _replaced(pairs, salt)


def mask_json_sql(v: str, salt: str = "") -> str:
    escaped = f"contains({v}, '{_MARK}') OR (contains({v}, '\\\\') AND {matches(v, P.JSON_ESCAPED)})"
    return case([(escaped, _mask_json_tokens(v, salt))], otherwise=_mask_json_hits(v, salt))


def mask_json(c: Column | str, salt: str = "") -> Column:
    """Mask the string values of valid JSON text; keys and numbers stay."""
    return bind(c, lambda v: mask_json_sql(v, salt))


def _pg_shaped(v: str) -> str:
    return (
        f"startswith({v}, '{{') AND endswith({v}, '}}') AND length({v}) >= 2 "
        f"AND {matches(v, P.ARRAY_HINT)}"
    )


def _mask_elements(v: str, salt: str) -> str:
    """Array text with its own brackets around masked elements."""
    return f"concat(left({v}, 1), {_replaced(_array_pairs(v), salt)}, right({v}, 1))"


def mask_pg_array_sql(v: str, salt: str = "") -> str:
    return case([(_pg_shaped(v), _mask_elements(v, salt))], otherwise=v)


def mask_pg_array(c: Column | str, salt: str = "") -> Column:
    """Mask elements of ``{a,"b"}``; other elements and other text stay."""
    return bind(c, lambda v: mask_pg_array_sql(v, salt))


def may_hold_pii(v: str) -> str:
    """SQL text: a container that is worth parsing; most are not."""
    return f"{looks_like_json_sql(v)} AND {matches(v, P.ARRAY_HINT)}"


def containers(v: str, salt: str = "") -> list[tuple[str, str, str]]:
    """How text in brackets is masked: (condition, masked text, kind), first hit wins.

    What begins like JSON but is refused (raw control characters, too deep, text
    behind it) still has its literals masked: personal data is never let through
    because its container is broken.  A list without quotes is masked by element
    unless it is JSON, a list of numbers; elements are classified in one place.
    """
    bare = f"startswith({v}, '[') AND endswith({v}, ']') AND NOT contains({v}, '\"')"
    json = f"{matches(v, P.JSON_START)} AND NOT ({bare} AND NOT {is_json_sql(v)})"
    # Only a list without quotes comes past JSON with a square bracket.
    listed = f"startswith({v}, '[') OR ({_pg_shaped(v)})"
    return [
        (json, mask_json_sql(v, salt), "json (heuristic)"),
        (listed, _mask_elements(v, salt), "array (heuristic)"),
    ]


def mask_text_sql(v: str, salt: str = "") -> str:
    container = case([c[:2] for c in containers(v, salt)], otherwise=v)
    inside = case([(may_hold_pii(v), container)])
    return f"coalesce({fake_or_null(v, salt)}, {inside}, {v})"


def mask_text(c: Column | str, salt: str = "") -> Column:
    """The heuristic for a text cell: one value, else JSON, else array text."""
    return bind(c, lambda v: mask_text_sql(v, salt))


def holds_text(dt: T.DataType) -> bool:
    """True if a value of this type can contain a string."""
    if isinstance(dt, T.ArrayType):
        return holds_text(dt.elementType)
    if isinstance(dt, T.MapType):
        return holds_text(dt.valueType)
    if isinstance(dt, T.StructType):
        return any(holds_text(f.dataType) for f in dt.fields)
    return isinstance(dt, (*TEXT_TYPES, T.VariantType))


def mask_nested_sql(v: str, dt: T.DataType, salt: str = "", depth: int = 0) -> str:
    if not holds_text(dt):
        return v
    x = f"_n{depth}"
    if isinstance(dt, T.ArrayType):
        return f"transform({v}, {x} -> {mask_nested_sql(x, dt.elementType, salt, depth + 1)})"
    if isinstance(dt, T.MapType):
        inner = mask_nested_sql(x, dt.valueType, salt, depth + 1)
        return f"transform_values({v}, (_k{depth}, {x}) -> {inner})"
    if isinstance(dt, T.StructType):
        fields = ", ".join(
            f"{lit(f.name)}, "
            + mask_nested_sql(f"{v}.{quote(f.name)}", f.dataType, salt, depth + 1)
            for f in dt.fields
        )
        return case([(f"{v} IS NOT NULL", f"named_struct({fields})")])
    if isinstance(dt, T.VariantType):
        return f"parse_json({mask_json_sql(f'to_json({v})', salt)})"
    return f"coalesce({fake_or_null(v, salt)}, {v})"


def mask_nested(c: Column | str, dt: T.DataType, salt: str = "") -> Column:
    """The same recursion over native arrays, map values, structs and variants.

    Map keys, like JSON keys, are never touched.
    """
    return bind(c, lambda v: mask_nested_sql(v, dt, salt))


def leaf_types_sql(v: str) -> str:
    """SQL text: the detected types of the leaves of a cell, as an array."""
    json = f"transform({_json_tokens(v)}, _t -> {_json_leaf('_t')})"
    array = f"transform({_array_pairs(v)}, _p -> _p.val)"
    inside = case([(is_json_sql(v), json)], otherwise=array)
    leaves = case([(looks_like_json_sql(v), inside)], otherwise=f"array({v})")
    return f"array_compact(transform({leaves}, _l -> {pii_type_sql('_l')}))"


def leaf_scan(df: DataFrame, column: str) -> DataFrame:
    """Count detected types among the leaves of one text column.

    A leaf is a string value of JSON text, an element of array text, or the
    cell itself.  Leaves are classified before they are exploded, so only hits
    leave the row, and the counts are combined in every map task.
    """
    if column not in string_columns(df):
        raise ValueError(f"{column!r} is not a text column")
    return (
        df.select(F.explode(F.expr(leaf_types_sql(quote(column)))).alias("pii_type"))
        .groupBy("pii_type")
        .agg(F.count(F.lit(1)).alias("n_leaves"))
    )
