"""Personal data inside free text: found, counted, redacted or masked in place.

A piece of a text is found by one joint pattern with guards on both sides, in one
pass.  The text is cut into what the pattern finds and the gaps between, so the
replacement of a piece can depend on the piece, and the gaps keep every byte.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskframe.functions import patterns as P
from maskframe.functions.detect import by_known_type, pii_type_sql
from maskframe.functions.sqltext import bind, case, lit, matches, quote
from maskframe.functions.strategies import fake_of_type

# Text that holds it is cut in two passes instead of one.
_MARK = "\\u0001"


def token_types_sql(v: str) -> str:
    """SQL text: the types of the tokens between white space that have one.

    Only tokens that can be of a type are taken from the text: those with "@", and
    short ones that end in a digit.
    """
    candidate = f"[^{P.WS_CLASS}]*@[^{P.WS_CLASS}]*|[^{P.WS_CLASS}@]*+(?<=\\p{{Nd}})"
    tokens = f"regexp_extract_all({v}, {lit(f'(?<![^{P.WS_CLASS}])(?:{candidate})(?![^{P.WS_CLASS}])')}, 0)"
    types = f"array_compact(transform({tokens}, _t -> {pii_type_sql('_t')}))"
    return case([(f"{v} IS NULL", "NULL"), (matches(v, P.TEXT_HINT), types)], otherwise="CAST(array() AS ARRAY<STRING>)")


def token_scan(df: DataFrame, text: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Tokens of each type in a column of free text, in total or per key.

    Only tokens that can be of a type are cut from a text, only hits leave the row,
    and the counts are combined in every map task.
    """
    hits = F.explode(F.expr(token_types_sql(quote(text)))).alias("pii_type")
    return df.select(*keys, hits).groupBy(*keys, "pii_type").agg(F.count(F.lit(1)).alias("n_tokens"))


def _replaced(v: str, result: Callable[[str], str]) -> str:
    """SQL text: a text whose pieces of personal data give way to ``result(piece)``.

    In one pass the pieces are marked, so that every second part is one.  A text that
    holds the mark is cut twice, into pieces and into gaps.
    """
    marked = f"regexp_replace({v}, {lit('(' + P.ANY_IN_TEXT + ')')}, '{_MARK}$1{_MARK}')"
    cut = f"split({marked}, '{_MARK}', -1)"
    hits, gaps = f"regexp_extract_all({v}, {lit(P.ANY_IN_TEXT)}, 0)", f"split({v}, {lit(P.ANY_IN_TEXT)}, -1)"
    woven = f"flatten(zip_with({gaps}, {hits}, (_g, _h) -> array(_g, coalesce(_h, ''))))"
    parts = case([(f"contains({v}, '{_MARK}')", woven)], otherwise=cut)
    # A gap is an even part; the last piece of a woven text is empty.
    replaced = case([("_i % 2 = 1 AND _p != ''", result("_p"))], otherwise="_p")
    out = f"array_join(transform({parts}, (_p, _i) -> {replaced}), '')"
    return case([(matches(v, P.TEXT_HINT), out)], otherwise=v)


def redact_text_sql(v: str) -> str:
    return _replaced(v, lambda h: by_known_type(h, lambda t: lit(P.TAGS[t])))


def redact_text(c: Column | str) -> Column:
    """Free text with a tag in place of every piece of personal data.

    Values are found anywhere in the text, but not inside longer words or numbers.
    The text is read from the left: what is found first is replaced, and where
    several types can be read at one place the first in their order wins.  Text
    without a place that could be one is not searched.  Null stays null.
    """
    return bind(c, redact_text_sql)


def mask_prose_sql(v: str, salt: str = "") -> str:
    return _replaced(v, lambda h: by_known_type(h, lambda t: fake_of_type(h, t, salt)))


def mask_prose(c: Column | str, salt: str = "") -> Column:
    """Free text in which every piece of personal data is replaced by its fake.

    The pieces are those of ``redact_text``.  A value gets the fake that it has in a
    column of its own, so masked texts still join with masked tables.
    """
    return bind(c, lambda v: mask_prose_sql(v, salt))


def prose_hits_sql(v: str) -> str:
    """SQL text: the pieces of a text with their types, in their order."""
    hits = f"transform(regexp_extract_all({v}, {lit(P.ANY_IN_TEXT)}, 0), _h -> named_struct('pii_type', {by_known_type('_h', lit)}, 'value', _h))"
    return case([(f"{matches(v, P.TEXT_HINT)}", hits)])


def prose_log(df: DataFrame, text: str, keys: tuple[str, ...], salt: str = "") -> DataFrame:
    """One row for every piece that ``mask_prose`` replaces: keys, number in its text, type, original sample, fake."""
    from maskframe.functions.partial import mask_sample

    found = df.select(*keys, F.posexplode(F.expr(prose_hits_sql(quote(text)))).alias("hit_idx", "h"))
    fake = F.expr(by_known_type("h.value", lambda t: fake_of_type("h.value", t, salt)))
    return found.select(*keys, "hit_idx", F.col("h.pii_type").alias("pii_type"), mask_sample(F.col("h.value")).alias("original"), fake.alias("masked"))


def prose_scan(df: DataFrame, text: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of each type anywhere in a column of free text, in total or per key."""
    found = df.select(*keys, F.explode(F.expr(prose_hits_sql(quote(text)))).alias("h"))
    return found.groupBy(*keys, F.col("h.pii_type").alias("pii_type")).agg(F.count(F.lit(1)).alias("n_found"))


def holds_personal_data(c: Column | str) -> Column:
    """True where a token of free text is personal data."""
    return bind(c, lambda v: f"size({token_types_sql(v)}) > 0")
