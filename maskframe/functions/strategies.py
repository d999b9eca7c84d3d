"""Masking strategies: what a value is replaced by.

Each one is a deterministic expression of the value and names its digest once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskframe.functions import patterns as P
from maskframe.functions.sqltext import bind, case, lit

# Pool for the ``address`` strategy.
CITIES = (
    "Ashford", "Brookfield", "Cedarville", "Dunmore", "Eastport", "Fairview",
    "Glenwood", "Hartley", "Ironwood", "Jamestown", "Kingsbridge", "Lakeside",
    "Milton", "Northgate", "Oakdale", "Pinehurst", "Quincy", "Riverton",
    "Stonehaven", "Thornbury", "Underhill", "Vernon", "Westbrook", "Yarrow",
)

# Results that do not depend on the value.
CONSTANTS = {"ip": "0.0.0.0", "dob": "1900-01-01", "passport": "XXXXXXXX"}
FALLBACK = "MASKED"


def _salted(v: str, salt: str) -> str:
    return f"concat({lit(salt)}, {v})" if salt else v


def seed_sql(v: str, salt: str = "") -> str:
    """60 bits of the value's digest as a non-negative BIGINT."""
    return f"CAST(conv(substring(md5({_salted(v, salt)}), 1, 15), 16, 10) AS BIGINT)"


def _hex(v: str, salt: str, n: int) -> str:
    return f"substring(md5({_salted(v, salt)}), 1, {n})"


def _decimal(v: str, salt: str, n: int) -> str:
    """Digits of the digest without a number conversion."""
    return f"translate({_hex(v, salt, n)}, 'abcdef', '012345')"


def _dash(text: str, at: int) -> str:
    return f"overlay({text} PLACING '-' FROM {at} FOR 0)"


def _email(v: str, salt: str) -> str:
    return f"concat('user.', {_hex(v, salt, 15)}, '@example.com')"


def _phone(v: str, salt: str) -> str:
    return f"concat('555-', {_dash(_decimal(v, salt, 7), 4)})"


def _address(v: str, salt: str) -> str:
    pool = ", ".join(lit(x) for x in CITIES)
    return f"element_at(array({pool}), CAST({seed_sql(v, salt)} % {len(CITIES)} + 1 AS INT))"


def _credit_card(v: str, salt: str) -> str:
    return _dash(_dash(_dash(f"concat('4', {_decimal(v, salt, 15)})", 13), 9), 5)


def _ssn(v: str, salt: str) -> str:
    return f"concat('XXX-XX-', lpad(CAST({seed_sql(v, salt)} % 10000 AS STRING), 4, '0'))"


_SEEDED: dict[str, Callable[[str, str], str]] = {
    "email": _email,
    "phone": _phone,
    "address": _address,
    "credit_card": _credit_card,
    "ssn": _ssn,
}
_custom: dict[str, Callable[[Column], Column]] = {}
BUILT_IN = (*_SEEDED, *CONSTANTS, "hash", "json")


def register_strategy(name: str, fn: Callable[[Column], Column]) -> None:
    """Add a named strategy ``value -> masked`` for use in rules.

    Built-in names cannot be replaced: heuristic masking relies on them.
    """
    if name in BUILT_IN:
        raise ValueError(f"strategy {name!r} is built in")
    _custom[name] = fn


def strategy_names() -> tuple[str, ...]:
    return (*BUILT_IN, *_custom)


def custom_strategy(name: str) -> Callable[[Column], Column] | None:
    return _custom.get(name)


def fake_sql(v: str, strategy: str, salt: str = "", strict_reference: bool = False) -> str:
    """SQL text of the masked form of a non-null value, by a built-in strategy.

    ``hash`` is a SHA-256 digest unless ``strict_reference`` asks for the
    constant.  Unknown names, and ``json`` on text that is not JSON, give the
    constant.
    """
    if strategy == "hash" and not strict_reference:
        return f"concat('sha256:', sha2({_salted(v, salt)}, 256))"
    if strategy in _SEEDED:
        return _SEEDED[strategy](v, salt)
    return lit(CONSTANTS.get(strategy, FALLBACK))


def fake_of_type(v: str, t: str, salt: str = "") -> str:
    return fake_sql(v, P.TYPE_STRATEGY[t], salt)


def mask_value_sql(v: str, strategy: str, salt: str = "", strict_reference: bool = False) -> str:
    return case([(f"{v} IS NOT NULL", fake_sql(v, strategy, salt, strict_reference))])


def mask_value(
    c: Column | str, strategy: str, salt: str = "", strict_reference: bool = False
) -> Column:
    """Mask a value by strategy name; nulls stay null."""
    fn = custom_strategy(strategy)
    if fn is not None:
        value = F.col(c) if isinstance(c, str) else c
        return F.when(value.isNotNull(), fn(value))
    return bind(c, lambda v: mask_value_sql(v, strategy, salt, strict_reference))
