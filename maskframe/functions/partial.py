"""Partial masks: shortened values for people, not replacements for data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskframe.functions.detect import is_json
from maskframe.functions.sqltext import bind, case


def mask_sample_sql(v: str) -> str:
    return case(
        [
            (f"length({v}) <= 4", f"repeat('*', length({v}))"),
            (f"length({v}) <= 8", f"concat(left({v}, 2), '***', right({v}, 2))"),
        ],
        otherwise=f"concat(left({v}, 3), '***', right({v}, 3))",
    )


def mask_sample(c: Column | str) -> Column:
    """Ends of a value: up to 4 characters all starred, up to 8 keep 2, else 3."""
    return bind(c, mask_sample_sql)


def preview_sql(v: str, n: int = 50) -> str:
    return case([(f"length({v}) > {n}", f"concat(left({v}, {n}), '...')")], otherwise=v)


def preview(c: Column | str, n: int = 50) -> Column:
    """First ``n`` characters.  This shows raw data; see ``change_log``."""
    return bind(c, lambda v: preview_sql(v, n))


def _stars(c: Column) -> Column:
    return F.repeat(F.lit("*"), F.length(c))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _email(c: Column) -> Column:
    parts = F.split(c, "@")
    name, labels = parts[0], F.split(parts[1], r"\.")
    n = F.length(name)
    hidden_name = F.when(
        n > 2,
        F.concat(
            F.left(name, F.lit(1)), F.repeat(F.lit("*"), n - 2), F.right(name, F.lit(1))
        ),
    ).otherwise(F.repeat(F.lit("*"), n))
    hidden_labels = F.transform(F.slice(labels, 1, F.size(labels) - 1), _stars)
    domain = F.array_join(F.concat(hidden_labels, F.array(F.element_at(labels, -1))), ".")
    return F.when(
        F.size(parts) == 2, F.concat(hidden_name, F.lit("@"), domain)
    ).otherwise("***@***.***")


def _phone(c: Column) -> Column:
    d = _digits(c)
    return F.when(
        F.length(d) >= 4, F.concat(F.lit("***-***-"), F.right(d, F.lit(4)))
    ).otherwise("***-****")


def _card(c: Column) -> Column:
    d = _digits(c)
    return F.when(
        F.length(d) >= 4, F.concat(F.lit("****-****-****-"), F.right(d, F.lit(4)))
    ).otherwise("****-****-****-****")


def _address(c: Column) -> Column:
    parts = F.split(c, ",")
    last_word = F.element_at(F.split(parts[0], " "), -1)
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.array_join(F.concat(F.array(F.concat(F.lit("*** "), last_word)), rest), ",")


_NOT_AN_OBJECT = '{"***": "***"}'


def _json(c: Column) -> Column:
    """Top-level string members starred; other members keep their text."""
    kinds = F.from_json(c, "map<string,variant>")
    texts = F.map_entries(F.from_json(c, "map<string,string>"))
    # Both maps come from the same text, so their members are in one order.
    members = F.zip_with(
        F.map_values(kinds),
        texts,
        lambda v, e: F.concat(
            _quoted(e["key"]),
            F.lit(":"),
            F.when(F.schema_of_variant(v) == "STRING", F.lit('"***"')).otherwise(
                F.coalesce(e["value"], F.lit("null"))
            ),
        ),
    )
    body = F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))
    return F.when(F.ltrim(c).startswith("{") & is_json(c), body).otherwise(_NOT_AN_OBJECT)


def _quoted(c: Column) -> Column:
    text = F.to_json(F.array(c))
    return F.substring(text, F.lit(2), F.length(text) - 2)


_KINDS = {
    "email": _email,
    "phone": _phone,
    "credit_card": _card,
    "address": _address,
    "json": _json,
}


def partial(c: Column | str, kind: str) -> Column:
    """Partial mask by kind; ``***`` for kinds without one.  Nulls stay null."""
    c = F.col(c) if isinstance(c, str) else c
    if kind == "hash":
        return F.when(c.isNotNull(), F.concat(F.lit("sha256:"), F.sha2(c, 256)))
    fn = _KINDS.get(kind)
    return F.when(c.isNotNull(), fn(c) if fn else F.lit("***"))


def quick(c: Column | str, kind: str) -> Column:
    """The one-line variant of ``partial`` shown in rule lists."""
    c = F.col(c) if isinstance(c, str) else c
    if kind == "email":
        parts = F.split(c, "@")
        labels = F.split(parts[1], r"\.")
        tail = F.array_join(
            F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))), "."
        )
        text = F.when(
            F.size(parts) == 2,
            F.concat(
                F.left(parts[0], F.lit(1)), F.lit("***@"), _stars(labels[0]), F.lit("."), tail
            ),
        ).otherwise("***@***.***")
    elif kind in ("phone", "credit_card"):
        d = _digits(c)
        head = "***-***-" if kind == "phone" else "****-****-****-"
        text = F.concat(
            F.lit(head), F.when(d == "", F.lit("****")).otherwise(F.right(d, F.lit(4)))
        )
    elif kind == "address":
        text = F.lit("*** Masked Address ***")
    elif kind == "json":
        text = F.lit(_NOT_AN_OBJECT)
    else:
        return partial(c, kind)
    return F.when(c.isNotNull(), text)
