"""SQL for DuckDB of the queries over free text and JSON paths.

DuckDB's patterns cannot look around.  What may stand before and behind a piece of
personal data is marked in the text first: chr(2) where a piece may begin, chr(3)
where one may end.  The patterns of the pieces then allow for marks inside.
"""

from __future__ import annotations

from maskframe.functions import patterns as P
from maskframe.plans import fixtures as X
from maskframe.plans.oracles import _q, fake, pii, sample

_M = r"[\x02\x03]*"
_L = r"A-Za-z\x{17f}\x{212a}"
_D = r"\p{Nd}"
_WS = P.WS_CLASS
_OCTET = f"(?:25{_M}[0-5]|2{_M}[0-4]{_M}[0-9]|(?:[01]{_M})?[0-9](?:{_M}[0-9])?)"


def _digits(n: int) -> str:
    return _M.join([_D] * n)


# The pieces, type by type, with marks allowed between their characters.
_MARKED = {
    "Email": rf"[{_L}0-9._%+-](?:{_M}[{_L}0-9._%+-])*{_M}@{_M}[{_L}0-9.-](?:{_M}[{_L}0-9.-])*{_M}\.{_M}[{_L}](?:{_M}[{_L}])+",
    "CreditCard": rf"(?:{_digits(4)}{_M}(?:[-{_WS}]{_M})?){{3}}{_digits(4)}",
    "Ssn": rf"{_digits(3)}{_M}-{_M}{_digits(2)}{_M}-{_M}{_digits(4)}",
    "IpAddress": rf"(?:{_OCTET}{_M}\.{_M}){{3}}{_OCTET}",
    "DateOfBirth": rf"(?:{_digits(4)}{_M}[-/]{_M}{_digits(2)}{_M}[-/]{_M}{_digits(2)}|{_digits(2)}{_M}[-/]{_M}{_digits(2)}{_M}[-/]{_M}{_digits(4)})",
    "Phone": rf"(?:\+{_M}{_D}(?:{_M}{_D}){{0,2}}{_M}[-.{_WS}]{_M})?(?:\({_M})?{_digits(3)}{_M}(?:\){_M})?(?:[-.{_WS}]{_M})?{_digits(3)}{_M}(?:[-.{_WS}]{_M})?{_digits(4)}",
    "Passport": rf"[A-Z](?:{_M}[A-Z])?{_M}(?:{_digits(8)}|{_digits(7)}|{_digits(6)})",
}
_ANY = "|".join(_MARKED[t] for t in P.PII_TYPES)


def _parts(v: str) -> str:
    """A list of gaps and pieces in turn, gaps first."""
    ends = f"regexp_replace({v}, {_q(f'([^{_L}{_D}@])')}, chr(3) || '\\1', 'g') || chr(3)"
    ends = f"regexp_replace({ends}, {_q(rf'\x03([-./]{_D})')}, '\\1', 'g')"
    both = f"chr(2) || regexp_replace({ends}, {_q(rf'([^{_L}{_D}._%+@/\x03-])')}, '\\1' || chr(2), 'g')"
    cut = f"regexp_replace({both}, {_q(rf'\x02\x03?({_ANY})\x03')}, chr(1) || '\\1' || chr(1), 'g')"
    return f"list_transform(string_split({cut}, chr(1)), lambda x: regexp_replace(x, '[\\x02\\x03]', '', 'g'))"


def _woven(v: str, piece: str) -> str:
    """The text whose pieces ``x`` are replaced by SQL text over ``x``."""
    return f"array_to_string(list_transform({_parts(v)}, lambda x, i: CASE WHEN i % 2 = 0 THEN {piece} ELSE x END), '')"


def _by_type(results: dict[str, str]) -> str:
    branches = " ".join(f"WHEN '{t}' THEN {r}" for t, r in results.items())
    return f"(CASE {pii('x')} {branches} END)"


_TAGGED = _by_type({t: _q(P.TAGS[t]) for t in P.PII_TYPES})
_FAKED = _by_type({t: fake(s, "x") for t, s in P.TYPE_STRATEGY.items()})


def _hits(table: str, keys: str, v: str) -> str:
    """``keys``, number and text of every piece."""
    return (
        f"SELECT {keys}, (k // 2 - 1)::INTEGER AS hit_idx, parts[k] AS x FROM (SELECT {keys}, parts, "
        f"unnest(range(2, len(parts) + 1, 2)) AS k FROM (SELECT {keys}, {_parts(v)} AS parts FROM {table}))"
    )


def sql() -> dict[str, str]:
    letter = (
        f"'Dear customer ' || c_custkey || ', write to <' || {fake('email', 'email')} || '> or call ' || {fake('phone', 'phone')} || "
        f"'. Your card ' || {fake('credit_card', 'credit_card')} || ' was used from ' || {fake('ip', 'client_ip')} || "
        f"'; SSN:' || {fake('ssn', 'ssn')} || ', passport (' || {fake('passport', 'passport_no')} || '), v' || client_ip || '.7 ' || notes"
    )
    return {
        "redact_documents": f"SELECT doc_id, {_woven('text', _TAGGED)} AS text FROM documents",
        "redact_pages": f"SELECT page_id, {_woven('html', _TAGGED)} AS html FROM pages",
        "redact_conversations": f"SELECT conv_id, turn, {_woven('text', _TAGGED)} AS text FROM conversations",
        "mask_prose_documents": f"SELECT doc_id, {_woven('text', _FAKED)} AS text FROM documents",
        "mask_prose_pages": f"SELECT page_id, {_woven('html', _FAKED)} AS html FROM pages",
        "mask_prose_letters": f"WITH c AS ({X.PII_CUSTOMERS}) SELECT c_custkey, {letter} AS letter FROM c WHERE email IS NOT NULL",
        "prose_scan_documents": f"SELECT pii_type, count(*) AS n_found FROM (SELECT {pii('x')} AS pii_type FROM ({_hits('documents', 'doc_id', 'text')})) GROUP BY 1",
        "prose_log_documents": f"SELECT doc_id, hit_idx, {pii('x')} AS pii_type, {sample('x')} AS original, {_FAKED} AS masked FROM ({_hits('documents', 'doc_id', 'text')})",
        "mask_prose_join": f"WITH c AS ({X.PII_CUSTOMERS}) SELECT c_custkey, {fake('email', 'email')} AS email, true AS mentioned FROM c WHERE email IS NOT NULL",
    }
