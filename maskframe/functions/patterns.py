"""Detection patterns, their priority and the column-name hints.

The pattern texts are accepted by Java's regex engine and by RE2, so the same
text can be used in Spark and in an external checker.  ``\\z`` (not ``$``) ends
a value, because Java's ``$`` also matches before a final line feed; digits and
white space are the Unicode classes.
"""

# The seven types in the order in which they are tried.
PII_TYPES = (
    "Email",
    "CreditCard",
    "Ssn",
    "IpAddress",
    "DateOfBirth",
    "Phone",
    "Passport",
)

# Masking strategy used for a detected type.
TYPE_STRATEGY = {
    "Email": "email",
    "CreditCard": "credit_card",
    "Ssn": "ssn",
    "IpAddress": "ip",
    "DateOfBirth": "dob",
    "Phone": "phone",
    "Passport": "passport",
}

# Unicode White_Space, as the inside of a character class and as literal text.
WS_CLASS = (
    r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS_CHARS = (
    "\t\n\x0b\x0c\r \x85\xa0 "
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "    　"
)

_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_D = r"\p{Nd}"
# U+017F and U+212A equal an ASCII letter when case is ignored.
_LETTER = r"A-Za-z\x{17f}\x{212a}"

# What a whole cell of each type looks like (no anchors).
BODIES = {
    "Email": rf"[{_LETTER}0-9._%+-]+@[{_LETTER}0-9.-]+\.[{_LETTER}]{{2,}}",
    "CreditCard": rf"(?:{_D}{{4}}[-{WS_CLASS}]?){{3}}{_D}{{4}}",
    "Ssn": rf"{_D}{{3}}-{_D}{{2}}-{_D}{{4}}",
    "IpAddress": rf"(?:{_OCTET}\.){{3}}{_OCTET}",
    "DateOfBirth": (
        rf"(?:{_D}{{4}}[-/]{_D}{{2}}[-/]{_D}{{2}}|{_D}{{2}}[-/]{_D}{{2}}[-/]{_D}{{4}})"
    ),
    "Phone": (
        rf"(?:\+{_D}{{1,3}}[-.{WS_CLASS}])?\(?{_D}{{3}}\)?"
        rf"[-.{WS_CLASS}]?{_D}{{3}}[-.{WS_CLASS}]?{_D}{{4}}"
    ),
    "Passport": rf"[A-Z]{{1,2}}{_D}{{6,8}}",
}
PATTERNS = {t: rf"^{BODIES[t]}\z" for t in PII_TYPES}

# Every type but Email is at least 7 and, at four bytes a digit, at most 73
# bytes long and holds no "@": both tests are constant-time on a UTF-8 value
# and keep long prose away from the regex engine.
SHORT_TYPES = tuple(t for t in PII_TYPES if t != "Email")
SHORT_MIN_BYTES = 7
SHORT_MAX_BYTES = 80
SHORT_PATTERN = "^(?:" + "|".join(BODIES[t] for t in SHORT_TYPES) + r")\z"

# Column-name hints, (type, substrings, whole names), first hit wins.
NAME_HINTS = (
    ("Email", ("email", "e_mail"), ("mail",)),
    ("Phone", ("phone", "mobile", "cell", "tel"), ("fax",)),
    ("Ssn", ("ssn", "social_security", "socialsecurity"), ("sin", "national_id")),
    (
        "CreditCard",
        ("credit_card", "creditcard", "card_number", "cardnumber"),
        ("cc_num", "pan"),
    ),
    ("IpAddress", ("ip_address", "ipaddress"), ("ip", "client_ip", "remote_addr")),
    ("DateOfBirth", ("birth",), ("dob", "birthdate", "date_of_birth")),
    ("Passport", ("passport",), ()),
)

# Type names whose columns are searched for personal data.
SCANNABLE_TYPE_NAMES = (
    "character varying",
    "varchar",
    "text",
    "character",
    "char",
    "name",
    "citext",
    "bpchar",
)

_JSON_WS = r"[ \t\r\n]*+"
_ANY_BODY = "(?:" + "|".join(BODIES[t] for t in PII_TYPES) + ")"

# A JSON string value that is personal data and holds no escape; the group is
# its text.  An opening quote never follows a backslash; the text between a
# closing quote and the next opening one holds a bracket, comma or colon, which
# no body does; a key is followed by a colon.  What stands before the quote is
# only looked at where there is one.
JSON_HIT = rf'"(?<!\\")({_ANY_BODY})"(?!{_JSON_WS}:)'

# A JSON literal with an escape that might decode to personal data: only
# characters and escapes that such a value can have.
_PLAIN = rf"[{_LETTER}{_D}._%+@/(){WS_CLASS}-]*+"
JSON_ESCAPED = rf'"{_PLAIN}(?:\\(?:[/bfnrt]|u[0-9a-fA-F]{{4}}){_PLAIN})++"'

# JSON text is cut, without loss, into keys (with their colon), string values
# and everything between.  Possessive quantifiers keep Java's matcher iterative
# on long literals.
JSON_TOKEN = rf'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:{_JSON_WS}:)?+|[^"]++'

# How JSON begins: an object is empty or has a name and a colon.  Array text in
# braces seldom does, and is told apart without a failed parse.
JSON_START = (
    rf'(?s)^{_JSON_WS}(?:[^{{ \t\r\n]|\{{{_JSON_WS}'
    rf'(?:\}}|"[^"\\]*+(?:\\.[^"\\]*+)*+"{_JSON_WS}:))'
)

# Text whose apostrophes all stand inside double quotes.  Spark's JSON readers
# accept single-quoted literals, which are not JSON.
JSON_QUOTES = r'''(?s)^(?:[^"']|"[^"\\]*+(?:\\.[^"\\]*+)*+")*+\z'''

# Text whose control characters all are white space outside of literals.
JSON_CONTROLS = (
    r'(?s)^(?:[^"\x00-\x1f]|[\t\n\r]|"[^"\\\x00-\x1f]*+(?:\\[^\x00-\x1f][^"\\\x00-\x1f]*+)*+")*+\z'
)

# Array or JSON text without such a place has nothing to mask: escapes aside, an
# element stands between braces, commas or quotes.  No body begins with one of
# these, so runs of them, as in deep text, do not have all bodies tried on each.
_NO_BODY = r'(?![\[\]{},":])'
ARRAY_HINT = (
    rf'\\|[\[{{,"]{_NO_BODY}[{WS_CLASS}]*+{_NO_BODY}{_ANY_BODY}[{WS_CLASS}]*+[\]}},"]'
)

# One piece of free text that is personal data: no letter, digit or sign that
# such a value can have stands right before it, and no letter or digit after it.
# Where several types can be read at one place the first in their order wins.
_BEFORE = rf"(?<![{_LETTER}{_D}._%+@/-])"
_AFTER = rf"(?![{_LETTER}{_D}@]|[-./]{_D})"
ANY_IN_TEXT = rf"{_BEFORE}(?:" + "|".join(BODIES[t] for t in PII_TYPES) + rf"){_AFTER}"

# Free text without such a place holds none of the seven: "@", or two digits
# with at most a few signs between them.
TEXT_HINT = rf"@|{_D}[-./()]?[{WS_CLASS}]?[-./()]?{_D}"

# What stands for a value in redacted text.
TAGS = {t: f"[{s.upper()}]" for t, s in TYPE_STRATEGY.items()}

# The inside of an array literal is cut into elements and the commas between.
ARRAY_TOKEN = r'(?s)(?:[^,"\\]|\\(?:.|\z)|"(?:[^"\\]|\\(?:.|\z))*+(?:"|\z))++|,'
