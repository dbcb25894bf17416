"""Masking of personal information and secrets in free text (PI1-PI12).

Each mask is guarded by a cheap test, so a text without digits, ``@`` or key words is passed
through after a few native string scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import has, replace_matches, text_pattern

# What is recognised, and what is left of it.
BEARER = r"\bBearer\s+[A-Za-z0-9_\-\.]+"
BEARER_MASK = "Bearer [REDACTED]"
CLOUD_KEY = r"\bAIza[0-9A-Za-z\-_]{30,}\b"
CLOUD_KEY_MASK = "AIza" + "*" * 31
SECRET = (
    r"""(["']?(?:api[_-]?key|access[_-]?token|secret|password|client[_-]?secret|private[_-]?key)["']?"""
    r"""\s*[:=]\s*["']?)([^"',\s]{4,})(["']?)"""
)
SECRET_MASK = "$1[REDACTED]$3"
ID_16 = r"\b(\d{6})\d{6}(\d{4})\b"
ID_16_MASK = "$1******$2"
TAX_FORMATTED = r"\b(\d{2})\.\d{3}\.\d{3}\.\d{1}-\d{3}\.(\d{3})\b"
TAX_FORMATTED_MASK = r"$1.***.***.*-***.$2"
TAX_RAW = r"\b(\d{2})\d{10}(\d{3})\b"
TAX_RAW_MASK = "$1*******$2"
CARD = r"\b(\d{4})[ -]?\d{4}[ -]?\d{4}[ -]?(\d{4})\b"
CARD_MASK = "$1-****-****-$2"
PERMIT = r"\b(?:NIORA|Permit\s+Number|Passport\s+Number)\s*:\s*[A-Z0-9-]{6,}\b"
ACCOUNT = (
    r"\b(?:No\.?\s*Rekening(?:\s*SeaBank)?|Account\s*(?:No\.?|Number)|ACC\.?\s*No\.?)\s*:\s*\d[\d-]{5,}\b"
)
PHONE = r"\b(\+?62|0)(8\d{2})\d{4,6}(\d{3})\b"
PHONE_MASK = "$1$2****$3"
REDACTED = "[REDACTED]"

# E-mail: user part of two or more characters, first and last kept.  A user part is entered only at
# the first word boundary of its run (or of what the last match left of it), which keeps long runs of
# address characters linear.
_USER = r"a-zA-Z0-9_.+-"
EMAIL = (
    rf"(?:(?<![{_USER}])|\G)((?:(?<=\w)[a-zA-Z0-9_]++|(?<!\w)[.+-]++)?+)([{_USER}])[{_USER}]*([{_USER}])"
    r"@([a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+)\b"
)
EMAIL_MASK = "$1$2***$3@$4"


def _sub(c: Column, pattern: str, mask: str, flags: str = "") -> Column:
    return F.regexp_replace(c, text_pattern(pattern, flags), mask)


def _when(c: Column, test: Column, masked: Column) -> Column:
    return F.when(test, masked).otherwise(c)


def mask_bearer(c: Column) -> Column:
    return _sub(c, BEARER, BEARER_MASK, "i")


def mask_cloud_key(c: Column) -> Column:
    return _when(c, F.contains(c, F.lit("AIza")), _sub(c, CLOUD_KEY, CLOUD_KEY_MASK))


def mask_secret(c: Column) -> Column:
    return _sub(c, SECRET, SECRET_MASK, "i")


def mask_id16(c: Column) -> Column:
    return _sub(c, ID_16, ID_16_MASK)


def mask_tax_id(c: Column) -> Column:
    """Stand-alone tax id: the printed form when it has punctuation, else the 15 digits."""
    printed = F.contains(c, F.lit(".")) | F.contains(c, F.lit("-"))
    return F.when(printed, _sub(c, TAX_FORMATTED, TAX_FORMATTED_MASK)).otherwise(_sub(c, TAX_RAW, TAX_RAW_MASK))


def mask_card(c: Column) -> Column:
    return _sub(c, CARD, CARD_MASK)


def mask_phone(c: Column) -> Column:
    return _sub(c, PHONE, PHONE_MASK)


def mask_email(c: Column) -> Column:
    return _when(c, F.contains(c, F.lit("@")), _sub(c, EMAIL, EMAIL_MASK))


def mask_permit(value: Column) -> Column:
    """Two characters kept at each end, same length; four or fewer are all masked (PI8)."""
    n = F.length(value)
    return F.when(
        n > 4, F.concat(F.left(value, F.lit(2)), F.repeat(F.lit("*"), n - 4), F.right(value, F.lit(2)))
    ).otherwise(F.repeat(F.lit("*"), n))


def _stars(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\d", "*")


def mask_account(value: Column) -> Column:
    """Two digits kept at each end, separators kept; four or fewer digits are all masked (PI9)."""
    edges = r"(?sU)^(\D*\d\D*\d)(.*)(\d\D*\d\D*)$"
    return F.when(
        F.length(F.regexp_replace(value, r"(?U)\D", "")) > 4,
        F.concat(
            F.regexp_extract(value, edges, 1),
            _stars(F.regexp_extract(value, edges, 2)),
            F.regexp_extract(value, edges, 3),
        ),
    ).otherwise(_stars(value))


def _labelled(mask):
    def rewrite(hit: Column) -> Column:
        value = r"(?sU)^([^:]*:\s*)(.*)$"
        return F.concat(F.regexp_extract(hit, value, 1), mask(F.regexp_extract(hit, value, 2)))

    return rewrite


def mask_labelled(c: Column) -> Column:
    """Permit, passport and account numbers that follow their label (PI8, PI9)."""
    return bound(bound(c, _labelled_step(PERMIT, mask_permit)), _labelled_step(ACCOUNT, mask_account))


def _labelled_step(pattern: str, mask):
    full = text_pattern(pattern)

    def step(x: Column) -> Column:
        found = F.contains(x, F.lit(":")) & F.rlike(x, F.lit(full))
        return F.when(found, replace_matches(x, full, _labelled(mask))).otherwise(x)

    return step


def bound(c: Column, fn) -> Column:
    """Bind ``c`` once for a function that reads it several times."""
    return F.get(F.transform(F.array(c), fn), 0)


def _secrets(c: Column) -> Column:
    return mask_secret(_sub(mask_bearer(c), CLOUD_KEY, CLOUD_KEY_MASK))


def _numbers(c: Column) -> Column:
    c = _sub(mask_id16(c), TAX_FORMATTED, TAX_FORMATTED_MASK)
    return mask_card(_sub(c, TAX_RAW, TAX_RAW_MASK))


# Cheap tests on the text as it came in.  No mask adds digits, "@", ":" or key words, so a test that
# fails on the original text fails on every later state of it too.
_GATES = {
    "secret": lambda c: F.contains(c, F.lit("AIza"))
    | has(c, r"bearer\s")
    | ((F.contains(c, F.lit(":")) | F.contains(c, F.lit("="))) & has(c, "key|token|secret|password")),
    "digits": lambda c: has(c, r"\d{3}", ""),
    "colon": lambda c: F.contains(c, F.lit(":")),
    "at": lambda c: F.contains(c, F.lit("@")),
}
# The fixed order: secrets, ids, tax ids and cards, labelled ids, phones, e-mail.
_STEPS = [
    ("secret", _secrets),
    ("digits", _numbers),
    ("colon", mask_labelled),
    ("digits", mask_phone),
    ("at", lambda c: _sub(c, EMAIL, EMAIL_MASK)),
]


def mask_expression(c: Column) -> Column:
    """PI12 as one expression, for values inside arrays, maps and structs."""
    for _, fn in _STEPS:
        c = fn(c)
    return c


def mask_columns(df: DataFrame, *names: str) -> DataFrame:
    """PI12 on text columns, in place: narrow, one scan per guard, masks only where a guard holds."""
    tests = {
        f"__g_{i}_{gate}": test(F.col(name)) for i, name in enumerate(names) for gate, test in _GATES.items()
    }
    df = df.withColumns(tests)
    for gate, fn in _STEPS:
        df = df.withColumns(
            {
                name: F.when(F.col(f"__g_{i}_{gate}"), fn(F.col(name))).otherwise(F.col(name))
                for i, name in enumerate(names)
            }
        )
    return df.drop(*tests)
