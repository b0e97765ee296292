"""Text policy expressions. Code points are the unit; nothing is folded unless asked for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed value: the code points for which Python's str.isspace() is true, as a Java/RE2 class body.
BLANK_CLASS = "\\t-\\r\\x1c-\\x1f \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Digit families treated as alike in identifiers.
ASCII_DIGITS = "0123456789"
URDU_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ZWNJ = "‌"


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    normalize = unicodedata.normalize
    return pd.Series([None if t is None else t if t.isascii() else normalize("NFC", t) for t in texts], dtype=object)


def nfc(text: Column) -> Column:
    """Unicode NFC. Spark has no built-in for it, so this is one Arrow-batched function."""
    return _nfc(text)


def collapse_blanks(text: Column) -> Column:
    """Runs of blanks become one U+0020, outer blanks go. Null stays null."""
    return F.trim(F.regexp_replace(text, f"[{BLANK_CLASS}]+", " "))


def strip_blanks(text: Column) -> Column:
    """Outer blanks go, inner ones stay."""
    return F.regexp_replace(text, f"^[{BLANK_CLASS}]+|[{BLANK_CLASS}]+\\z", "")


def is_blank(text: Column) -> Column:
    """Null, empty or blanks only."""
    return text.isNull() | ~text.rlike(f"[^{BLANK_CLASS}]")


def has_forbidden_control(text: Column) -> Column:
    """A code point of category Cc, Cf, Cs, Zl or Zp other than U+200C."""
    return F.regexp_replace(text, "\\u200c", "").rlike("[\\p{Cc}\\p{Cf}\\p{Cs}\\p{Zl}\\p{Zp}]")


def issue_codes(text: Column, normalized: Column) -> Column:
    """Issue codes of a transcription in fixed order; ``empty_text`` stands alone.

    ``normalized`` is ``nfc(text)``, passed in so that a caller evaluates it once.
    A null text counts as empty.
    """
    checks = F.array(
        F.when(has_forbidden_control(text), F.lit("invalid_text_control")),
        F.when(normalized != text, F.lit("non_nfc_text")),
        F.when(text.rlike(f"^[{BLANK_CLASS}]|[{BLANK_CLASS}]\\z"), F.lit("leading_or_trailing_whitespace")),
        F.when(text.contains("  ") | text.rlike(f"[{BLANK_CLASS.replace(' ', '')}]"), F.lit("noncanonical_whitespace")),
    )
    return F.when(is_blank(text), F.array(F.lit("empty_text"))).otherwise(F.filter(checks, lambda c: c.isNotNull()))


def normalize_transcription(text: Column) -> Column:
    """NFC with single spaces; null where the text is null, has a forbidden control or ends up empty."""
    collapsed = collapse_blanks(nfc(text))
    return F.when(~has_forbidden_control(text) & (collapsed != ""), collapsed)


def characters(text: Column) -> Column:
    """Code points of a text as an array; the empty text gives an empty array."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def ascii_space_tokens(text: Column) -> Column:
    """Tokens between U+0020 only; empty ones are dropped."""
    return F.filter(F.split(text, " "), lambda t: t != "")


def words(text: Column) -> Column:
    """Pieces between runs of any blank."""
    return F.filter(F.split(text, f"[{BLANK_CLASS}]+"), lambda t: t != "")


def code_point_label(character: Column) -> Column:
    """``U+%04X`` of the first code point."""
    digits = F.hex(F.ascii(character))
    return F.concat(F.lit("U+"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def alike(value: Column) -> Column:
    """Canonical spelling of an identifier: letter case, outer blanks and Urdu digits are levelled."""
    return F.translate(F.lower(strip_blanks(value)), URDU_DIGITS, ASCII_DIGITS)


def padded_number(number: Column, width: int) -> Column:
    """A number with zeros in front up to ``width`` digits; longer numbers stay whole, a sign stays in front."""
    digits = F.regexp_replace(number.cast("string"), "^-", "")
    padded = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    return F.concat(F.when(number < 0, "-").otherwise(""), padded)


def urdu_number(number: Column, width: int) -> Column:
    """Zero-padded number in Urdu digits, never cut."""
    return F.translate(padded_number(number, width), ASCII_DIGITS, URDU_DIGITS)
