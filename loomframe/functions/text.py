"""Text columns: pattern matches, value classes, tokens and masking of personal data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomframe.functions.casts import let, strip

# Patterns of personal data and of tokens that only look like it.
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
LONG_DIGITS = r"\b\+?\d[\d\s().-]{7,}\d\b"
PROTECTED = (
    r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
    r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b\d{2}/\d{2}/\d{4}\b",
    r"\b\d{2}\.\d{2}\.\d{4}\b",
    r"\b[+-]?\d+\.\d+\b",
)

# Classes of text values in order; the first match wins.
VALUE_PATTERNS = (
    ("empty_string", r"^$"),
    ("uuid", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"),
    ("email", EMAIL),
    ("url", r"(?i)^https?://"),
    ("iso_datetime", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"),
    ("iso_date", r"^\d{4}-\d{2}-\d{2}$"),
    ("us_date_format", r"^\d{2}/\d{2}/\d{4}$"),
    ("eu_date_format", r"^\d{2}\.\d{2}\.\d{4}$"),
    ("boolean_string", r"(?i)^(true|false|yes|no|y|n|t|f)$"),
    ("decimal_string", r"^[+-]?\d+\.\d+$"),
    ("sequential_id", r"^[A-Za-z]{0,8}[-_]?\d{3,}$"),
    ("integer_string", r"^[+-]?\d{1,2}$"),
    ("sequential_id", r"^[+-]?\d+$"),
    ("code_short", r"^[A-Z]{2,3}$"),
    ("identifier_like", r"^[A-Z][A-Z0-9_]{2,}$"),
)


def pattern_contains(c: Column, pattern: str) -> Column:
    return F.coalesce(c.cast("string").rlike(pattern), F.lit(False))


def pattern_extract(c: Column, pattern: str) -> Column:
    """First capture group of the first match; NULL when there is none or it is empty."""
    return F.nullif(F.regexp_extract(c.cast("string"), pattern, 1), F.lit(""))


def pattern_count(c: Column, pattern: str) -> Column:
    """Pieces minus one; 0 for missing text."""
    return F.coalesce(F.size(F.split(c.cast("string"), pattern)) - 1, F.lit(0)).cast("int")


def value_pattern(c: Column) -> Column:
    """Class of a text value."""

    def classify(value: Column) -> Column:
        named = F.when(value.isNull(), F.lit("null"))
        for name, pattern in VALUE_PATTERNS:
            named = named.when(value.rlike(pattern), F.lit(name))
        return named.otherwise(F.lit("free_text"))

    return let(strip(c), classify)


def tokens(c: Column) -> Column:
    """Lower-case words: runs of letters and digits."""
    return F.array_remove(F.split(F.lower(c.cast("string")), r"[^\p{L}\p{N}]+"), "")


def _pieces(text: Column, pattern: str) -> tuple[Column, Column]:
    """Text between the matches, and the matches."""
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _rebuild(text: Column, pattern: str, replace) -> Column:
    """Replace every match by ``replace(match)``, where the callback builds a column."""
    between, found = _pieces(text, pattern)
    parts = F.zip_with(between, found, lambda b, m: F.concat(b, F.coalesce(replace(m), F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(parts, "")).otherwise(text)


def mask_emails(c: Column) -> Column:
    """``<email:digest>`` for every address; equal addresses share a digest."""
    return _rebuild(
        c, EMAIL, lambda m: F.concat(F.lit("<email:"), F.substring(F.sha2(m, 256), 1, 10), F.lit(">"))
    )


def _mask_digits(text: Column) -> Column:
    def replace(match: Column) -> Column:
        digits = F.regexp_replace(match, r"\D+", "")
        masked = F.concat(F.lit("<number:"), F.substring(F.sha2(digits, 256), 1, 10), F.lit(">"))
        return F.when(F.length(digits) < 8, match).otherwise(masked)

    return _rebuild(text, LONG_DIGITS, replace)


def mask_long_digits(c: Column) -> Column:
    """``<number:digest>`` for digit runs of eight or more; dates, ids and decimals stay.

    The text is cut at protected tokens, one kind after the other, and only the stretches in
    between are masked. An underscore marks each cut, so that a stretch next to a token has
    no word edge there.
    """
    segment = "struct<text:string,kept:boolean>"
    parts = F.array(F.struct(c.alias("text"), F.lit(False).alias("kept")))

    def cut_at(pattern: str):
        def cut(s: Column) -> Column:
            between, found = _pieces(s["text"], pattern)
            last = F.size(between) - 1
            marked = F.transform(
                between,
                lambda b, i: F.struct(
                    F.concat(
                        F.when(i > 0, F.lit("_")).otherwise(F.lit("")),
                        b,
                        F.when(i < last, F.lit("_")).otherwise(F.lit("")),
                    ).alias("text"),
                    F.lit(False).alias("kept"),
                ),
            )
            kept = F.transform(found, lambda m: F.struct(m.alias("text"), F.lit(True).alias("kept")))
            woven = F.flatten(
                F.zip_with(marked, kept, lambda b, k: F.when(k.isNull(), F.array(b)).otherwise(F.array(b, k)))
            )
            return F.when(s["kept"], F.array(s)).otherwise(woven)

        return cut

    for pattern in PROTECTED:
        parts = F.flatten(F.transform(parts, cut_at(pattern))).cast(f"array<{segment}>")
    count = F.size(parts)

    def finish(s: Column, i: Column) -> Column:
        masked = _mask_digits(s["text"])
        masked = F.when(i > 0, F.substr(masked, F.lit(2))).otherwise(masked)
        masked = F.when(i < count - 1, F.substr(masked, F.lit(1), F.length(masked) - 1)).otherwise(masked)
        return F.when(s["kept"], s["text"]).otherwise(masked)

    # Only text with a long digit run is taken apart.
    return F.when(c.rlike(LONG_DIGITS), F.array_join(F.transform(parts, finish), "")).otherwise(c)


def mask_personal_data(c: Column, max_chars: int | None = None) -> Column:
    """Mask addresses, then long digit runs; optionally cut for display."""
    masked = mask_long_digits(mask_emails(c))
    if max_chars is None:
        return masked
    short = F.concat(F.substring(masked, 1, max(0, max_chars - 1)), F.lit("…"))
    return F.when(F.length(masked) <= max_chars, masked).otherwise(short)
