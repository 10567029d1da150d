"""Text to typed values: lenient casts, locale-aware numbers, dates in many layouts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings.
TRUE_WORDS = ("true", "t", "1", "yes", "y")
FALSE_WORDS = ("false", "f", "0", "no", "n")

SPARK_TYPES = {
    "string": "string",
    "integer": "bigint",
    "decimal": "double",
    "boolean": "boolean",
    "date": "date",
    "timestamp": "timestamp",
}


def text(c: Column) -> Column:
    return c.cast("string")


def strip(c: Column) -> Column:
    """Remove every kind of leading and trailing whitespace."""
    return F.btrim(text(c), F.lit(" \t\n\r\f\x0b"))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(text(c)), F.lit(""))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def _clean_number(c: Column, also: str = "") -> Column:
    return F.regexp_replace(blank_to_null(c), rf"[,_\s]{also}", "")


def safe_cast(c: Column, kind: str) -> Column:
    """Lenient cast: anything that does not parse becomes NULL."""
    if kind == "string":
        return blank_to_null(c)
    if kind == "integer":
        return _clean_number(c).try_cast("bigint")
    if kind == "decimal":
        return F.regexp_replace(_clean_number(c), "%$", "").try_cast("double")
    if kind == "boolean":
        word = F.lower(blank_to_null(c))
        return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))
    return blank_to_null(c).try_cast(SPARK_TYPES[kind])


def strict_cast(c: Column, kind: str) -> Column:
    """Cast that fails the job on a bad value (ANSI)."""
    return c.cast(SPARK_TYPES[kind])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name an expression once inside a larger one, so that it is evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def _with_number(c: Column, finish: Callable[[Column, Column], Column]) -> Column:
    """Hand (bare digits and separators, negative?) to ``finish``."""

    def bare(raw: Column) -> Column:
        bracketed = raw.rlike(r"^\(.*\)$")
        body = F.when(bracketed, F.regexp_replace(raw, r"^\(\s*|\s*\)$", "")).otherwise(raw)
        body = F.regexp_replace(F.replace(body, F.lit("$"), F.lit("")), r"^[A-Za-z]{1,5}\s+|\s+[A-Za-z]{1,5}$", "")
        return F.struct(strip(F.regexp_replace(body, "%$", "")).alias("b"), bracketed.alias("n"))

    def signed(t: Column) -> Column:
        body = F.regexp_replace(t["b"], r"^[+-]|[\s_]", "")
        return F.struct(F.nullif(body, F.lit("")).alias("b"), (t["n"] | t["b"].startswith("-")).alias("n"))

    # Text without a digit is no number: one cheap test spares the rest.
    given = F.when(text(c).rlike(r"\d"), text(c))
    return let(strip(given), lambda raw: let(let(bare(raw), signed), lambda t: finish(t["b"], t["n"])))


def _canonical_number(body: Column) -> Column:
    """Settle which separator is the decimal point."""
    comma, dot = body.contains(","), body.contains(".")
    no_comma = F.replace(body, F.lit(","), F.lit(""))
    no_dot = F.replace(body, F.lit("."), F.lit(""))
    return (
        F.when(~comma & ~body.rlike(r"\..*\."), body)
        .when(comma & dot & body.rlike(r"\.[^.]*,[^.]*$"), F.replace(no_dot, F.lit(","), F.lit(".")))
        .when(comma & ~dot & body.rlike(r"^\d+,\d{1,2}$"), F.replace(body, F.lit(","), F.lit(".")))
        .when(comma, no_comma)
        .when(body.rlike(r"\.\d{3}$"), no_dot)
        .otherwise(body)
    )


def _decimal(body: Column, negative: Column) -> Column:
    def value(plain: Column) -> Column:
        number = F.when(plain.rlike(r"^\d+(\.\d+)?$"), plain.try_cast("double"))
        return F.when(negative, -number).otherwise(number)

    return let(_canonical_number(body), value)


def _integer(body: Column, negative: Column) -> Column:
    def value(plain: Column) -> Column:
        number = F.when(plain.rlike(r"^\d+$"), plain.try_cast("bigint"))
        return F.when(negative, F.negate(number)).otherwise(number)

    return let(_canonical_number(body), value)


def parse_decimal(c: Column) -> Column:
    """Number in US or European writing, with currency, percent, sign or brackets."""
    plain = text(c).rlike(r"^-?\d+(\.\d+)?$")  # already in the target writing
    return F.when(plain, text(c).try_cast("double")).otherwise(_with_number(c, _decimal))


def parse_integer(c: Column) -> Column:
    return _with_number(c, _integer)


def parse_number(c: Column) -> Column:
    """struct(value, is_ambiguous, alternative); "1.234" may also mean 1234."""

    def finish(body: Column, negative: Column) -> Column:
        unclear = F.coalesce(body.rlike(r"^\d+\.\d{3}$"), F.lit(False))
        joined = F.replace(body, F.lit("."), F.lit("")).try_cast("double")
        other = F.when(unclear, F.when(negative, -joined).otherwise(joined))
        return F.struct(_decimal(body, negative).alias("value"), unclear.alias("is_ambiguous"), other.alias("alternative"))

    return _with_number(c, finish)


def number_kinds(c: Column) -> Column:
    """struct(integer, decimal): does the text read as one, from a single parse."""

    def kinds(body: Column, negative: Column) -> Column:
        return let(
            _canonical_number(body),
            lambda plain: F.struct(
                F.coalesce(plain.rlike(r"^\d+$") & plain.try_cast("bigint").isNotNull(), F.lit(False)).alias("integer"),
                F.coalesce(plain.rlike(r"^\d+(\.\d+)?$"), F.lit(False)).alias("decimal"),
            ),
        )

    def both(integer: Column, decimal: Column) -> Column:
        return F.struct(integer.alias("integer"), decimal.alias("decimal"))

    # Plain writing needs no parsing.
    return (
        F.when(text(c).rlike(r"^[+-]?\d+$"), both(text(c).try_cast("bigint").isNotNull(), F.lit(True)))
        .when(text(c).rlike(r"^[+-]?\d+\.\d+$"), both(F.lit(False), F.lit(True)))
        .otherwise(_with_number(c, kinds))
    )


_YEAR_FIRST = (
    r"(?i)^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?:[ T](\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,6}))?)?)?"
    r"\s*(Z|UTC|GMT|[+-]\d{2}:?\d{2})?$"
)
_COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
_YEAR_LAST = r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4})$"


def _groups(raw: Column, pattern: str, wanted: Sequence[int]) -> Column:
    """Capture groups of a full match as an array, from a single match."""
    return F.split(F.regexp_replace(raw, pattern, ",".join(f"${i}" for i in wanted)), ",", -1)


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))


def parse_datetime(c: Column, allow_ambiguous: bool = True) -> Column:
    """struct(value, is_ambiguous, alternative). Year-first, compact and m/d/y or d/m/y dates.

    When month and day could be swapped the month comes first and the other reading is kept
    as the alternative.
    """

    def result(value: Column, unclear: Column | None = None, other: Column | None = None) -> Column:
        return F.struct(
            value.alias("value"),
            (F.lit(False) if unclear is None else unclear).alias("is_ambiguous"),
            (F.lit(None).cast("timestamp") if other is None else other).alias("alternative"),
        )

    def year_first(p: Column) -> Column:
        def clock(i: int) -> Column:
            return F.lpad(F.coalesce(F.nullif(p[i], F.lit("")), F.lit("0")), 2, "0")

        zone = F.when(p[7].rlike(r"^[+-]"), F.regexp_replace(p[7], r"^([+-]\d{2}):?(\d{2})$", "$1:$2")).otherwise("Z")
        stamp = F.concat(
            _day(p[0], p[1], p[2]), F.lit(" "), F.concat_ws(":", clock(3), clock(4), clock(5)), F.lit("."), F.rpad(p[6], 6, "0"), zone
        )
        return result(stamp.try_cast("timestamp"))

    def year_last(p: Column) -> Column:
        first, second = p[0].cast("int"), p[1].cast("int")
        month_first = _day(p[2], p[0], p[1]).try_cast("timestamp")
        day_first = _day(p[2], p[1], p[0]).try_cast("timestamp")
        unclear = (first <= 12) & (second <= 12)
        guess = month_first if allow_ambiguous else F.lit(None).cast("timestamp")
        value = F.when(unclear, guess).when(first > 12, day_first).otherwise(month_first)
        flag = unclear & value.isNotNull()
        return result(value, flag, F.when(flag, day_first))

    def read(raw: Column) -> Column:
        return (
            F.when(raw.rlike(_YEAR_FIRST), let(_groups(raw, _YEAR_FIRST, (1, 3, 4, 5, 6, 7, 8, 9)), year_first))
            .when(raw.rlike(_COMPACT), result(F.regexp_replace(raw, _COMPACT, "$1-$2-$3").try_cast("timestamp")))
            .when(raw.rlike(_YEAR_LAST), let(_groups(raw, _YEAR_LAST, (1, 3, 4)), year_last))
            .otherwise(result(F.lit(None).cast("timestamp")))
        )

    # Every layout starts with a digit; other text is done after one cheap test.
    return let(F.when(text(c).rlike(r"^\s*\d"), strip(c)), read)


def is_bool_like(c: Column) -> Column:
    return F.lower(strip(c)).isin("true", "false")


def is_int_like(c: Column) -> Column:
    return parse_integer(c).isNotNull()


def is_decimal_like(c: Column) -> Column:
    return parse_decimal(c).isNotNull()


def is_datetime_like(c: Column, allow_ambiguous: bool = False) -> Column:
    return parse_datetime(c, allow_ambiguous)["value"].isNotNull()
