"""Slugs, quoting and number formatting."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SLUG = 100  # fixed value
UNTITLED = "untitled"  # fixed value


def bound(value: Column, build: Callable[[Column], Column]) -> Column:
    """`build(value)` with `value` evaluated once, however often the result mentions it."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


@cache
def _accent_map() -> tuple[str, str]:
    """Characters that canonically decompose to one ASCII character plus combining marks."""
    accented, plain = [], []
    for code in range(0x80, sys.maxunicode + 1):
        base = [c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn"]
        if len(base) == 1 and ord(base[0]) < 0x80:
            accented.append(chr(code))
            plain.append(base[0])
    return "".join(accented), "".join(plain)


def slug(value: Column) -> Column:
    """File-name form of a title: `[a-z][a-z0-9-]*`, at most 100 characters, never empty."""
    text = F.lower(F.translate(value, *_accent_map()))
    text = F.regexp_replace(text, r"[ _/\\:|]", "-")
    text = F.regexp_replace(text, "[^a-z0-9-]", "")
    text = F.regexp_replace(text, "-{2,}", "-")
    text = F.regexp_replace(text, "^[^a-z]+|-$", "")
    text = F.regexp_replace(F.substring(text, 1, MAX_SLUG), "-$", "")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(UNTITLED))


_UNPRINTABLE = r"[\p{C}\p{Z}&&[^ ]]"
_SPECIAL = r"[\p{C}\p{Z}\"\\&&[^ ]]"
# fixed values: characters with an escape of their own
_NAMED = (
    r"""map('"', r'\"', r'\', r'\\', char(7), r'\a', char(8), r'\b', char(12), r'\f', """
    r"""char(10), r'\n', char(13), r'\r', char(9), r'\t', char(11), r'\v')"""
)


def _escaped(char: Column) -> Column:
    code = F.ascii(char)
    width = F.when(code < 0x80, 2).when(code < 0x10000, 4).otherwise(8)
    mark = F.when(code < 0x80, "\\x").when(code < 0x10000, "\\u").otherwise("\\U")
    numbered = F.concat(mark, F.lpad(F.lower(F.hex(code)), width, F.lit("0")))
    return F.coalesce(
        F.try_element_at(F.expr(_NAMED), char),
        F.when(char.rlike(_UNPRINTABLE), numbered).otherwise(char),
    )


def quoted(value: Column) -> Column:
    """Double-quoted text with backslash escapes; only printable characters stay as they are."""

    def build(text: Column) -> Column:
        escaped = F.array_join(F.transform(F.split(text, ""), _escaped), "")
        return F.concat(
            F.lit('"'), F.when(text.rlike(_SPECIAL), escaped).otherwise(text), F.lit('"')
        )

    return bound(value, build)


def plain_number(value: Column) -> Column:
    """Shortest decimal digits of a double, never in exponent form, without a trailing `.0`."""
    printed = value.cast("string")
    # the JVM may print more digits than needed, so long forms are tried with 15 and 16 digits
    rounded = [F.upper(F.format_string(f"%.{digits}e", value)) for digits in (14, 15)]
    shorter = [F.when(text.cast("double") == value, text) for text in rounded]
    text = F.when(F.length(printed) > 16, F.coalesce(*shorter, printed)).otherwise(printed)

    def parts(text: Column) -> Column:
        return F.struct(
            F.regexp_extract(text, r"^(-?)", 1).alias("sign"),
            F.regexp_extract(text, r"^-?(\d+)", 1).alias("whole"),
            F.regexp_replace(F.regexp_extract(text, r"\.(\d+)", 1), "0+$", "").alias("fraction"),
            F.coalesce(F.regexp_extract(text, r"E([+-]?\d+)$", 1).try_cast("int"), F.lit(0)).alias("exponent"),
        )

    def shifted(number: Column) -> Column:
        fraction, exponent = number["fraction"], number["exponent"]
        padded = F.rpad(fraction, F.greatest(exponent, F.length(fraction)), F.lit("0"))
        large = F.concat(
            number["whole"],
            F.substr(padded, F.lit(1), exponent),
            F.when(F.length(fraction) > exponent, F.concat(F.lit("."), F.substr(fraction, exponent + 1, F.length(fraction))))
            .otherwise(F.lit("")),
        )
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), number["whole"], fraction)
        return F.concat(number["sign"], F.when(exponent < 0, small).otherwise(large))

    return bound(bound(text, parts), shifted)


def rfc3339(value: Column) -> Column:
    """UTC seconds; a missing time prints as the year 1."""
    return F.coalesce(
        F.date_format(value, "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit("0001-01-01T00:00:00Z")
    )


def trim_space(value: Column) -> Column:
    """Trim all Unicode white space, not just blanks."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def age_label(then: Column, now: Column) -> Column:
    """How long ago `then` was, as shown in status reports."""
    seconds = F.unix_seconds(now) - F.unix_seconds(then)

    def units(size: int, name: str) -> Column:
        amount = F.floor(seconds / F.lit(size)).cast("bigint")
        return F.concat(amount.cast("string"), F.lit(f" {name}"),
                        F.when(amount == 1, F.lit("")).otherwise(F.lit("s")), F.lit(" ago"))

    minute, hour, day = 60, 3600, 86400
    return (
        F.when(then.isNull(), F.lit("never"))
        .when(seconds < minute, F.lit("just now"))
        .when(seconds < hour, units(minute, "minute"))
        .when(seconds < day, units(hour, "hour"))
        .when(seconds < 7 * day, units(day, "day"))
        .when(seconds < 30 * day, units(7 * day, "week"))
        .otherwise(units(30 * day, "month"))
    )
