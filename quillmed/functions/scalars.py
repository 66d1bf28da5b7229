"""Column functions on dirty strings, names, ranges and identifiers. All are Spark built-ins, so
they stay inside the stage that uses them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Narrow and non-breaking blanks that reports put between digits.
THIN_BLANKS = "\u202f\u00a0"


def number(c: Column) -> Column:
    return c.try_cast("double")


def parse_value(c: Column) -> Column:
    """A measured value: decimal comma or point, special blanks ignored; other text is null."""
    return number(F.translate(F.translate(F.trim(c), ",", "."), THIN_BLANKS, ""))


def parse_range(c: Column) -> Column:
    """'< x', '<= x', '> x', '>= x' or 'a - b' with open sides -> struct(low, high). An operator
    counts only before a blank. A pair with a side that is no number is no range."""
    s = F.trim(F.translate(c, ",", "."))
    words, sides = F.split(s, r"\s+"), F.split(s, "-")
    first, second = F.get(words, 0), number(F.get(words, 1))
    lo, hi = F.trim(F.get(sides, 0)), F.trim(F.get(sides, 1))
    fine = (F.size(sides) == 2) & ((lo == "") | number(lo).isNotNull()) & ((hi == "") | number(hi).isNotNull())
    pair = fine & ~first.isin("<", "<=", ">", ">=")
    return F.struct(F.when(first.isin(">", ">="), second).when(pair, number(lo)).alias("low"),
                    F.when(first.isin("<", "<="), second).when(pair, number(hi)).alias("high"))


def parse_time(c: Column, fmt: str = "yyyy-MM-dd HH:mm") -> Column:
    return F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz")


def clean_name(c: Column) -> Column:
    """Line breaks and runs of blanks become one blank."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def plain_hyphens(c: Column) -> Column:
    """Non-breaking hyphens become ASCII ones, so that names join."""
    return F.translate(c, "\u2010\u2011\u2012", "---")


def bracket_text(c: Column) -> Column:
    """Text of the first bracket pair, null without one."""
    return F.nullif(F.regexp_extract(c, r"\(([^)]*)\)", 1), F.lit(""))


def day_span(later: Column, earlier: Column) -> Column:
    """Whole elapsed days of 24 hours between two timestamps."""
    return F.floor(F.timestamp_diff("MICROSECOND", earlier, later) / 86400000000)


def kebab(c: Column) -> Column:
    """Lower-case identifier of letters, digits and single hyphens; 'n' goes before a non-letter."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(F.rlike(s, F.lit("^[a-z]")), s).otherwise(F.concat(F.lit("n"), s))


def label_stem(c: Column) -> Column:
    """Label normal form: trimmed, lower case, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


def md5_bucket(c: Column, buckets: int) -> Column:
    """A bucket from the first 32 bits of md5, the same in every engine."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long") % buckets
