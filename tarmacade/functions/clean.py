"""Column expressions for dirty scalars: stripping, absent values, instants, numbers.

All of them are built-in expressions, so they stay inside whole-stage code generation
and cost no Python round trip.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that a strip removes, and the spellings of absence.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
ABSENT = ("", "null", "none")


def as_column(value: Column | str) -> Column:
    """A column from its name or itself."""
    return F.col(value) if isinstance(value, str) else value


def stripped(value: Column | str) -> Column:
    """The string without white space at either end; null stays null."""
    return F.btrim(as_column(value), F.lit(WHITE_SPACE))


def present(value: Column | str) -> Column:
    """The stripped string, or null where it is absent (null, blank, `null`, `none`)."""
    s = stripped(value)
    return F.when(~F.lower(s).isin(*ABSENT), s)


def instant(value: Column | str) -> Column:
    """The instant that a date string means, or null if it means none.

    Accepts what a cast to timestamp accepts: a space or a T between date and time, seconds
    and fractions optional, zone optional (the session's zone if there is none).
    """
    return F.try_to_timestamp(present(value))


def instant_or_text(value: Column | str) -> Column:
    """A comparable string: the instant in microseconds, else the stripped string itself."""
    return F.coalesce(F.unix_micros(instant(value)).cast("string"), present(value))


def leading_number(value: Column | str) -> Column:
    """The digits a string starts with, as an int, 0 if there are none or they exceed an int."""
    digits = F.regexp_extract(as_column(value), r"^\s*(\d+)", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def language_code(value: Column | str) -> Column:
    """The primary subtag in lower case (`en_GB ` is `en`), null where absent."""
    return F.lower(F.regexp_extract(present(value), r"^([A-Za-z]+)", 1))


def source_name(value: Column | str) -> Column:
    """A source's name in one spelling: stripped, lower case, `_` for `-` and blanks."""
    return F.regexp_replace(F.lower(present(value)), r"[-\s]+", "_")
