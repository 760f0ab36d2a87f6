"""Recognising numbers, booleans and dates in text columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts read as booleans (fixed values).
BOOLEAN_TOKENS = ("True", "False", "true", "false", "T", "F", "1", "0")

# Texts read as missing by the CSV source (fixed values, the CSV reader defaults of pandas).
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

NUMBER_PATTERN = (
    r"^\s*+[+-]?(?:(?:\d++(?:\.\d*+)?|\.\d++)(?:[eE][+-]?\d++)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?)\s*+$"
)
WHOLE_NUMBER_PATTERN = r"^\s*+[+-]?\d++\s*+$"


class DateFormat(NamedTuple):
    """``shapes`` are the texts it accepts, written as :func:`date_shape` does.

    The parser only runs on texts of a matching shape, as refusing a text is what takes it longest.
    """

    pattern: str
    shapes: tuple[str, ...]
    has_day: bool = True


_FRACTIONS = ("", ".999", ".999999", ".999999999")
_ZONES = ("", "z", "+99:99", "-99:99")
_DAY_TIME = "99:99:99"
_SHORT_DAYS = ("9/9/9999", "9/99/9999", "99/9/9999", "99/99/9999")
_DAYS = ("9", "99")
# The short form of May is the long one, too.
_LONG_MONTHS = ("month", "mon")

# Names of months (fixed values).
_MONTH = "january|february|march|april|june|july|august|september|october|november|december"
_MON = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"

# Date formats tried in this order (fixed values).
DATE_FORMATS = (
    DateFormat("yyyy-MM-dd", ("9999-99-99",)),
    DateFormat("yyyy/MM/dd", ("9999/99/99",)),
    DateFormat("dd/MM/yyyy", ("99/99/9999",)),
    DateFormat("MM/dd/yyyy", ("99/99/9999",)),
    DateFormat("dd-MM-yyyy", ("99-99-9999",)),
    DateFormat("dd.MM.yyyy", ("99.99.9999",)),
    DateFormat("yyyy-MM-dd HH:mm", ("9999-99-99 99:99",)),
    DateFormat(
        "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]",
        tuple(f"9999-99-99 {_DAY_TIME}{f}" for f in _FRACTIONS),
    ),
    DateFormat(
        "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS][XXX]",
        tuple(f"9999-99-99t{_DAY_TIME}{f}{z}" for f in _FRACTIONS for z in _ZONES),
    ),
    DateFormat("yyyy/MM/dd HH:mm:ss", (f"9999/99/99 {_DAY_TIME}",)),
    DateFormat("dd/MM/yyyy HH:mm:ss", (f"99/99/9999 {_DAY_TIME}",)),
    DateFormat("MM/dd/yyyy HH:mm:ss", (f"99/99/9999 {_DAY_TIME}",)),
    DateFormat("yyyy-M-d", ("9999-9-9", "9999-9-99", "9999-99-9", "9999-99-99")),
    DateFormat("d/M/yyyy", _SHORT_DAYS),
    DateFormat("M/d/yyyy", _SHORT_DAYS),
    DateFormat("MMM d, yyyy", tuple(f"mon {d}, 9999" for d in _DAYS)),
    DateFormat("yyyy-MM-dd'T'HH:mm", ("9999-99-99t99:99",)),
    DateFormat("dd/MM/yyyy HH:mm", ("99/99/9999 99:99",)),
    DateFormat("MM/dd/yyyy HH:mm", ("99/99/9999 99:99",)),
    DateFormat("yyyy-MM-dd HH:mm:ssXXX", tuple(f"9999-99-99 {_DAY_TIME}{z}" for z in _ZONES[1:])),
    DateFormat("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XX", tuple(f"9999-99-99t{_DAY_TIME}{f}{z}9999" for f in _FRACTIONS for z in "+-")),
    DateFormat("yyyy-MM-dd HH:mm:ss[ ]XX", tuple(f"9999-99-99 {_DAY_TIME}{g}{z}9999" for g in ("", " ") for z in "+-")),
    DateFormat("d MMM yyyy", tuple(f"{d} mon 9999" for d in _DAYS)),
    DateFormat("d-MMM-yyyy", tuple(f"{d}-mon-9999" for d in _DAYS)),
    DateFormat("MMMM d, yyyy", tuple(f"{m} {d}, 9999" for m in _LONG_MONTHS for d in _DAYS)),
    DateFormat("d MMMM yyyy", tuple(f"{d} {m} 9999" for m in _LONG_MONTHS for d in _DAYS)),
    DateFormat("dd/MM/yy", ("99/99/99",)),
    DateFormat("MM/dd/yy", ("99/99/99",)),
    DateFormat("MM/dd/yyyy hh:mm:ss a", (f"99/99/9999 {_DAY_TIME} am",)),
    DateFormat("MM/dd/yyyy hh:mm a", ("99/99/9999 99:99 am",)),
    DateFormat("h:mm[:ss] a", ("9:99 am", "99:99 am", "9:99:99 am", "99:99:99 am"), has_day=False),
)
KNOWN_SHAPES = tuple(sorted({s for fmt in DATE_FORMATS for s in fmt.shapes}))
# "month" is five letters for up to nine.
LONGEST_DATE = max(map(len, KNOWN_SHAPES)) + 4


def looks_boolean(c: Column) -> Column:
    return c.isin(list(BOOLEAN_TOKENS))


def looks_numeric(c: Column) -> Column:
    return c.rlike(NUMBER_PATTERN)


def looks_whole(c: Column) -> Column:
    return c.rlike(WHOLE_NUMBER_PATTERN)


def date_shape(c: Column) -> Column:
    """The text in small letters with every digit written as 9, months as ``mon`` or ``month`` and ``pm`` as ``am``.

    NULL for a text longer than any date.
    """
    shape = F.translate(F.lower(c), "012345678", "999999999")
    named = F.regexp_replace(F.regexp_replace(shape, rf"\b(?:{_MONTH})\b", "month"), rf"\b(?:{_MON})\b", "mon")
    lettered = F.when(F.regexp_like(shape, F.lit("[a-y]")), F.regexp_replace(named, " pm$", " am")).otherwise(shape)
    return F.when(F.length(c) <= LONGEST_DATE, lettered)


def parse_with(c: Column, shape: Column, fmt: DateFormat) -> Column:
    """The text read with one format; years of two digits are those from 1969 to 2068."""
    read = F.try_to_timestamp(c, F.lit(fmt.pattern))
    if "yy" in fmt.pattern and "yyyy" not in fmt.pattern:
        read = F.when(F.year(read) > 2068, read - F.expr("INTERVAL 100 YEARS")).otherwise(read)
    return F.when(shape.isin(*fmt.shapes), read)


def parse_as(c: Column, fmt: DateFormat) -> Column:
    """The text read with one format, as a timestamp without time zone; NULL where it does not fit."""
    return parse_with(c, date_shape(c), fmt).cast("timestamp_ntz")
