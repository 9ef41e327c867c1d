"""Turning raw cells and header names into typed columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal number. Spark's own cast also takes "1.0d", "0x1p3", "nan"
# and "inf"; those are not measurements and become null.
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
NBSP = "\u00a0"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _strict_double(text: Column) -> Column:
    return finite(F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double")))


def finite(value: Column) -> Column:
    """Null instead of NaN or an infinity: null is the only missing marker."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)


def repair_numeric(cell: Column) -> Column:
    """Number from a hand-typed cell: nbsp, decimal comma and a Cyrillic be for 6."""
    text = _strip(F.translate(cell.cast("string"), NBSP, " "))
    return _strict_double(F.translate(text, "б,", "6."))


def coerce_numeric(cell: Column) -> Column:
    """Number from a clean cell; anything else is null."""
    return _strict_double(_strip(cell.cast("string")))


def half_even_int(value: Column) -> Column:
    return F.rint(value).cast("int")


def binary_half_even(value: Column) -> Column:
    """Round half to even, then clip to 0..1."""
    return F.when(value.isNotNull(), F.least(F.greatest(F.rint(value), F.lit(0.0)), F.lit(1.0)))


def rain_flag(value: Column) -> Column:
    return binary_half_even(F.coalesce(value, F.lit(0.0)))


def is_leap(year: Column) -> Column:
    return F.dayofyear(F.make_date(year.cast("int"), F.lit(12), F.lit(31))) == 366


def season_start(year: Column) -> Column:
    """Day of the year of June 1st."""
    return F.when(is_leap(year), F.lit(153)).otherwise(F.lit(152))


def normalize_name(name: object, gt_word: bool = False) -> str:
    """Lower-case header name with single underscores; ``gt_word`` spells out ``>``."""
    text = str(name).strip().lower()
    if gt_word:
        text = text.replace(">", "_gt_")
    return re.sub(r"_+", "_", re.sub(r"\W", "_", text)).strip("_")


_HEADER_WORDS = re.compile("[0-9a-zA-Zа-яА-Я]+")


def snake_name(name: object) -> str:
    """The Latin, Cyrillic and numeric words of a header, lower-case, joined by underscores; ``>`` reads as ``gt``."""
    return "_".join(_HEADER_WORDS.findall(str(name).replace(">", " gt "))).lower()
