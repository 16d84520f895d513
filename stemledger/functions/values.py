"""Column expressions on single values: casts, diameters, years, dataset ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that stand for "no diameter", compared in lower case.
MISSING_DBH_TEXTS = ("", "na", "n/a", "nan", "null", "nd", ".")

# Number texts the JVM parser takes but a data file does not mean as a number:
# a trailing Java type letter ("10d", "3.f") and hexadecimal floats.
_JAVA_ONLY_NUMBER = r"(?i)[0-9.][df]\s*$|^\s*[+-]?0x"

# How every text begins that a cast takes: a failing cast raises and catches an error, which costs far more than this look.
_BEGINS_NUMBER = r"^[\x00-\x20]*[+-]?[0-9.iInN]"  # with the words for infinity and not-a-number
_BEGINS_INTEGER = r"^[\x00-\x20\x7f]*[+-]?[0-9]"


def col(name: str) -> Column:
    """Reference a source column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def safe_cast(value: Column, to: T.DataType) -> Column:
    """Cast that gives null instead of raising, whatever the ANSI mode."""
    return value.try_cast(to)


def parsed_double(text: Column) -> Column:
    """Number in a text column as double; null when the text is not a number."""
    return F.when(text.rlike(_BEGINS_NUMBER) & ~text.rlike(_JAVA_ONLY_NUMBER), text.try_cast("double"))


def parsed_integer(text: Column, dtype: T.DataType) -> Column:
    """Whole number in a text column, also written like ``2010.0`` or ``2.01e3``; null for anything else."""
    number = parsed_double(text)
    # a text with a point is never cast to a whole number
    plain = F.when(~text.contains(".") & text.rlike(_BEGINS_INTEGER), text.try_cast(dtype))
    return F.coalesce(plain, F.when(number == F.floor(number), number.try_cast(dtype)))


def normalised_dbh(value: Column, dtype: T.DataType) -> Column:
    """Diameter as double, with NaN and the missing-value texts turned into null.

    Numeric columns need no text comparison, so they stay a plain cast.
    """
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        number = value.cast("double")
        return F.when(~F.isnan(number), number)
    if isinstance(dtype, T.NumericType):
        return value.cast("double")
    text = value.cast("string")
    number = parsed_double(text)
    return F.when(
        ~F.lower(text).isin(*MISSING_DBH_TEXTS) & ~F.isnan(number), number
    )


def centimetres(value: Column) -> Column:
    """Millimetres to centimetres."""
    return value / F.lit(10.0)


def year_of(value: Column, dtype: T.DataType) -> Column:
    """Census year of a date, timestamp or text column.

    Dates, also as text, give their calendar year. Any other value gives its first
    four digits that have no digit beside them, or null when there are none.
    """
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.year(value)
    text = value.cast("string")
    year = F.regexp_extract(text, r"(?<!\d)(\d{4})(?!\d)", 1).try_cast("int")
    # only text with separators is read as a date: plain digits are years or serial numbers
    dated = F.when(text.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}"), F.year(F.try_to_timestamp(text)))
    return F.coalesce(dated, year)


def dataset_id(iso3: Column, last_name: Column, year: Column, single: Column) -> Column:
    """``in_{iso3}_{last}_{year}_{s|m}`` in lower case, empty when a part is missing."""
    iso = F.coalesce(F.lower(iso3), F.lit(""))
    last = F.coalesce(F.regexp_replace(F.lower(last_name), r"[\s-]+", ""), F.lit(""))
    digits = F.coalesce(
        F.substring(F.regexp_replace(year.cast("string"), r"\D", ""), 1, 4), F.lit("")
    )
    kind = F.when(single, "s").otherwise("m")
    complete = (iso != "") & (last != "") & (digits != "")
    return F.when(
        complete, F.concat_ws("_", F.lit("in"), iso, last, digits, kind)
    ).otherwise(F.lit(""))
