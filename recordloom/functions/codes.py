"""Codes, clock times and terms as expressions; null or malformed input gives null unless said otherwise."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_code(c: Column) -> Column:
    """`ABCD 123X` of a code's start, in capitals; anything else trimmed and in capitals."""
    t = F.trim(c)
    letters, number = F.regexp_extract(t, r"^([A-Za-z]+)\s*(\d+[A-Za-z]?)", 1), F.regexp_extract(t, r"^([A-Za-z]+)\s*(\d+[A-Za-z]?)", 2)
    return F.upper(F.when(letters != "", F.concat_ws(" ", letters, number)).otherwise(t))


def prefix(c: Column) -> Column:
    letters = F.regexp_extract(F.trim(c), r"^[A-Za-z]+", 0)
    return F.upper(F.when(letters != "", letters).otherwise(F.trim(c)))


def number(c: Column) -> Column:
    return F.regexp_extract(c, r"\d+", 0).try_cast("int")


def minutes(c: Column) -> Column:
    """`HH:MM` as minutes since midnight, without a check of the ranges."""
    parts = F.regexp_extract_all(c, F.lit(r"^\s*([+-]?\d+)\s*:\s*([+-]?\d+)\s*$"), F.lit(0))
    side = lambda k: F.regexp_extract(c, r"^\s*([+-]?\d+)\s*:\s*([+-]?\d+)\s*$", k).try_cast("int")
    return F.when(F.size(parts) == 1, side(1) * 60 + side(2))


def clock_label(m: Column) -> Column:
    """Minutes as `h:mm AM`."""
    hour = F.pmod(F.floor(m / 60), F.lit(24))
    shown = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    return F.concat(shown.cast("string"), F.lit(":"), F.lpad(F.pmod(m, F.lit(60)).cast("string"), 2, "0"), F.when(hour < 12, " AM").otherwise(" PM"))


def academic_year(term: Column) -> Column:
    """`YYYY-YY` of a five-digit term."""
    year = F.regexp_extract(term, r"^(\d{4})\d$", 1).try_cast("int")
    return F.concat(year.cast("string"), F.lit("-"), F.substring((year + 1).cast("string"), 3, 2))


def season(term: Column) -> Column:
    digit = F.regexp_extract(term, r"^\d{4}(\d)$", 1)
    return F.when(digit == "1", "spring").when(digit == "2", "summer").when(digit == "3", "fall")


def year_range(c: Column) -> Column:
    """`YYYY-YYYY` with a hyphen or an en dash, if the years follow each other."""
    a, b = (F.regexp_extract(c, r"(\d{4})\s*[-–]\s*(\d{4})", k).try_cast("int") for k in (1, 2))
    return F.when(b == a + 1, F.concat_ws("-", a.cast("string"), b.cast("string")))


def leading_number(c: Column) -> Column:
    """The number that a text starts with."""
    return F.regexp_extract(c, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double")


def utc_second(ts: Column) -> Column:
    """A time as `YYYY-MM-DDTHH:MM:SSZ`; the session's zone is UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def day_block(start: Column, end: Column, first: int = 8 * 60, last: int = 21 * 60) -> Column:
    """Struct (top, height): minutes of a block as percent of a calendar day from `first` to `last`."""
    span = last - first
    return F.struct(((start - first) / span * 100).alias("top"), ((end - start) / span * 100).alias("height"))
