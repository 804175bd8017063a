"""Scalar functions as column expressions, all inside code generation."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import TYPE_LABELS

#: White space of a pattern's \s and of trimming, byte-order mark included. Fixed value.
BLANK = r"[ \t\n\x0B\f\r\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: The same characters, one by one.
BLANKS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
DAY_MS = 86_400_000


def as_column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_all(x) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(as_column(x), F.lit(BLANKS))


def round_half_up(x) -> Column:
    """Nearest whole number, halves towards plus infinity."""
    return F.floor(as_column(x) + 0.5).cast("long")


def text_to_santim(x) -> Column:
    """Commas out, trimmed, times 100 as a double, rounded; no text left is 0, no number is null."""
    clean = trim_all(F.replace(as_column(x), F.lit(","), F.lit("")))
    number = F.when(clean == "", F.lit(0.0)).otherwise(clean.try_cast("double"))
    return round_half_up(number * 100)


def entry_to_santim(x) -> Column:
    """Form entry: only digits and points count; nothing left or no number is null."""
    clean = F.regexp_replace(as_column(x), "[^0-9.]", "")
    return round_half_up(F.when(clean != "", clean.try_cast("double")) * 100)


def santim_to_etb(x) -> Column:
    return (as_column(x).cast("decimal(20,2)") / 100).cast("decimal(20,2)")


def format_etb(x, symbol: bool = True) -> Column:
    """Grouped thousands, two decimals, the currency after it."""
    text = F.format_number(santim_to_etb(x), 2)
    return F.concat(text, F.lit(" ETB")) if symbol else text


def signed_etb(positive: Column, x) -> Column:
    """Amount without its sign behind + or − (U+2212)."""
    return F.concat(F.when(positive, "+").otherwise("−"), format_etb(F.abs(as_column(x))))


def type_label(x) -> Column:
    labels = F.create_map(*map(F.lit, chain.from_iterable(TYPE_LABELS.items())))
    return F.try_element_at(labels, as_column(x))


def iso_millis(x) -> Column:
    """Epoch milliseconds of an ISO date; null where it is none."""
    return F.unix_millis(F.try_to_timestamp(as_column(x)))


def millis_iso(ms: Column) -> Column:
    """ISO date in UTC of epoch milliseconds, whatever the session's zone."""
    at = F.timestamp_add("MILLISECOND", ms, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def local_time(ms: Column, tz: str) -> Column:
    """Wall-clock time in zone tz of epoch milliseconds, without a zone."""
    at = F.timestamp_add("MILLISECOND", ms, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), at)


def local_day(ms: Column, tz: str) -> Column:
    """Calendar day in zone tz of epoch milliseconds."""
    return F.to_date(local_time(ms, tz))


def start_of_day(ms: Column, tz: str) -> Column:
    """ISO date in UTC of the midnight that began the local day."""
    midnight = F.convert_timezone(F.lit(tz), F.lit("UTC"), local_day(ms, tz).cast("timestamp_ntz"))
    return F.date_format(midnight, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def format_day(ms: Column, tz: str) -> Column:
    return F.date_format(local_day(ms, tz), "MMM dd, yyyy")


def format_moment(ms: Column, tz: str) -> Column:
    return F.date_format(local_time(ms, tz), "MMM dd, yyyy, HH:mm")


def utc_day(date) -> Column:
    return F.substring(as_column(date), 1, 10)


def csv_cell(x) -> Column:
    """Null is empty; a cell a spreadsheet would run gets an apostrophe; cells with comma, quote or line feed are quoted."""
    s = F.coalesce(as_column(x).cast("string"), F.lit(""))
    s = F.when(s.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), s)).otherwise(s)
    return F.when(s.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)
