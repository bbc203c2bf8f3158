"""Times as text: ISO-8601 with a zone in, ISO-8601 with Z out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:?\d{2})$"


def parsed_time(text: Column) -> Column:
    """The instant that a text names; null if the text is null or no time with a zone."""
    return F.when(text.rlike(ISO_TIME), F.try_to_timestamp(text))


def required_time(text: Column, what: str) -> Column:
    """parsed_time(), or an error that names the text; null stays null."""
    found = parsed_time(text)
    return F.when(text.isNotNull() & found.isNull(), F.raise_error(F.concat(F.lit(f"{what} is no time with a zone: "), text)).cast("timestamp")).otherwise(found)


def time_text(at: Column) -> Column:
    """An instant as text with microseconds and Z, whatever the session's zone; null stays null."""
    us = F.unix_micros(at)
    day, rest = F.floor(us / F.lit(86_400_000_000)), F.pmod(us, F.lit(86_400_000_000))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    second = F.floor(rest / F.lit(1_000_000))
    clock = F.concat_ws(":", two(F.floor(second / 3600)), two(F.pmod(F.floor(second / 60), F.lit(60))), two(F.pmod(second, F.lit(60))))
    return F.concat(F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")).cast("string"), F.lit("T"), clock, F.lit("."), F.lpad(F.pmod(us, F.lit(1_000_000)).cast("string"), 6, "0"), F.lit("Z"))
