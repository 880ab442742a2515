"""Times as boards write them, ages, dates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: numbers above this are milliseconds
MS_FROM = 10_000_000_000

# Accepted besides ISO 8601; anything else is null.  A zone-less time is UTC
# (the session time zone must be UTC).
_FORMATS = ("yyyy/MM/dd", "dd MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy")


def clock(as_of: datetime | str | Column) -> Column:
    """The run's clock as a timestamp column; never the wall clock inside a rule."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def parse_dt(text: Column) -> Column:
    """Epoch seconds or milliseconds as digits, else a date or time; null if unreadable."""
    number = F.expr("cast(null as bigint)")
    number = F.when(text.rlike(r"^[0-9]{1,18}$"), text.try_cast("bigint")).otherwise(number)
    seconds = F.when(number > MS_FROM, F.floor(number / 1000)).otherwise(number)
    # timestamps end with year 9999
    epoch = F.when(seconds < 253402300800, F.timestamp_seconds(seconds))
    iso = F.when(text.rlike(r"^\s*\d{4}-\d{1,2}"), F.trim(text).try_cast("timestamp"))
    other = [F.try_to_timestamp(text, F.lit(f)) for f in _FORMATS]
    return F.when(text.rlike(r"^[0-9]+$"), epoch).otherwise(F.coalesce(iso, *other))


def parse_epoch(number: Column) -> Column:
    """Epoch seconds or milliseconds as a number, fractions kept to the microsecond."""
    v = number.try_cast("double")
    seconds = F.when(v > MS_FROM, v / 1000).otherwise(v)
    return F.when(F.abs(seconds) < 253402300800, F.timestamp_micros(F.rint(seconds * 1e6).cast("bigint")))


def age_days(posted: Column, as_of: Column) -> Column:
    """Whole days, rounded down, from a posting to the clock."""
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(posted.cast("timestamp"))
    return F.floor(micros / 86_400_000_000).cast("int")
