"""Date expressions. "Now" is always the ``as_of`` argument."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def moment(as_of: datetime | str | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("timestamp")


def parse_date(text: Column) -> Column:
    """ISO date or date-time (``Z`` and offsets allowed, UTC if none); anything else is null."""
    iso = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    return F.when(text.rlike(iso), F.try_to_timestamp(F.regexp_replace(text, r"([T ]\d{2})(Z|[+-]|$)", "$1:00$2"))).when(
        text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd"))
    )


def from_epoch(seconds: Column) -> Column:
    """Epoch seconds; zero counts as missing."""
    return F.when(seconds != 0, F.timestamp_micros((seconds * 1_000_000).cast("long")))


def age_days(added: Column, as_of) -> Column:
    """Age in days, never negative, 0 when the date is missing."""
    micros = F.unix_micros(moment(as_of)) - F.unix_micros(added)
    return F.greatest(F.lit(0.0), F.coalesce(micros / F.lit(float(DAY_MICROS)), F.lit(0.0)))


def today_start(as_of) -> Column:
    return F.date_trunc("day", moment(as_of))


def yesterday_end(as_of) -> Column:
    return today_start(as_of) - F.expr("INTERVAL 1 SECOND")


def days_before(start: Column, days: int) -> Column:
    return start - F.make_dt_interval(days=F.lit(days))


def iso_format(ts: Column) -> Column:
    """``2024-01-15T10:30:00[.ffffff]+00:00``."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return F.concat(whole, F.when(micros == 0, "").otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))), F.lit("+00:00"))


def store_format(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def rfc822(ts: Column) -> Column:
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss Z")


def in_zone(ts: Column, zone: str) -> Column:
    """Wall-clock time of a display zone."""
    return F.from_utc_timestamp(ts, zone)


def year_of(date_text: Column) -> Column:
    """First all-digit piece between dashes."""
    return F.get(F.filter(F.split(date_text, "-"), lambda p: p.rlike(r"^\d+$")), F.lit(0)).try_cast("int")


def quarter_key(year: Column, date_text: Column) -> Column:
    """``2024-Q1``; the second dash piece is the month, January when it is missing or no number."""
    month = F.coalesce(F.get(F.split(date_text, "-"), F.lit(1)).try_cast("int"), F.lit(1))
    return F.concat(year.cast("string"), F.lit("-Q"), (F.floor((month - 1) / 3) + 1).cast("string"))
