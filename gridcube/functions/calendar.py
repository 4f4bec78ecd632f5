"""Calendar and time-coordinate expressions (all TIMESTAMP_NTZ, no zones)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Three-letter month names, January first (month = index + 1).
MONTH_ABBREV = ("jan", "feb", "mar", "apr", "may", "jun",
                "jul", "aug", "sep", "oct", "nov", "dec")

# Fixed value: epoch of encoded time coordinates.
CF_EPOCH = "1960-01-01 00:00:00"


def month_number(s: Column) -> Column:
    """Month given as a number or a case-insensitive 3-letter name -> 1..12.

    An unknown name raises (like a failed list lookup)."""
    as_int = s.try_cast("int")
    pos = F.array_position(F.array(*[F.lit(m) for m in MONTH_ABBREV]), F.lower(s)).cast("int")
    by_name = F.when(pos > 0, pos).otherwise(
        F.raise_error(F.concat(F.lit("unknown month name: "), s)).cast("int"))
    return F.when(s.isNull(), F.lit(None).cast("int")).when(as_int.isNotNull(), as_int).otherwise(by_name)


def month_start(ts: Column) -> Column:
    """First instant of the month of ``ts`` as TIMESTAMP_NTZ (zone independent)."""
    return F.trunc(ts, "MM").cast("timestamp_ntz")


def add_months_ntz(ts_month_start: Column, n: Column) -> Column:
    """Month arithmetic on a first-of-month timestamp (no end-of-month clamping
    issue because the day is always 1)."""
    return F.add_months(ts_month_start.cast("date"), n).cast("timestamp_ntz")


def encode_time(ts: Column, unit: str = "hours") -> Column:
    """CF encode: integer ``<unit> since 1960-01-01`` as int32."""
    u = {"hours": "HOUR", "days": "DAY"}[unit]
    return F.timestamp_diff(u, F.lit(CF_EPOCH).cast("timestamp_ntz"), ts).cast("int")


def decode_time(n: Column, unit: str = "hours") -> Column:
    """CF decode of ``<unit> since 1960-01-01``."""
    u = {"hours": "HOUR", "days": "DAY"}[unit]
    return F.timestamp_add(u, n, F.lit(CF_EPOCH).cast("timestamp_ntz"))


def parse_units(units: str) -> str:
    """'hours since 1960-01-01' -> 'hours' (only the 1960 epoch is written)."""
    unit, _, since = units.partition(" since ")
    if unit not in ("hours", "days") or not since.startswith("1960-01-01"):
        raise ValueError(f"unsupported time encoding {units!r}")
    return unit


def day360_to_standard(day_number: Column, epoch_year: int = 1960) -> Column:
    """Day number in a 360-day calendar (days since ``epoch_year``-01-01) to a
    standard-calendar timestamp with the same year, month and day; NULL when
    that date does not exist (e.g. 30 February), to be dropped."""
    year = F.floor(day_number / 360).cast("int") + F.lit(epoch_year)
    month = (F.floor(day_number / 30) % 12).cast("int") + 1
    day = (day_number % 30).cast("int") + 1
    return F.try_make_timestamp_ntz(year, month, day, F.lit(0), F.lit(0), F.lit(0))


def fix_calendar_name(name: str | None) -> str | None:
    """A calendar named '360' means '360_day'."""
    return "360_day" if name == "360" else name


def convert_calendar(cube, dim: str = "S", calendar: str | None = None, unit: str = "days"):
    """A start axis stored as integer ``days since 1960-01-01`` in a 360-day
    calendar becomes standard TIMESTAMP_NTZ with the same year, month and
    day; starts whose date does not exist (e.g. 30 February) are removed."""
    cal = fix_calendar_name(calendar or cube.encodings.get(dim, {}).get("calendar"))
    if cal != "360_day":
        raise ValueError(f"only 360_day -> standard is supported, got {cal!r}")
    if unit != "days":
        raise ValueError("360-day starts must be encoded in days")
    conv = day360_to_standard(F.col(dim))
    cells = cube.cells.withColumn(dim, conv).filter(F.col(dim).isNotNull())
    enc = {k: dict(v) for k, v in cube.encodings.items()}
    enc.setdefault(dim, {})["calendar"] = "standard"
    return cube.replace(cells=cells, encodings=enc)
