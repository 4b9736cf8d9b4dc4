"""Timestamp parsing, construction with rollover, precedence and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXIF_PATTERN = "yyyy:MM:dd HH:mm:ss"
NAME_DATE = r"(\d{4})[-/]?(\d{2})[-/]?(\d{2})"

# Strftime directive to Spark datetime pattern.
STRFTIME = {
    "Y": "yyyy",
    "y": "yy",
    "m": "MM",
    "b": "MMM",
    "B": "MMMM",
    "d": "dd",
    "j": "DDD",
    "H": "HH",
    "I": "hh",
    "M": "mm",
    "S": "ss",
    "p": "a",
    "a": "EEE",
    "A": "EEEE",
}


def t_ms(ts: Column | str) -> Column:
    """Milliseconds since the epoch of a zone-less timestamp (the session runs in UTC)."""
    return F.unix_millis((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def ms_to_ts(ms: Column) -> Column:
    return F.timestamp_millis(ms).cast("timestamp_ntz")


def parse_exif(text: Column) -> Column:
    """``yyyy:MM:dd HH:mm:ss``, strictly; anything else, zeroed clocks included, is NULL."""
    return F.try_to_timestamp(text, F.lit(EXIF_PATTERN)).cast("timestamp_ntz")


def rollover_date(y: Column, m: Column, d: Column) -> Column:
    """Midnight of a date whose month and day may overflow; years 0 to 99 mean 19xx."""
    year = F.when(y < 100, y + 1900).otherwise(y)
    start = F.add_months(F.make_date(year, F.lit(1), F.lit(1)), (m - 1).cast("int"))
    return F.date_add(start, (d - 1).cast("int")).cast("timestamp_ntz")


def filename_date(name: Column) -> Column:
    """The first date-like run of eight digits in a name, or NULL."""
    part = [F.regexp_extract(name, NAME_DATE, i).try_cast("int") for i in (1, 2, 3)]
    return F.when(name.rlike(NAME_DATE), rollover_date(*part))


def resolve_timestamp(exif: Column, name: Column, mtime: Column) -> Column:
    """Embedded timestamp, else the date in the name, else the modification time."""
    return F.coalesce(parse_exif(exif), filename_date(name), mtime.cast("timestamp_ntz"))


def strftime(ts: Column, fmt: str) -> Column:
    """strftime by tokens: adjacent Spark patterns would run together (MM + MMM)."""
    parts, i, plain = [], 0, ""
    while i < len(fmt):
        if fmt[i] != "%":
            plain, i = plain + fmt[i], i + 1
            continue
        key = fmt[i + 1 : i + 2]
        i += 2
        if key == "%":
            plain += "%"
            continue
        if key not in STRFTIME:
            raise ValueError(f"unsupported date directive %{key}")
        if plain:
            parts, plain = [*parts, F.lit(plain)], ""
        parts.append(F.date_format(ts, STRFTIME[key]))
    return F.concat(*parts, F.lit(plain))
