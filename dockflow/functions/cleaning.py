"""Column functions that clean trips and stations, and the filters built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def to_ts(col: Column | str) -> Column:
    """Parse text (or pass a timestamp through) to a timestamp without a zone; unreadable text gives null."""
    return F.col(col).try_cast("timestamp_ntz") if isinstance(col, str) else col.try_cast("timestamp_ntz")


def to_naive_utc(col: Column) -> Column:
    """Drop the zone of an instant, read in UTC (the session zone)."""
    return F.convert_timezone(F.lit("UTC"), F.lit("UTC"), col.cast("timestamp_ntz"))


def hour_bin(col: Column) -> Column:
    return F.date_trunc("hour", col).cast("timestamp_ntz")


def valid_station(col: Column) -> Column:
    return col.isNotNull() & (col != "")


def valid_duration(start: Column, end: Column, low_minutes: float = 1, high_minutes: float = 24 * 60) -> Column:
    """Keep trips of at least one minute and at most one day."""
    minutes = F.timestamp_diff("MICROSECOND", start, end) / F.lit(60_000_000.0)
    return (minutes >= low_minutes) & (minutes <= high_minutes)


def clean_name(col: Column) -> Column:
    """Trim a name and join its inner white space to single blanks."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def valid_name(col: Column) -> Column:
    """Names with angle brackets, braces, semicolons or a double dash are refused."""
    return ~(col.rlike(r"[<>{};]") | col.contains("--"))


def between_dates(ts: Column, start: str | None = None, end: str | None = None) -> Column:
    """Closed range; an end without a time of day means midnight of that day."""
    keep = F.lit(True)
    if start:
        keep = keep & (ts >= F.lit(start).cast("timestamp_ntz"))
    if end:
        keep = keep & (ts <= F.lit(end).cast("timestamp_ntz"))
    return keep


def on_days(ts: Column, days: str | None) -> Column:
    """Keep weekdays named in a comma list; no list keeps all."""
    return F.date_format(ts, "EEEE").isin(days.split(",")) if days else F.lit(True)


def for_station(col: Column, name: str) -> Column:
    return col == F.lit(name)


def keep_stations(df: DataFrame, stations: DataFrame, key: str = "station_name") -> DataFrame:
    """Rows whose station is in the list."""
    return df.join(stations.select(key), key, "left_semi")


def exclude(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not in the list."""
    return df.join(keys.select(*on), on, "left_anti")


def min_volume(col: Column, least: float) -> Column:
    return col >= F.lit(least)


def volume_step(col: Column) -> Column:
    """Step of a volume slider: the maximum in hundredths, rounded up (aggregate)."""
    return F.ceil(F.max(col) / F.lit(100.0))


def search(col: Column, text: str) -> Column:
    return F.lower(col).contains(text.lower())


def fill_const(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.fillna(values)


def clip(col: Column, low: float | None = None, high: float | None = None) -> Column:
    """Limit a value; null stays null."""
    out = col
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return out


def to_number0(col: Column) -> Column:
    """Any value as a number, 0 where it is none."""
    return F.coalesce(col.try_cast("double"), F.lit(0.0))


def drop_nulls(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=subset)


def align_features(df: DataFrame, names: list[str]) -> DataFrame:
    """Exactly the named columns in their order as doubles, 0 where the frame has none."""
    have = set(df.columns)
    return df.select(*[(F.col(n).cast("double") if n in have else F.lit(0.0)).alias(n) for n in names])


def missing_features(df: DataFrame, names: list[str]) -> list[str]:
    """Names that the frame lacks, in list order."""
    have = set(df.columns)
    return [n for n in names if n not in have]


def falsy_to_null(col: Column) -> Column:
    """A zero score counts as missing."""
    return F.nullif(col, F.lit(0.0))


def first_present(*cols: Column) -> Column:
    """First value that is neither null, zero nor empty; the last one is taken as it is."""
    head = [F.when((c.cast("string") != "") & (F.coalesce(c.try_cast("double"), F.lit(1.0)) != 0), c) for c in cols[:-1]]
    return F.coalesce(*head, cols[-1])


def traffic_mode(weekend_share: Column) -> Column:
    return F.when(weekend_share > 30, "Leisure").otherwise("Commute")


def round_half_even(col: Column, digits: int = 0) -> Column:
    return F.bround(col, digits)


def round_half_up(col: Column) -> Column:
    """Nearest integer with halves going up, also below zero."""
    return F.floor(col + F.lit(0.5))


def truncate(col: Column) -> Column:
    """Drop the fraction, towards zero."""
    return F.when(col < 0, F.ceil(col)).otherwise(F.floor(col))
