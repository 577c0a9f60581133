"""Texts of read models in German notation, the tracking capability, and the codec of coverage paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = "—"
PATH = "array<array<array<double>>>"


def one_decimal(value: Column) -> Column:
    """With one decimal and a comma; a tie of the decimal digits goes up."""
    return F.replace(F.format_string("%.1f", value), F.lit("."), F.lit(","))


def coverage_percent(driven: Column, total: Column) -> Column:
    """From 0 to 100; 0 without a total."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.try_divide(driven, total) * 100))
    return F.when(total > 0, share).otherwise(F.lit(0.0))


def percent(value: Column) -> Column:
    return F.concat(one_decimal(value), F.lit(" %"))


def km(value: Column) -> Column:
    """Below 1000 with one decimal, from there on whole with dots between thousands."""
    whole = F.replace(F.format_number(F.round(value), 0), F.lit(","), F.lit("."))
    return F.when(value < 1000, one_decimal(value)).otherwise(whole)


def km_stats(driven_km: Column, total_km: Column) -> Column:
    return F.concat(km(driven_km), F.lit(" / "), km(total_km), F.lit(" km"))


def date_time(ts: Column) -> Column:
    return F.date_format(ts, "dd.MM.yyyy, HH:mm")


def duration(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60)
    long = F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h "), (minutes % 60).cast("string"), F.lit(" min"))
    return F.when(seconds.isNull(), NONE).when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(long)


def distance(metres: Column) -> Column:
    near = F.concat(F.round(metres).cast("long").cast("string"), F.lit(" m"))
    return F.when(metres.isNull(), NONE).when(metres < 1000, near).otherwise(F.concat(km(metres / 1000), F.lit(" km")))


def speed(metres: Column, seconds: Column) -> Column:
    value = F.round(F.try_divide(metres, seconds) * 3.6).cast("long").cast("string")
    return F.when(metres.isNull() | seconds.isNull() | (seconds <= 0), NONE).otherwise(F.concat(value, F.lit(" km/h")))


def places(start: Column, end: Column) -> Column:
    """start → end; one name where both are it, and a general word for an unknown one."""
    word = F.lit("Standort")
    return F.when(start == end, start).otherwise(F.concat(F.coalesce(start, word), F.lit(" → "), F.coalesce(end, word)))


def clock(seconds: Column) -> Column:
    """H:MM:SS, or MM:SS below an hour."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.floor(seconds / 3600)
    rest = F.concat(two(F.floor(seconds / 60) % 60), F.lit(":"), two(seconds % 60))
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit(":"), rest)).otherwise(rest)


def capability(always: Column, notification: Column, battery: Column, android: Column) -> Column:
    """fullAuto where the location is always allowed and, on Android, notifications and the battery exemption are; else manualOnly."""
    return F.when(always & (~android | (notification & battery)), "fullAuto").otherwise("manualOnly")


def encode_path(lines: Column) -> Column:
    """[line][point][lat, lon] -> JSON, without lines of fewer than two points."""
    return F.to_json(F.filter(lines, lambda line: F.size(line) >= 2))


def decode_path(text: Column) -> Column:
    """JSON -> [line][point][lat, lon]; empty where it is null or malformed, without lines of fewer than two points."""
    return F.filter(F.coalesce(F.from_json(text, PATH), F.array().cast(PATH)), lambda line: F.size(line) >= 2)
