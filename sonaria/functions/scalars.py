"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_even(c: str | Column, places: int = 0) -> Column:
    """Rounding half to even, on the decimal digits."""
    return F.bround(_col(c), places)


def decibels(mag: str | Column, floor: float = 1e-5, bottom: float = -80.0) -> Column:
    """A magnitude as 0 to 1: decibels cut to [bottom, 0], then scaled."""
    d = F.greatest(F.least(20 * F.log10(F.greatest(_col(mag), F.lit(floor))), F.lit(0.0)), F.lit(bottom))
    return (d - bottom) / -bottom


def sigmoid(c: str | Column) -> Column:
    return 1 / (1 + F.exp(-_col(c)))


def one_decimal(c: str | Column) -> Column:
    """A double as text with one decimal, rounded by its binary value, half to even, as other languages' %.1f.

    format_string rounds the shortest decimal that stands for a value, half up; it writes what has no fraction (from
    2**52 on) or is no number."""
    x = _col(c).cast("double")
    whole = F.floor(F.abs(x))
    part = F.abs(x) - whole
    # Ten times the fraction in two parts, both of them exact: its first 20 bits, and the rest.
    head = F.floor(part * (1 << 20)) / (1 << 20)
    rest, tenths = (part - head) * 10, F.floor(head * 10)
    short = F.lit(0.5) - (head * 10 - tenths)
    up = (rest > short) | ((rest == short) & (tenths % 2 == 1))
    digit = tenths + up.cast("long")
    sign = F.when(x.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    text = F.concat(sign, (whole + (digit == 10).cast("long")).cast("string"), F.lit("."), (digit % 10).cast("string"))
    return F.when(F.abs(x) < float(1 << 52), text).otherwise(F.format_string("%.1f", x))


def basename(c: str | Column) -> Column:
    return F.substring_index(F.trim(_col(c)), "/", -1)


def to_frame(seconds: str | Column, sr: float, hop: int) -> Column:
    return F.rint(_col(seconds) * sr / hop).cast("long")


def to_bin(hz: str | Column, sr: float, n_fft: int) -> Column:
    """The first bin whose frequency is at or above hz."""
    return F.greatest(F.ceil(_col(hz) / (sr / n_fft)), F.lit(0)).cast("long")


def frame_time(frame: str | Column, sr: float, hop: int, last: Column | None = None) -> Column:
    f = _col(frame)
    return (F.least(f, last) if last is not None else f) * hop / sr


def minutes(seconds: str | Column) -> Column:
    """m:ss; 0:00 for null and not a number."""
    s = F.coalesce(F.nanvl(_col(seconds).cast("double"), F.lit(0.0)), F.lit(0.0))
    whole = F.floor(s)
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad(F.pmod(whole, F.lit(60)).cast("string"), 2, "0"))


def left_percent(start: str, total: str) -> Column:
    return F.col(start) / F.col(total) * 100


def width_percent(start: str, end: str, total: str, least: float = 0.5) -> Column:
    return F.greatest(F.lit(least), (F.col(end) - F.col(start)) / F.col(total) * 100)


def hashed_unit(*cols: str | Column) -> Column:
    """A number in [0, 1) that depends on the columns only: the first 13 hex digits of an md5."""
    text = F.concat_ws("|", *(_col(c).cast("string") for c in cols))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


#: SQL functions that register() defines.
SQL_FUNCTIONS = {
    "temporal_iou": ("a0 DOUBLE, a1 DOUBLE, b0 DOUBLE, b1 DOUBLE", "CASE WHEN greatest(a1, b1) - least(a0, b0) > 0 AND (a1 - a0) + (b1 - b0) - greatest(least(a1, b1) - greatest(a0, b0), 0) > 0 THEN greatest(least(a1, b1) - greatest(a0, b0), 0) / ((a1 - a0) + (b1 - b0) - greatest(least(a1, b1) - greatest(a0, b0), 0)) ELSE 0 END"),
    "normal_db": ("mag DOUBLE", "(greatest(least(20 * log10(greatest(mag, 1e-5)), 0), -80) + 80) / 80"),
    "logistic": ("z DOUBLE", "1 / (1 + exp(-z))"),
}


def register(spark: SparkSession) -> None:
    """Define the scalar functions for SQL."""
    for name, (args, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS DOUBLE RETURN {body}")
