"""Rounding, frame rates and number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest_int(x: Column) -> Column:
    """Half to even, as a whole number."""
    return F.bround(x, 0).cast("long")


def exact_round(x: Column, digits: int) -> Column:
    """To at most 7 decimals, half to even on the exact binary value. No built-in rounds that way, so x * 10**digits is taken exactly, as the sum of two doubles. From 2**52 / 10**digits on, x stays as it is."""
    m = float(10**digits)
    # The upper and lower halves of x's digits: their products with m are exact, and so is the error of their sum.
    upper = x * 134217729.0 - (x * 134217729.0 - x)
    high, low = upper * m, (x - upper) * m
    total = high + low
    error = (high - (total - (total - high))) + (low - (total - high))
    tie = F.abs(total - F.rint(total)) == 0.5
    near = F.when(tie & (error > 0), F.ceil(total)).when(tie & (error < 0), F.floor(total)).otherwise(F.rint(total))
    return F.when(F.abs(x) < 2.0**52 / m, near.cast("double") / m).otherwise(x)


def fps_value(fps: Column) -> Column:
    """A rational frame rate such as 30000/1001 as a double; null if it isn't one or is 0."""
    num = F.try_to_number(F.split_part(fps, F.lit("/"), F.lit(1)), F.lit("9999999999")).cast("double")
    den = F.when(fps.contains("/"), F.try_to_number(F.split_part(fps, F.lit("/"), F.lit(2)), F.lit("9999999999")).cast("double")).otherwise(1.0)
    return F.when((num > 0) & (den > 0), num / den)


def frame_time(frame_index: Column, fps: Column) -> Column:
    """Seconds at which a frame is shown: its own index, whatever its place in a list, over the rate."""
    return frame_index.cast("double") / fps_value(fps)


def track_buffer(seconds: Column, fps: Column, least: int = 20) -> Column:
    """Frames that a lost track survives."""
    return F.greatest(F.lit(least), F.bround(seconds * fps_value(fps), 0).cast("int"))


def detector_size(height: Column) -> Column:
    return F.when(height >= 1080, 1280).otherwise(640)


def compact_number(x: Column) -> Column:
    """A number of at most six significant digits without trailing zeros, as %g prints it between 0.0001 and a million."""
    whole = F.bround(x, 6).cast("decimal(20,6)").cast("string")
    return F.regexp_replace(F.regexp_replace(whole, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
