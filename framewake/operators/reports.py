"""Tables and lines that people read: in a stated order, with ties settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import merge_summary

KEY = ("run_id", "clip_id")


def placed(df: DataFrame, *order: str | Column, keys: tuple[str, ...] = KEY) -> DataFrame:
    """df with place, from 0, within its run and clip."""
    return df.withColumn("place", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def by_confidence(sightings: DataFrame) -> DataFrame:
    """Sightings as a strip shows them: by start, then confidence, then position."""
    return placed(sightings, "start_time_s", "confidence", "position")


def by_window(sightings: DataFrame) -> DataFrame:
    """Sightings as a list shows them: by start, then window, then position."""
    return placed(sightings, "start_time_s", "window_index", "position")


def label_order(translation: DataFrame) -> DataFrame:
    """Translated labels of a clip by category and by the number in the label, so that P10 follows P9."""
    return placed(translation, "category", F.regexp_extract("label", "[0-9]+$", 0).cast("long"), "label", keys=("clip_id",))


def in_call_order(malformed: DataFrame) -> DataFrame:
    """Malformed items in the order in which they came: by window, then place in its answer."""
    return placed(malformed, "window_index", "position")


def shortest_clip(clips: DataFrame) -> DataFrame:
    """(clip_id, duration_s) of the shortest clip, ties to the smaller id: the one for a first try. Clips without a duration don't count; no row without any."""
    best = clips.where("duration_s IS NOT NULL").agg(F.min(F.struct("duration_s", "clip_id")).alias("b"))
    return best.where("b IS NOT NULL").select("b.clip_id", "b.duration_s")


def batch_lines(results: DataFrame) -> DataFrame:
    """(clip_id, ok, line) of a batch: a clip's counts, or what it failed of."""
    counts = ("source_interaction_count", "merged_interaction_count", "failed_windows", "malformed_count")
    fine = merge_summary(F.col("clip_id"), *(F.coalesce(c, F.lit(0)) for c in counts))
    fault = F.coalesce("error", "run_error")
    return results.select("clip_id", fault.isNull().alias("ok"), F.when(fault.isNull(), fine).otherwise(F.concat("clip_id", F.lit(": FAILED "), fault)).alias("line"))
