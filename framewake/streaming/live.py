"""Streams of detections and sightings. Both need an event-time column seen_at (timestamp)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tracks import detections


def label_activity(raw: DataFrame, every: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """(clip_id, category, window, boxes, identities): what tracked boxes of a stream show in each interval; late rows count until the watermark."""
    boxes = detections(raw).withWatermark("seen_at", late)
    return boxes.groupBy("clip_id", "category", F.window("seen_at", every)).agg(F.count("*").alias("boxes"), F.approx_count_distinct("track_id").alias("identities"))


def event_sessions(sightings: DataFrame, gap: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """(clip_id, person, vehicle, session, sightings, confidence): runs of sightings of a pair without a longer gap."""
    pairs = sightings.withWatermark("seen_at", late).select("clip_id", "seen_at", "confidence", F.explode("person_ids").alias("person"), "vehicle_ids").withColumn("vehicle", F.explode("vehicle_ids"))
    return pairs.groupBy("clip_id", "person", "vehicle", F.session_window("seen_at", gap).alias("session")).agg(F.count("*").alias("sightings"), F.max("confidence").alias("confidence"))
