"""Detections to identities: class lookup, dense renumbering, label times.

Everything is keyed by clip_id, so a batch of clips is one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.labels import CLASSES, label_text
from ..functions.numbers import frame_time


def class_table(spark) -> DataFrame:
    """(class_id, class_name, category) of the classes that count: five rows."""
    return spark.createDataFrame(list(CLASSES), "class_id int, class_name string, category string")


def check_classes(names: DataFrame) -> DataFrame:
    """The classes of ours that a model's own (class_id, class_name) doesn't have under that name; empty if it fits."""
    return class_table(names.sparkSession).join(names, ["class_id", "class_name"], "left_anti")


def detections(raw: DataFrame) -> DataFrame:
    """Tracked boxes of classes that count, with name and category. raw: (clip_id, frame_index, box_position, track_id, class_id, confidence, x1, y1, x2, y2)."""
    ids = [c for c, _, _ in CLASSES]
    kept = raw.where(F.col("track_id").isNotNull() & F.col("class_id").isin(ids))
    return kept.join(F.broadcast(class_table(raw.sparkSession)), "class_id")


def translation(boxes: DataFrame) -> DataFrame:
    """(clip_id, category, track_id, first_frame, number, label): identities numbered from 1 per clip and category, as they appear."""
    first = boxes.groupBy("clip_id", "category", "track_id").agg(F.min("frame_index").alias("first_frame"))
    seen = Window.partitionBy("clip_id", "category").orderBy("first_frame", "track_id")
    numbered = first.withColumn("number", F.row_number().over(seen))
    return numbered.withColumn("label", label_text(F.col("category"), F.col("number")))


def relabel(boxes: DataFrame) -> DataFrame:
    """boxes with each track_id replaced by its number, and label."""
    new = translation(boxes).select("clip_id", "category", "track_id", "number", "label")
    return boxes.join(new, ["clip_id", "category", "track_id"]).drop("track_id").withColumnRenamed("number", "track_id")


def label_times(relabelled: DataFrame, clips: DataFrame) -> DataFrame:
    """(clip_id, label, t_s): a row for each time a label is drawn, repeats kept. clips: (clip_id, fps)."""
    return relabelled.join(clips.select("clip_id", "fps"), "clip_id").select("clip_id", "label", frame_time(F.col("frame_index"), F.col("fps")).alias("t_s"))


def times_by_label(times: DataFrame) -> DataFrame:
    """(clip_id, label, times): each label's times in order."""
    return times.groupBy("clip_id", "label").agg(F.array_sort(F.collect_list("t_s")).alias("times"))


def identity_counts(boxes: DataFrame) -> DataFrame:
    """(clip_id, people, vehicles): distinct identities."""
    own = boxes.select("clip_id", "category", "track_id").distinct()
    people = F.count_if(F.col("category") == "person")
    return own.groupBy("clip_id").agg(people.alias("people"), (F.count("*") - people).alias("vehicles"))


def frame_order_faults(frames: DataFrame) -> DataFrame:
    """Entries whose frame_index isn't their place. frames: (clip_id, entry, frame_index)."""
    at = Window.partitionBy("clip_id").orderBy("entry")
    return frames.withColumn("expected", F.row_number().over(at) - 1).where("frame_index <> expected")
