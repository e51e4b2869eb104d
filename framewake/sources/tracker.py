"""Detections by an external tracker, and its settings.

A tracker keeps state from frame to frame, so a clip is one task's work; frames
pass one by one and only boxes stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

DETECTIONS = "clip_id string, frame_index long, box_position int, track_id long, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double"
_ARROW = pa.schema(
    [("clip_id", pa.string()), ("frame_index", pa.int64()), ("box_position", pa.int32()), ("track_id", pa.int64()), ("class_id", pa.int32()), ("confidence", pa.float64())]
    + [(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")]
)
TRACKERS = ("botsort", "bytetrack", "tracktrack", "ocsort", "deepocsort", "fasttrack")


def tracker_config(settings: dict, track_buffer: int, reid: str = "none") -> dict:
    """A tracker's settings with a buffer and re-identification set; raises where either would have no effect."""
    kind = settings.get("tracker_type")
    if kind not in TRACKERS:
        raise ValueError(f"unsupported tracker {kind!r}")
    if "track_buffer" not in settings:
        raise ValueError(f"{kind} has no track_buffer")
    out = {**settings, "track_buffer": track_buffer}
    if reid != "none" and "with_reid" not in settings:
        raise ValueError(f"{kind} can't re-identify")
    if "with_reid" in settings:
        out |= {"with_reid": reid != "none"} | ({"model": reid} if reid != "none" else {})
    return out


def track_clips(clips: DataFrame, frames_of: Callable[[dict], Iterable[list[tuple]]], rows_per_batch: int = 4096) -> DataFrame:
    """Raw detections of clips. frames_of(clip's row) yields, for every decoded frame, its boxes (track_id or None, class_id, confidence, x1, y1, x2, y2)."""

    def run(batches):
        for batch in batches:
            for clip in batch.to_pylist():
                rows: list[tuple] = []
                for index, boxes in enumerate(frames_of(clip)):
                    rows += [(clip["clip_id"], index, k, *box) for k, box in enumerate(boxes)]
                    if len(rows) >= rows_per_batch:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return clips.repartition("clip_id").mapInArrow(run, DETECTIONS)
