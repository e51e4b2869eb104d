"""Annotated copies of clips: one task per clip hands frames and label places to a caller's encoder."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame

RENDERED = "clip_id string, output string, frames int, error string"


def render_clips(clips: DataFrame, layouts: DataFrame, encode: Callable[[dict, Iterator[tuple[int, list[dict]]], str], int]) -> DataFrame:
    """(clip_id, output, frames, error). clips: (clip_id, path, output, width, height); layouts: of layout().

    encode(clip, frames, file) writes a clip's frames, each with its labels, and tells how
    many. It writes to a name of its own; only a finished file takes the output's name, and
    a failed one is removed. Odd sizes and outputs that are their source are refused.
    """
    shape = pa.schema([("clip_id", pa.string()), ("output", pa.string()), ("frames", pa.int32()), ("error", pa.string())])
    places = ("track_id", "category", "label", "rect_left", "rect_top", "rect_right", "rect_bottom")
    # A clip's rows stream through one task in order of frame; never more than a frame's labels are held.
    rows = clips.select("clip_id", "path", "output", "width", "height").join(layouts.select("clip_id", "frame_index", *places), "clip_id", "left")
    dealt = rows.repartition("clip_id").sortWithinPartitions("clip_id", "frame_index", "track_id", "category")

    def frames_of(rows: Iterator[dict]) -> Iterator[tuple[int, list[dict]]]:
        for frame, own in groupby(rows, lambda r: r["frame_index"]):
            if frame is not None:
                yield frame, [{k: r[k] for k in places} for r in own]

    def rendered(clip: dict, rows: Iterator[dict]) -> dict:
        partial, count, error = f"{clip['output']}.partial", None, None
        try:
            if clip["width"] % 2 or clip["height"] % 2:
                raise ValueError("width and height must be even")
            if os.path.abspath(clip["output"]) == os.path.abspath(clip["path"]):
                raise ValueError("the output is the source")
            count = encode(clip, frames_of(rows), partial)
            os.replace(partial, clip["output"])
        except Exception as e:  # a clip's failure is data
            error = f"{type(e).__name__}: {e}"
            if os.path.exists(partial):
                os.remove(partial)
        return {"clip_id": clip["clip_id"], "output": clip["output"], "frames": count, "error": error}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for piece in range(0, batch.num_rows, 1024) for row in batch.slice(piece, 1024).to_pylist())
        for _, own in groupby(stream, lambda r: r["clip_id"]):
            first = next(own)
            yield pa.RecordBatch.from_pylist([rendered(first, chain([first], own))], schema=shape)

    return dealt.mapInArrow(run, RENDERED)
