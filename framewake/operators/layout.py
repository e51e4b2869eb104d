"""Greedy label placement: an ordered fold over the boxes of one frame.

Each label takes the first of its places that no label before it occupies, so
the result of a box depends on those of lesser identity: within a frame there is
nothing to distribute, between frames everything. A frame's boxes are what one
image can show, so a group is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box_rect, candidate_rects, draw_sizes
from ..functions.labels import label_text

SCHEMA = "clip_id string, frame_index long, category string, track_id long, label string, rect_left long, rect_top long, rect_right long, rect_bottom long, fallback boolean"


def layout(boxes: DataFrame, clips: DataFrame, char_w: int = 20, char_h: int = 22) -> DataFrame:
    """A label's place for each box. boxes: (clip_id, frame_index, category, track_id, x1, y1, x2, y2); clips: (clip_id, width, height).

    A label's size is char_w for each character and char_h, times the frame's font
    scale, rounded, with the halo around it. Order: track_id, then category.
    """
    c = F.col
    sized = boxes.join(clips.select("clip_id", "width", "height"), "clip_id").withColumn("m", draw_sizes(c("width"), c("height")))
    sized = sized.withColumn("label", label_text(c("category"), c("track_id"))).withColumn("box", box_rect(c("x1"), c("y1"), c("x2"), c("y2"), c("width"), c("height")))
    whole = lambda x: F.bround(x, 0).cast("long") + 2 * c("m.halo")
    sized = sized.withColumn("w", whole(F.length("label") * char_w * c("m.font_scale"))).withColumn("h", whole(char_h * c("m.font_scale")))
    places = candidate_rects(c("box"), c("w"), c("h"), c("m.clearance"), c("width"), c("height"))
    left = F.greatest(F.lit(0).cast("long"), F.least(c("box.left"), c("width") - c("w")))
    top = F.greatest(F.lit(0).cast("long"), F.least(c("box.top") - c("m.clearance") - c("h"), c("height") - c("h")))
    last = F.array(F.struct(left.alias("left"), top.alias("top"), (left + c("w")).alias("right"), (top + c("h")).alias("bottom")))
    ready = sized.withColumn("places", places).withColumn("fallback", F.size("places") == 0).withColumn("places", F.when(c("fallback"), last).otherwise(c("places")))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by frame and, in it, identity; a frame may go on in the next batch.
        frame, taken = None, []
        for batch in batches:
            rects = []
            for key, options in zip(zip(batch["clip_id"], batch["frame_index"], strict=True), batch["places"], strict=True):
                if key != frame:
                    frame, taken = key, []
                places = [(p["left"], p["top"], p["right"], p["bottom"]) for p in options]
                free = (p for p in places if not any(p[0] < o[2] and o[0] < p[2] and p[1] < o[3] and o[1] < p[3] for o in taken))
                taken.append(next(free, places[0]))
                rects.append(taken[-1])
            out = batch[["clip_id", "frame_index", "category", "track_id", "label"]].copy()
            for k, name in enumerate(("rect_left", "rect_top", "rect_right", "rect_bottom")):
                out[name] = [r[k] for r in rects]
            out["fallback"] = batch["fallback"]
            yield out

    cols = ["clip_id", c("frame_index").cast("long").alias("frame_index"), "category", c("track_id").cast("long").alias("track_id"), "label", "places", "fallback"]
    dealt = ready.select(*cols).repartition("clip_id", "frame_index").sortWithinPartitions("clip_id", "frame_index", "track_id", "category")
    return dealt.mapInPandas(place, SCHEMA)
