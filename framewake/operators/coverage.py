"""Which frames of a clip sightings cover, miss, or had no chance to see.

frames: (clip_id, frame, t_s) of a regular timeline, frame k at k / per_second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ("run_id", "clip_id")


def nearest_index(t: Column, per_second: int, n_frames: Column) -> Column:
    """The frame nearest to a time on a regular timeline, the lower of two; arithmetic instead of a join."""
    up = F.ceil(t * per_second - 0.5).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(up, n_frames - 1))


def nearest_frame(moments: DataFrame, frames: DataFrame) -> DataFrame:
    """moments (clip_id, t_s, ...) with nearest_frame among frames at any times, ties to the lower; null where the clip has no frame.

    Moments and frames of a clip stand in one order of time, and a moment's frame is
    the last before or the first after it: linear, however far that is.
    """
    shown = frames.groupBy("clip_id", F.col("t_s").alias("__t")).agg(F.min("frame").alias("frame"))
    marks = shown.select("clip_id", "__t", F.struct("__t", "frame").alias("__f"), F.lit(None).cast(moments.schema).alias("__m"))
    asked = moments.select("clip_id", F.col("t_s").alias("__t"), F.lit(None).cast(marks.schema["__f"].dataType).alias("__f"), F.struct(*moments.columns).alias("__m"))
    per = Window.partitionBy("clip_id")
    # Nulls of __f last, so that a frame at the very moment comes before it in either direction.
    at = lambda t: F.last("__f", ignorenulls=True).over(per.orderBy(t, F.col("__f").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = marks.unionByName(asked).withColumn("__before", at(F.col("__t").asc())).withColumn("__after", at(F.col("__t").desc())).where("__m IS NOT NULL")
    off = lambda c: F.abs(F.col(f"{c}.__t") - F.col("__t"))
    closer = F.when(off("__before") < off("__after"), F.col("__before.frame")).when(off("__before") > off("__after"), F.col("__after.frame"))
    nearest = F.coalesce(closer, F.least("__before.frame", "__after.frame"))
    return near.select("__m.*", nearest.alias("nearest_frame"))


def window_frames(windows: DataFrame, frames: DataFrame, per_second: int) -> DataFrame:
    """(run_id, clip_id, window_index, failed, frame): frames in each window, ends included."""
    lo, hi = F.greatest(F.lit(0).cast("long"), F.ceil(F.col("start_s") * per_second).cast("long")), F.floor(F.col("end_s") * per_second).cast("long")
    sizes = frames.groupBy("clip_id").agg(F.count("*").alias("n"))
    spans = windows.join(sizes, "clip_id").withColumn("lo", lo).withColumn("hi", F.least(hi, F.col("n") - 1)).where("hi >= lo")
    return spans.select(*KEY, "window_index", F.col("error").isNotNull().alias("failed"), F.explode(F.sequence("lo", "hi")).alias("frame"))


def covered_frames(sightings: DataFrame, windows: DataFrame, frames: DataFrame, per_second: int, min_confidence: float = 0.0) -> DataFrame:
    """(run_id, clip_id, frame), distinct: frames that sightings claim, each only within the window that reported it."""
    sizes = frames.groupBy("clip_id").agg(F.count("*").alias("n"))
    spans = windows.select(*KEY, "window_index", "start_s", "end_s")
    own = sightings.where(F.col("confidence") >= min_confidence).join(sizes, "clip_id").join(spans, [*KEY, "window_index"], "left")
    lo = F.greatest(nearest_index(F.col("start_time_s"), per_second, F.col("n")), F.coalesce(F.ceil(F.col("start_s") * per_second).cast("long"), F.lit(0)))
    hi = F.least(nearest_index(F.col("end_time_s"), per_second, F.col("n")), F.coalesce(F.floor(F.col("end_s") * per_second).cast("long"), F.col("n") - 1))
    ranges = own.withColumn("lo", lo).withColumn("hi", hi).where("hi >= lo").groupBy(*KEY, "lo").agg(F.max("hi").alias("hi"))
    # Only what lies beyond every earlier range of its run is spread, so no frame comes twice.
    reached = F.max("hi").over(Window.partitionBy(*KEY).orderBy("lo").rowsBetween(Window.unboundedPreceding, -1))
    fresh = ranges.withColumn("lo", F.greatest(F.col("lo"), F.coalesce(reached + 1, F.col("lo")))).where("hi >= lo")
    return fresh.select(*KEY, F.explode(F.sequence("lo", "hi")).alias("frame"))


def unexamined_frames(windows: DataFrame, frames: DataFrame, per_second: int) -> DataFrame:
    """(run_id, clip_id, frame): frames in a failed call's window and in no other."""
    at = window_frames(windows, frames, per_second)
    return at.groupBy(*KEY, "frame").agg(F.bool_and("failed").alias("f")).where("f").drop("f")


def coverage(sightings: DataFrame, windows: DataFrame, frames: DataFrame, per_second: int, min_confidence: float = 0.0) -> DataFrame:
    """(run_id, clip_id, frames, covered, missing, never_examined, missed): missed leaves out frames no call examined."""
    runs = windows.select(*KEY).distinct().join(frames.groupBy("clip_id").agg(F.count("*").alias("frames")), "clip_id")
    hit = covered_frames(sightings, windows, frames, per_second, min_confidence)
    never = unexamined_frames(windows, frames, per_second).join(hit, [*KEY, "frame"], "left_anti")
    n = lambda df, name: df.groupBy(*KEY).agg(F.count("*").alias(name))
    out = runs.join(n(hit, "covered"), list(KEY), "left").join(n(never, "never_examined"), list(KEY), "left").fillna(0, ["covered", "never_examined"])
    return out.withColumn("missing", F.col("frames") - F.col("covered")).withColumn("missed", F.col("missing") - F.col("never_examined"))


def strip_frames(covered: DataFrame, most: int = 6, evidence: DataFrame | None = None) -> DataFrame:
    """At most `most` frames of each run's covered ones, evenly spread, ends included.

    evidence: (run_id, clip_id, frame), a frame that the strip must show: where it isn't
    chosen, it takes the place of the chosen frame nearest to it, the lower of two.
    """
    own = Window.partitionBy(*KEY)
    at = covered.withColumn("i", F.row_number().over(own.orderBy("frame")) - 1).withColumn("n", F.count("*").over(own))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.bround(k * ((F.col("n") - 1) / F.lit(max(1, most - 1))), 0).cast("int"))
    chosen = at.where((F.col("n") <= most) | F.array_contains(wanted, F.col("i")))
    if evidence is None:
        return chosen.select(*KEY, "frame")
    shown = chosen.join(evidence.select(*KEY, F.col("frame").alias("must")), list(KEY), "left")
    nearest = F.min(F.struct(F.abs(F.col("frame") - F.col("must")), "frame")).over(own)
    in_strip = F.max(F.coalesce(F.col("frame") == F.col("must"), F.lit(False))).over(own)
    gives_way = F.col("must").isNotNull() & ~in_strip & (F.col("frame") == nearest["frame"])
    return shown.select(*KEY, F.when(gives_way, F.col("must")).otherwise(F.col("frame")).alias("frame"))
