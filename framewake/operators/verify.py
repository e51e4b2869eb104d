"""Labels that a sighting claims, held against when they were on screen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import unverified_summary


def verify_labels(sightings: DataFrame, times: DataFrame, tolerance_s: float, keys: tuple[str, ...] = ("run_id", "clip_id", "position")) -> DataFrame:
    """sightings with each label that was never drawn within the span, give or take, moved to the unverified lists.

    An interval semi-join without pairs: claims and times of a clip and label stand in
    one order, a claim where its span begins, and it holds if the next time from there
    on is within the span. What goes back to a sighting is the set of labels it may
    keep. Order and repeats stay, and earlier unverified labels stay in front.
    """
    claims = sightings.select(*keys, "start_time_s", "end_time_s", F.explode(F.array_distinct(F.concat("person_ids", "vehicle_ids"))).alias("label"))
    claimed = claims.select("clip_id", "label", (F.col("start_time_s") - tolerance_s).alias("__t"), F.lit(None).cast("double").alias("__drawn"), (F.col("end_time_s") + tolerance_s).alias("__until"), F.struct(*keys).alias("__keys"))
    drawn = times.select("clip_id", "label", F.col("t_s").cast("double").alias("__t")).distinct()
    drawn = drawn.select("clip_id", "label", "__t", F.col("__t").alias("__drawn"), F.lit(None).cast("double").alias("__until"), F.lit(None).cast(claimed.schema["__keys"].dataType).alias("__keys"))
    # Backwards in time: what was drawn at the very beginning of a claim comes before it.
    later = Window.partitionBy("clip_id", "label").orderBy(F.col("__t").desc(), F.col("__drawn").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = claimed.unionByName(drawn).withColumn("__next", F.last("__drawn", ignorenulls=True).over(later)).where("__keys IS NOT NULL AND __next <= __until")
    seen = held.select("__keys.*", "label").groupBy(*keys).agg(F.collect_set("label").alias("__seen"))
    out = sightings.join(seen, list(keys), "left").withColumn("__seen", F.coalesce("__seen", F.array().cast("array<string>")))
    for ids in ("person_ids", "vehicle_ids"):
        unsupported = F.filter(ids, lambda x: ~F.array_contains(F.col("__seen"), x))
        out = out.withColumn(f"unverified_{ids}", F.concat(f"unverified_{ids}", unsupported)).withColumn(ids, F.filter(ids, lambda x: F.array_contains(F.col("__seen"), x)))
    return out.drop("__seen")


def unverified_counts(sightings: DataFrame) -> DataFrame:
    """(run_id, label, times): how often each label went unsupported."""
    labels = sightings.select("run_id", F.explode(F.concat("unverified_person_ids", "unverified_vehicle_ids")).alias("label"))
    return labels.groupBy("run_id", "label").agg(F.count("*").alias("times"))


def unverified_lines(sightings: DataFrame) -> DataFrame:
    """(run_id, line) of runs with unsupported labels."""
    touched = (F.size("unverified_person_ids") > 0) | (F.size("unverified_vehicle_ids") > 0)
    records = sightings.groupBy("run_id").agg(F.count_if(touched).alias("records"))
    labels = unverified_counts(sightings).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("label", "times"))).alias("labels"))
    return labels.join(records, "run_id").select("run_id", unverified_summary(F.col("labels"), F.col("records")).alias("line"))
