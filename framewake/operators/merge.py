"""Sightings to events: shared identities in overlapping spans, closed transitively.

Two sightings are of one event if their spans touch and they share a person and a
vehicle, that is, a (person, vehicle) pair. Within a pair, sightings in order of
start fall into islands wherever a start lies beyond every earlier end; an island
is connected. So the components are those of sightings tied to the first sighting
of each of their islands: linear in the pairs, where comparing sightings would be
quadratic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import written
from .closure import components

#: How far below a group's best confidence a sighting may lie and still supply fields; how far inside its window a contained span is.
CONFIDENCE_BAND, EPSILON = 0.3, 0.01
#: Spans below this, a power of four, count as equally long where cells are chosen for them.
SHORTEST = 4.0**-5
KEY = ("run_id", "clip_id")


def contained(start: Column, end: Column, window_start: Column, window_end: Column) -> Column:
    """Whether a span lies strictly inside its window."""
    return (start > window_start + EPSILON) & (end < window_end - EPSILON)


def evidence_margin(evidence: Column, window_start: Column, window_end: Column) -> Column:
    return F.least(evidence - window_start, window_end - evidence)


def integrity_faults(sightings: DataFrame, windows: DataFrame) -> DataFrame:
    """(run_id, clip_id, window_index, fault): window indexes that occur twice, and those that sightings name and no window has."""
    at = [*KEY, "window_index"]
    twice = windows.groupBy(*at).count().where("count > 1").select(*at, F.lit("duplicate").alias("fault"))
    orphans = sightings.select(*at).distinct().join(windows, at, "left_anti").select(*at, F.lit("missing").alias("fault"))
    return twice.unionByName(orphans)


def islands(sightings: DataFrame) -> DataFrame:
    """(run_id, clip_id, person, vehicle, position, start_time_s, end_time_s, island): sightings by shared pair; island is the position of the pair's first sighting there."""
    cols = [*KEY, "position", "start_time_s", "end_time_s"]
    pairs = sightings.select(*cols, F.explode(F.array_distinct("person_ids")).alias("person"), "vehicle_ids").select(*cols, "person", F.explode(F.array_distinct("vehicle_ids")).alias("vehicle"))
    by_start = Window.partitionBy(*KEY, "person", "vehicle").orderBy("start_time_s", "end_time_s", "position")
    latest = F.max("end_time_s").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opened = pairs.withColumn("__new", F.coalesce(F.col("start_time_s") > latest, F.lit(True)))
    named = opened.withColumn("island", F.last(F.when(F.col("__new"), F.col("position")), True).over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    return named.drop("__new")


def same_event_pairs(sightings: DataFrame) -> DataFrame:
    """(run_id, clip_id, left_position, right_position) of sightings that match directly, for reports; merging doesn't need it.

    Of two that match the later begins within the span of the earlier. Spans are sorted
    by length into powers of four, and each lies in the cells of that width that it
    touches, three at most; a beginning is looked up in its cell of each width in use.
    So what is compared is a few times what is returned, and a pair is found once: at
    the least person and vehicle that its sightings share.
    """
    c = F.col
    ids = {n: F.array_distinct(f"{n}_ids") for n in ("person", "vehicle")}
    several = F.size(ids["person"]) * F.size(ids["vehicle"]) > 1
    slim = sightings.select(*KEY, "position", "start_time_s", "end_time_s", *(v.alias(f"{n}s") for n, v in ids.items()), *(F.when(several, v).alias(f"all_{n}s") for n, v in ids.items()))
    pairs = slim.select("*", F.explode("persons").alias("person")).select("*", F.explode("vehicles").alias("vehicle")).drop("persons", "vehicles")
    length = c("end_time_s") - c("start_time_s")
    width = F.pow(F.lit(4.0), F.when(length > SHORTEST, F.ceil(F.log2(length) / 2)).otherwise(math.log(SHORTEST, 4)))
    cell = lambda at: F.floor(c(at) / c("width"))
    spans = pairs.where("start_time_s <= end_time_s").withColumn("width", width)
    spans = spans.withColumn("cell", F.explode(F.sequence(cell("start_time_s"), cell("end_time_s"))))
    widths = sightings.where("start_time_s <= end_time_s").select(width.alias("width")).distinct()
    begun = pairs.crossJoin(F.broadcast(widths)).withColumn("cell", cell("start_time_s"))
    l, r = spans.alias("l"), begun.alias("r")
    keys = [c(f"l.{k}") == c(f"r.{k}") for k in (*KEY, "person", "vehicle", "width", "cell")]
    later = (c("l.start_time_s") < c("r.start_time_s")) | ((c("l.start_time_s") == c("r.start_time_s")) & (c("l.position") < c("r.position")))
    meet = later & (c("r.start_time_s") <= c("l.end_time_s")) & (c("l.start_time_s") <= c("r.end_time_s")) & (c("l.position") != c("r.position"))
    least = lambda n: F.array_min(F.array_intersect(f"l.all_{n}s", f"r.all_{n}s")) == c(f"l.{n}")
    once = c("l.all_persons").isNull() | c("r.all_persons").isNull() | (least("person") & least("vehicle"))
    return l.join(r, [*keys, meet & once]).select("l.run_id", "l.clip_id", F.least("l.position", "r.position").alias("left_position"), F.greatest("l.position", "r.position").alias("right_position"))


def island_ties(sightings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((run_id, clip_id, position, first), ties): by the least position of one of its islands a sighting is found; ties (a, b) are of such positions, each once."""
    whole = Window.partitionBy(*KEY, "person", "vehicle", "island")
    named = islands(sightings).select(*KEY, "position", F.min("position").over(whole).alias("first"))
    # Written, as ties and members are read from it.
    told = written(named.groupBy(*KEY, "position").agg(F.array_sort(F.collect_set("first")).alias("firsts")), "islands")
    node = lambda c: F.struct(*KEY, c.alias("position"))
    several = told.where(F.size("firsts") > 1).select(*KEY, F.element_at("firsts", 1).alias("one"), F.explode(F.slice("firsts", 2, F.size("firsts"))).alias("other"))
    return told.select(*KEY, "position", F.element_at("firsts", 1).alias("first")), several.distinct().select(node(F.col("one")).alias("a"), node(F.col("other")).alias("b"))


def group_sightings(sightings: DataFrame) -> DataFrame:
    """sightings with group, the position of their event's earliest member."""
    members, ties = island_ties(sightings)
    found = components(ties).select("node.run_id", "node.clip_id", F.col("node.position").alias("first"), F.col("comp.position").alias("group"))
    grouped = members.join(found, [*KEY, "first"], "left").select(*KEY, "position", F.coalesce("group", "first").alias("group"))
    return sightings.join(grouped, [*KEY, "position"], "left").withColumn("group", F.coalesce("group", "position"))


def with_windows(sightings: DataFrame, windows: DataFrame) -> DataFrame:
    """sightings with window_start_s and window_end_s. A sighting whose window is missing or listed twice fails the job: dropping or doubling it would be silent."""
    at = [*KEY, "window_index"]
    spans = windows.groupBy(*at).agg(F.count("*").alias("__listed"), F.min("start_s").alias("__start"), F.min("end_s").alias("__end"))
    told = F.concat(F.lit("a sighting's window is missing or listed twice: "), *(F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("null")), F.lit(" ")) for k in at))
    one = lambda c: F.when(F.col("__listed") == 1, F.col(c)).otherwise(F.raise_error(told).cast("double"))
    return sightings.join(spans, at, "left").withColumns({"window_start_s": one("__start"), "window_end_s": one("__end")}).drop("__listed", "__start", "__end")


def ranked(grouped: DataFrame, confidence_band: float = CONFIDENCE_BAND) -> DataFrame:
    """Grouped sightings with contained, margin, credible and, among credible ones, rank; rank 1 supplies an event's fields."""
    if confidence_band < 0:
        raise ValueError("confidence_band must not be negative")
    group = Window.partitionBy(*KEY, "group")
    c = F.col
    out = grouped.withColumn("contained", contained(c("start_time_s"), c("end_time_s"), c("window_start_s"), c("window_end_s")))
    out = out.withColumn("margin", evidence_margin(c("evidence_time_s"), c("window_start_s"), c("window_end_s")))
    out = out.withColumn("credible", c("confidence") >= F.max("confidence").over(group) - F.lit(confidence_band))
    best = group.orderBy(c("credible").desc(), c("contained").desc(), c("margin").desc(), c("confidence").desc(), "window_index", "position")
    return out.withColumn("rank", F.when(c("credible"), F.row_number().over(best)))


def merge_events(sightings: DataFrame, windows: DataFrame, confidence_band: float = CONFIDENCE_BAND) -> DataFrame:
    """One row for each event: ids of all members, fields of the chosen one, span and account.

    Where any member, credible or not, saw the whole event, the chosen one's span and
    text stand; else spans are united and distinct texts joined in order of start.
    """
    members = ranked(with_windows(group_sightings(sightings), windows), confidence_band)
    chosen = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    in_order = lambda *cols: F.array_sort(F.collect_list(F.struct(*cols)))
    union = lambda ids: F.array_distinct(F.flatten(F.transform(in_order("position", ids), lambda x: x[ids])))
    texts = F.array_join(F.array_distinct(F.transform(in_order("start_time_s", "window_index", "position", "interaction"), lambda x: x["interaction"])), " | ")
    whole = F.bool_or("contained")
    events = members.groupBy(*KEY, "group").agg(
        union("person_ids").alias("person_ids"), union("vehicle_ids").alias("vehicle_ids"),
        chosen("person_description").alias("person_description"), chosen("vehicle_description").alias("vehicle_description"),
        F.when(whole, chosen("interaction")).otherwise(texts).alias("interaction"),
        F.when(whole, chosen("start_time_s")).otherwise(F.min("start_time_s")).alias("start_time_s"),
        chosen("evidence_time_s").alias("evidence_time_s"),
        F.when(whole, chosen("end_time_s")).otherwise(F.max("end_time_s")).alias("end_time_s"),
        chosen("confidence").alias("confidence"),
        F.array_sort(F.collect_set("window_index")).alias("window_indexes"), F.count("*").alias("sightings"),
    )
    at = Window.partitionBy(*KEY).orderBy("start_time_s", "end_time_s", "group")
    return events.withColumn("event_index", (F.row_number().over(at) - 1).cast("long"))
