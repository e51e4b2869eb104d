"""A query for each operator, over the driver's tables by way of the bridge. Lists are given as text, so any engine compares them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry, labels, numbers, text
from ..operators import accounting, coverage, layout, merge, reports, responses, tracks, verify, windows
from .bridge import TICK_US, Bridge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
PER_SECOND = 2


def query(f: Callable[[Bridge], DataFrame]) -> Callable[[Bridge], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir, tick_us=TICK_US: f(Bridge(spark, sf_dir, tick_us))
    return f


def joined(c: str) -> F.Column:
    return F.array_join(c, ",").alias(c)


def _boxes(b: Bridge) -> DataFrame:
    return tracks.detections(b.table("raw_detections"))


def _times(b: Bridge) -> DataFrame:
    return tracks.label_times(tracks.relabel(_boxes(b)), b.table("clips"))


def _verified(b: Bridge) -> DataFrame:
    return verify.verify_labels(b.table("sightings"), _times(b), 0.5)


def _grouped(b: Bridge) -> DataFrame:
    return merge.group_sightings(b.table("sightings"))


def _items(b: Bridge) -> DataFrame:
    return responses.items(responses.parse(b.table("responses")))


def _checked(b: Bridge) -> DataFrame:
    return responses.validated(_items(b), True, 0.5)


def _frames(b: Bridge) -> DataFrame:
    return windows.timeline(b.table("clips"), PER_SECOND)


@query
def q_merge_events(b: Bridge) -> DataFrame:
    events = merge.merge_events(b.table("sightings"), b.windows())
    cols = ("clip_id", "event_index", joined("person_ids"), joined("vehicle_ids"), "person_description", "vehicle_description", "interaction", "start_time_s", "evidence_time_s", "end_time_s", "confidence", "sightings")
    return events.select(*cols, joined("window_indexes"))


@query
def q_merge_groups(b: Bridge) -> DataFrame:
    return _grouped(b).select("clip_id", "position", F.col("group").alias("group_position"))


@query
def q_same_event_pairs(b: Bridge) -> DataFrame:
    return merge.same_event_pairs(b.table("sightings")).select("clip_id", "left_position", "right_position")


@query
def q_representative(b: Bridge) -> DataFrame:
    ranked = merge.ranked(merge.with_windows(_grouped(b), b.windows()))
    return ranked.where("rank = 1").select("clip_id", F.col("group").alias("group_position"), "position", "contained", "margin", "confidence")


@query
def q_containment(b: Bridge) -> DataFrame:
    own = merge.with_windows(b.table("sightings"), b.windows())
    inside = merge.contained(*(F.col(c) for c in ("start_time_s", "end_time_s", "window_start_s", "window_end_s")))
    margin = merge.evidence_margin(*(F.col(c) for c in ("evidence_time_s", "window_start_s", "window_end_s")))
    return own.select("clip_id", "position", inside.alias("contained"), margin.alias("margin"))


@query
def q_integrity(b: Bridge) -> DataFrame:
    all_windows = b.windows()
    some = all_windows.where("window_index % 50 <> 49").unionByName(all_windows.where("window_index % 60 = 7"))
    return merge.integrity_faults(b.table("sightings"), some).select("clip_id", "window_index", "fault")


@query
def q_verified_events(b: Bridge) -> DataFrame:
    events = merge.merge_events(_verified(b), b.windows())
    return events.groupBy("clip_id").agg(F.count("*").alias("events"), F.sum("sightings").alias("sightings"), F.max("sightings").alias("most"))


@query
def q_detections(b: Bridge) -> DataFrame:
    return _boxes(b).select("clip_id", "frame_index", "box_position", "track_id", "class_id", "class_name", "category", "confidence")


@query
def q_class_check(b: Bridge) -> DataFrame:
    names = b.table("raw_detections").select(F.col("class_id").cast("int").alias("class_id")).distinct()
    named = names.withColumn("class_name", F.when(F.col("class_id") == 0, "person").when(F.col("class_id") == 2, "car").when(F.col("class_id") == 7, "lorry").otherwise("bicycle"))
    return tracks.check_classes(named).select("class_id", "class_name", "category")


@query
def q_relabel(b: Bridge) -> DataFrame:
    return tracks.relabel(_boxes(b)).select("clip_id", "frame_index", "box_position", "category", "track_id", "label")


@query
def q_translation(b: Bridge) -> DataFrame:
    return tracks.translation(_boxes(b)).select("clip_id", "category", "track_id", "first_frame", "number", "label")


@query
def q_label_times(b: Bridge) -> DataFrame:
    by = tracks.times_by_label(_times(b))
    return by.select("clip_id", "label", F.size("times").alias("n"), F.element_at("times", 1).alias("first_s"), F.element_at("times", -1).alias("last_s"), F.round(F.aggregate("times", F.lit(0.0), lambda a, x: a + x), 6).alias("sum_s"))


@query
def q_identity_counts(b: Bridge) -> DataFrame:
    return tracks.identity_counts(_boxes(b))


@query
def q_frame_order(b: Bridge) -> DataFrame:
    entries = b.table("raw_detections").select("clip_id", F.col("box_position").alias("entry"), "frame_index")
    per = Window.partitionBy("clip_id").orderBy("entry")
    frames = entries.withColumn("frame_index", F.when(F.col("entry") % 97 == 0, F.col("frame_index")).otherwise(F.row_number().over(per) - 1))
    return tracks.frame_order_faults(frames).select("clip_id", "entry", "frame_index", "expected")


@query
def q_make_windows(b: Bridge) -> DataFrame:
    return b.windows().select("clip_id", "window_index", "start_s", "end_s")


@query
def q_window_gaps(b: Bridge) -> DataFrame:
    return windows.window_gaps(b.windows().where("window_index % 7 <> 3 AND window_index % 7 <> 4"))


@query
def q_window_plan(b: Bridge) -> DataFrame:
    return windows.planned_calls(b.windows())


@query
def q_probe_window(b: Bridge) -> DataFrame:
    best = accounting.surest(b.table("sightings")).join(b.table("clips"), "clip_id")
    return best.select("clip_id", windows.probe_window(F.col("duration_s"), F.col("evidence_time_s")).alias("w")).select("clip_id", "w.*")


@query
def q_timeline(b: Bridge) -> DataFrame:
    return _frames(b).groupBy("clip_id").agg(F.count("*").alias("frames"), F.max("t_s").alias("last_s"))


@query
def q_size_rule(b: Bridge) -> DataFrame:
    return b.table("clips").select("clip_id", "height", numbers.detector_size(F.col("height")).alias("imgsz"))


@query
def q_track_buffer(b: Bridge) -> DataFrame:
    return b.table("clips").select("clip_id", "fps", "buffer_seconds", numbers.track_buffer(F.col("buffer_seconds"), F.col("fps")).alias("frames"))


@query
def q_slug(b: Bridge) -> DataFrame:
    clips = b.table("clips").withColumn("imgsz", numbers.detector_size(F.col("height")))
    return clips.select("clip_id", text.tracking_slug(*(F.col(c) for c in ("weights", "tracker", "reid", "imgsz", "buffer_seconds"))).alias("slug"))


@query
def q_run_tag(b: Bridge) -> DataFrame:
    events = b.spark.read.parquet(f"{b.dir}/events.parquet").where("ts IS NOT NULL")
    model = F.when(F.col("event_id") % 3 == 0, "gemini-3.8-flash").otherwise("org/local-27b")
    backend = text.backend_slug(F.when(F.col("event_id") % 3 == 0, "hosted").otherwise("local"), model)
    w = F.when(F.col("event_id") % 2 == 0, F.lit(8.0))
    s = F.when(F.col("event_id") % 2 == 0, F.when(F.col("event_id") % 4 == 0, 4.0).otherwise(2.5))
    start = F.when(F.col("event_id") % 5 != 0, F.col("ts"))
    return events.select("event_id", text.run_tag(backend, w, s, start).alias("tag"))


@query
def q_prompt(b: Bridge) -> DataFrame:
    own = b.windows().join(b.table("clips").select("clip_id", "duration_s"), "clip_id")
    asked = text.prompt(F.col("clip_id"), F.col("duration_s"), F.col("start_s"), F.col("end_s"))
    return own.select("clip_id", "window_index", asked.alias("prompt"))


@query
def q_draw_metrics(b: Bridge) -> DataFrame:
    return b.table("clips").select("clip_id", geometry.draw_sizes(F.col("width"), F.col("height")).alias("m")).select("clip_id", "m.*")


def _rects(b: Bridge) -> DataFrame:
    boxes = b.table("raw_detections").join(b.table("clips").select("clip_id", "width", "height"), "clip_id")
    return boxes.withColumn("r", geometry.box_rect(*(F.col(c) for c in ("x1", "y1", "x2", "y2", "width", "height")))).withColumn("m", geometry.draw_sizes(F.col("width"), F.col("height")))


@query
def q_box_clamp(b: Bridge) -> DataFrame:
    return _rects(b).select("clip_id", "box_position", F.col("r.left").alias("x_left"), F.col("r.top").alias("y_top"), F.col("r.right").alias("x_right"), F.col("r.bottom").alias("y_bottom"))


@query
def q_outline_rule(b: Bridge) -> DataFrame:
    return _rects(b).select("clip_id", "box_position", geometry.outlined(F.col("r"), F.col("m.thickness")).alias("outlined"))


@query
def q_label_candidates(b: Bridge) -> DataFrame:
    rects = geometry.candidate_rects(F.col("r"), F.lit(40).cast("long"), F.lit(18).cast("long"), F.col("m.clearance"), F.col("width"), F.col("height"))
    one = F.posexplode(F.transform(rects, lambda r: F.concat_ws(":", r["left"], r["top"], r["right"], r["bottom"])))
    return _rects(b).select("clip_id", "box_position", one.alias("place", "rect"))


@query
def q_rect_overlap(b: Bridge) -> DataFrame:
    own = _rects(b).select("clip_id", "frame_index", "box_position", "r")
    l, r = own.alias("l"), own.alias("r")
    same = (F.col("l.clip_id") == F.col("r.clip_id")) & (F.col("l.frame_index") == F.col("r.frame_index")) & (F.col("l.box_position") < F.col("r.box_position"))
    return l.join(r, same).where(geometry.intersects(F.col("l.r"), F.col("r.r"))).select("l.clip_id", F.col("l.box_position").alias("left_box"), F.col("r.box_position").alias("right_box"))


@query
def q_label_layout(b: Bridge) -> DataFrame:
    boxes = tracks.relabel(_boxes(b)).select("clip_id", "frame_index", "category", "track_id", "x1", "y1", "x2", "y2")
    return layout.layout(boxes, b.table("clips"))


@query
def q_json_repair(b: Bridge) -> DataFrame:
    return responses.parse(b.table("responses")).where("raw_text IS NOT NULL").select("event_id", F.length("repaired_text").alias("n"), F.col("payload").isNotNull().alias("is_json"))


@query
def q_parse_response(b: Bridge) -> DataFrame:
    return responses.parse(b.table("responses")).select("event_id", F.coalesce("parse_error", F.lit("ok")).alias("outcome"))


@query
def q_validate(b: Bridge) -> DataFrame:
    return _checked(b).select("event_id", "position", joined("errors"))


@query
def q_accepted(b: Bridge) -> DataFrame:
    good = _checked(b).where(F.size("errors") == 0).select("event_id", *responses.record())
    return good.select("event_id", joined("person_ids"), joined("vehicle_ids"), "interaction", "start_time_s", "evidence_time_s", "end_time_s", "confidence")


@query
def q_shift_times(b: Bridge) -> DataFrame:
    moved = responses.with_numbers(responses.shift_times(_items(b), F.lit(16.5)), responses.TIMES)
    return moved.select("event_id", "position", *(F.col(f"n_{n}").alias(n) for n in responses.TIMES))


@query
def q_label_regex(b: Bridge) -> DataFrame:
    n = F.col("event_id")
    made = F.concat(F.when(n % 3 == 0, "P").when(n % 3 == 1, "V").otherwise("p"), F.when(n % 5 == 0, "0").otherwise(""), F.when(n % 7 == 0, "").otherwise(n.cast("string")))
    return b.table("ev").select("event_id", made.alias("label")).select("event_id", "label", labels.is_label(F.col("label"), "P").alias("person"), labels.is_label(F.col("label"), "V").alias("vehicle"))


@query
def q_verify_labels(b: Bridge) -> DataFrame:
    return _verified(b).select("clip_id", "position", *(joined(c) for c in ("person_ids", "vehicle_ids", "unverified_person_ids", "unverified_vehicle_ids")))


@query
def q_unverified_hist(b: Bridge) -> DataFrame:
    return verify.unverified_counts(_verified(b)).select("label", "times")


@query
def q_unverified_line(b: Bridge) -> DataFrame:
    own = _verified(b).withColumn("run_id", F.col("clip_id"))
    return verify.unverified_lines(own).select(F.col("run_id").alias("clip_id"), "line")


@query
def q_usage_cost(b: Bridge) -> DataFrame:
    prices = b.spark.createDataFrame([("gemini-3.8-flash", 0.75, 3.75), ("org/local-27b", 0.0, 0.0)], "model_id string, usd_per_m_in double, usd_per_m_out double")
    return accounting.usage_cost(b.table("calls"), prices).select("l_orderkey", "l_linenumber", "billable_output_tokens", "estimated_cost_usd")


@query
def q_usage_sum(b: Bridge) -> DataFrame:
    c = F.col
    usage = F.map_from_arrays(
        F.array(F.lit("total_input_tokens"), F.when(c("l_linenumber") % 2 == 0, "total_thought_tokens").otherwise("total_output_tokens")),
        F.array(c("total_input_tokens").cast("double"), F.when(c("l_linenumber") % 2 == 0, c("total_thought_tokens")).otherwise(F.coalesce("total_output_tokens", F.lit(0))).cast("double")),
    )
    return accounting.usage_sum(b.table("calls").withColumn("usage", usage), ("clip_id",))


@query
def q_run_status(b: Bridge) -> DataFrame:
    return accounting.run_status(b.table("calls")).select("clip_id", "calls", "failed_windows", F.coalesce("error", F.lit("")).alias("error"))


@query
def q_run_summary(b: Bridge) -> DataFrame:
    sightings, spans = b.table("sightings"), b.windows()
    _, malformed = responses.split_items(_checked(b))
    # An event is a group; its fields don't count here.
    events = merge.group_sightings(sightings).select("run_id", "clip_id", "group").distinct()
    return accounting.run_summary(sightings, events, spans, malformed).drop("run_id")


@query
def q_summary_rollup(b: Bridge) -> DataFrame:
    return accounting.report_rollup(b.table("sightings"))


@query
def q_argmax(b: Bridge) -> DataFrame:
    return accounting.surest(b.table("sightings")).drop("run_id")


@query
def q_mode_compare(b: Bridge) -> DataFrame:
    own = b.table("sightings")
    by_whole_clip = F.coalesce(F.col("event_id") % 3 == 0, F.lit(True))
    return accounting.compare_modes(own.where(by_whole_clip), own.where(~by_whole_clip))


@query
def q_batch_outcome(b: Bridge) -> DataFrame:
    runs = accounting.run_status(b.table("calls"))
    return accounting.batch_outcome(runs.select(F.when(F.col("clip_id") == "clip3", "ValueError: no frames").alias("error"), F.col("error").alias("run_error")))


@query
def q_clip_order(b: Bridge) -> DataFrame:
    at = Window.partitionBy("clip_id").orderBy("start_time_s", "end_time_s", "window_index", "event_id")
    return b.table("sightings").select("clip_id", "event_id", (F.row_number().over(at) - 1).alias("place"), labels.ids_text(F.col("person_ids")).alias("people"), text.shortened(F.col("interaction"), 6).alias("short"))


@query
def q_nearest_frame(b: Bridge) -> DataFrame:
    moments = b.table("sightings").select("clip_id", "event_id", (F.col("evidence_time_s") % 864).alias("t_s"))
    # Frames at uneven distances, as of a timeline with gaps.
    odd = _frames(b).where("frame % 5 <> 2")
    return coverage.nearest_frame(moments, odd).select("clip_id", "event_id", "nearest_frame")


@query
def q_display_order(b: Bridge) -> DataFrame:
    own = b.table("sightings")
    strip = reports.by_confidence(own).select("clip_id", "event_id", F.col("place").alias("strip_place"))
    return strip.join(reports.by_window(own).select("event_id", F.col("place").alias("list_place")), "event_id")


@query
def q_label_order(b: Bridge) -> DataFrame:
    return reports.label_order(tracks.translation(_boxes(b))).select("clip_id", "label", "place")


@query
def q_malformed_order(b: Bridge) -> DataFrame:
    _, malformed = responses.split_items(_checked(b).withColumn("window_index", F.col("event_id")))
    return reports.in_call_order(malformed).select("clip_id", "window_index", "position", "place")


@query
def q_shortest_clip(b: Bridge) -> DataFrame:
    return reports.shortest_clip(b.table("clips"))


@query
def q_batch_lines(b: Bridge) -> DataFrame:
    runs = accounting.run_status(b.table("calls")).withColumnRenamed("error", "run_error")
    counts = b.table("sightings").groupBy("clip_id").agg(F.count("*").alias("source_interaction_count"))
    results = runs.join(counts, "clip_id", "left").withColumns({"error": F.when(F.col("clip_id") == "clip3", "ValueError: no frames"), "merged_interaction_count": F.lit(2), "malformed_count": F.lit(0)})
    return reports.batch_lines(results)


@query
def q_evidence_strip(b: Bridge) -> DataFrame:
    hit = coverage.covered_frames(b.table("sightings"), b.windows(), _frames(b), PER_SECOND, 0.9)
    must = hit.groupBy("run_id", "clip_id").agg(F.min(F.when(F.col("frame") % 7 == 3, F.col("frame"))).alias("frame"))
    return coverage.strip_frames(hit, evidence=must).select("clip_id", "frame")


@query
def q_coverage(b: Bridge) -> DataFrame:
    return coverage.coverage(b.table("sightings"), b.windows(), _frames(b), PER_SECOND, 0.4).drop("run_id")


@query
def q_unexamined(b: Bridge) -> DataFrame:
    return coverage.unexamined_frames(b.windows(), _frames(b), PER_SECOND).select("clip_id", "frame")


@query
def q_filmstrip(b: Bridge) -> DataFrame:
    hit = coverage.covered_frames(b.table("sightings"), b.windows(), _frames(b), PER_SECOND, 0.9)
    return coverage.strip_frames(hit).select("clip_id", "frame")
