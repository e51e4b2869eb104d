"""Tracks, windows, geometry, coverage, text and sources."""

import json
import math
import random
import re
from decimal import Decimal
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from framewake.functions import geometry, numbers, text
from framewake.operators import accounting, coverage, layout, reports, tracks, windows
from framewake.sources import clips as clip_source
from framewake.sources.sinks import event_documents, write_documents
from framewake.sources.tracker import track_clips, tracker_config
from framewake.streaming.live import label_activity

RAW = "clip_id string, frame_index long, box_position int, track_id long, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double"


def boxes(spark, rows):
    return spark.createDataFrame([("c", f, k, t, c, 0.5, 0.0, 0.0, 9.0, 9.0) for k, (f, t, c) in enumerate(rows)], RAW)


def test_detections_and_numbering(spark):
    raw = boxes(spark, [(10, 7, 0), (10, 7, 2), (10, None, 0), (10, 3, 1), (11, 2, 0), (11, 7, 7), (12, 2, 0)])
    own = tracks.detections(raw)
    assert own.count() == 5
    got = {(r.category, r.track_id): r.label for r in tracks.translation(own).collect()}
    assert got == {("person", 7): "P1", ("person", 2): "P2", ("vehicle", 7): "V1"}
    times = tracks.times_by_label(tracks.label_times(tracks.relabel(own), spark.createDataFrame([("c", "30000/1001")], "clip_id string, fps string")))
    assert {r.label: r.times for r in times.collect()}["V1"] == [10 / (30000 / 1001), 11 / (30000 / 1001)]
    assert tracks.identity_counts(own).first()[1:] == (2, 1)
    assert tracks.translation(own.limit(0)).count() == 0


def test_class_check(spark):
    names = tracks.class_table(spark).select("class_id", "class_name")
    assert tracks.check_classes(names).isEmpty()
    assert tracks.check_classes(names.where("class_id <> 7")).first().class_name == "truck"


@pytest.mark.parametrize(
    ("d", "w", "s"), [(27.3, 6.0, 4.0), (9.2, 6.0, 4.0), (5.0, 6.0, 4.0), (26.0, 6.0, 4.0), (20.0, 5.0, 5.0), (1.1, 0.3, 0.1)]
)
def test_windows_cover_a_clip(spark, d, w, s):
    made = windows.make_windows(spark.createDataFrame([("c", d)], "clip_id string, duration_s double"), w, s)
    spans = [(r.start_s, r.end_s) for r in made.orderBy("window_index").collect()]
    assert spans[0][0] == 0.0 and spans[-1][1] == d and len(set(spans)) == len(spans)
    assert windows.window_gaps(made).isEmpty()
    assert len(spans) == {27.3: 7, 9.2: 2, 5.0: 1, 26.0: 6, 20.0: 4, 1.1: 9}[d]


def test_buffers_sizes_and_rates(spark):
    df = spark.createDataFrame([("30000/1001", 90, 1080), ("25/1", 75, 2160), ("6/1", 20, 1079), ("25", 75, 288)], "fps string, want int, h int")
    assert all(r.got == r.want for r in df.withColumn("got", numbers.track_buffer(F.lit(3.0), F.col("fps"))).collect())
    assert [r.s for r in df.select(numbers.detector_size(F.col("h")).alias("s")).collect()] == [1280, 1280, 640, 640]
    bad = spark.createDataFrame([("0/0",), ("0/1",), ("x",), (None,)], "fps string").select(numbers.fps_value(F.col("fps")).alias("v"))
    assert all(r.v is None for r in bad.collect())


def test_exact_rounding(spark):
    df = spark.createDataFrame([(0.35,), (0.25,), (27.25,), (None,)], "x double")
    assert [r.y for r in df.select(numbers.exact_round(F.col("x"), 1).alias("y")).collect()] == [0.3, 0.2, 27.2, None]
    rng = random.Random(1)
    some = [rng.choice([rng.uniform(-1e4, 1e4), rng.randrange(-4000, 4000) / 8, rng.randrange(10**9) / 10**7, rng.randrange(10**6) / 20, rng.randrange(10**8) * 5e-7, rng.uniform(-1, 1) * 10.0 ** rng.randrange(-12, 25)]) for _ in range(4000)] + [0.0, -0.0, 1e300, math.inf]
    table = spark.createDataFrame([(x,) for x in some], "x double")
    for digits in (0, 1, 3, 6, 7):
        got = [r.y for r in table.select(numbers.exact_round(F.col("x"), digits).alias("y")).collect()]
        assert got == [round(x, digits) if abs(x) < 2**52 / 10**digits else x for x in some]


def test_draw_sizes_and_layout(spark):
    clips = spark.createDataFrame([("a", 3840, 2160), ("b", 1280, 720), ("d", 640, 360)], "clip_id string, width int, height int")
    got = {r.clip_id: tuple(r.m) for r in clips.select("clip_id", geometry.draw_sizes(F.col("width"), F.col("height")).alias("m")).collect()}
    assert got == {"a": (4, 2.0, 2, 3), "b": (2, 720 / 1080, 1, 2), "d": (2, 0.5, 1, 2)}
    same = spark.createDataFrame([("b", 0, "person" if k % 2 else "vehicle", k // 2, 600.0, 300.0, 700.0, 400.0) for k in range(9)], "clip_id string, frame_index int, category string, track_id long, x1 double, y1 double, x2 double, y2 double")
    rects = [(r.rect_left, r.rect_top, r.rect_right, r.rect_bottom) for r in layout.layout(same, clips).orderBy("track_id", "category").collect()]
    assert len(rects) == 9 and all(0 <= x and 0 <= y and r <= 1280 and b <= 720 for x, y, r, b in rects)
    hit = lambda a, b: a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]
    assert not any(hit(a, b) for i, a in enumerate(rects[:6]) for b in rects[:i])
    tall = spark.createDataFrame([("d", 0, "person", 1, 0.0, 0.0, 640.0, 360.0)], same.schema)
    assert layout.layout(tall, clips).count() == 1


def test_nearest_frame_ties_go_low(spark):
    frames = spark.createDataFrame([("c", k, k / 2) for k in range(20)], "clip_id string, frame long, t_s double")
    asked = spark.createDataFrame([("c", 0.25), ("c", 0.26), ("c", 99.0), ("c", 0.25)], "clip_id string, t_s double")
    assert sorted(r.nearest_frame for r in coverage.nearest_frame(asked, frames).collect()) == [0, 0, 1, 19]


def test_nearest_frame_against_all_frames(spark):
    rng = random.Random(4)
    frames = [(c, k, rng.randrange(400) / 4) for c in "ab" for k in range(30)]
    moments = [(c, k, rng.randrange(-40, 900) / 8) for k, c in enumerate("ab" * 60)] + [("z", 500, 1.0), ("a", 501, None), (None, 502, 1.0)]
    got = coverage.nearest_frame(spark.createDataFrame(moments, "clip_id string, k int, t_s double"), spark.createDataFrame(frames, "clip_id string, frame long, t_s double"))
    want = {k: min(((abs(t - at), f) for c, f, t in frames if c == clip), default=(0, None))[1] for clip, k, at in moments if at is not None}
    found = {r.k: r.nearest_frame for r in got.collect()}
    assert len(found) == len(moments) and all(found[k] == f for k, f in want.items())


def test_windows_by_definition(spark):
    """Window k begins at k strides and ends inside the clip; the last ends with it; one that is the last counts once."""
    rng = random.Random(9)
    cases = [(rng.randrange(1, 4000) / rng.choice([10, 7, 8]), rng.randrange(1, 90) / 10, rng.randrange(1, 90) / 10) for _ in range(60)] + [(20.0, 8.0, 4.0), (20.03, 8.0, 4.0), (8.0, 8.0, 4.0), (0.04, 8.0, 4.0), (27.25, 8.0, 8.0)]
    for d, w, step in cases:
        step = min(w, step)
        width, stride, n = Decimal(str(w)), Decimal(str(step)), 0
        want = []
        while stride * n + width < Decimal(d):
            want.append((float(stride * n), float(stride * n + width)))
            n += 1
        last = (round(max(0.0, d - w), 1), round(d, 1))
        want += [last] if last not in want[-1:] else []
        made = windows.make_windows(spark.createDataFrame([("c", d), ("n", None)], "clip_id string, duration_s double"), w, step).orderBy("window_index").collect()
        assert [(r.start_s, r.end_s) for r in made] == want and [r.window_index for r in made] == list(range(len(want)))


def test_coverage_credits_only_the_reporting_window(spark):
    frames = spark.createDataFrame([("c", k, k / 2) for k in range(24)], "clip_id string, frame long, t_s double")
    spans = spark.createDataFrame([("r", "c", 0, 0.0, 4.0, None), ("r", "c", 1, 3.0, 7.0, "late"), ("r", "c", 2, 8.0, 12.0, None)], "run_id string, clip_id string, window_index int, start_s double, end_s double, error string")
    seen = spark.createDataFrame([("r", "c", 0, 2.0, 6.0, 0.9), ("r", "c", 2, 8.0, 8.5, 0.1)], "run_id string, clip_id string, window_index int, start_time_s double, end_time_s double, confidence double")
    r = coverage.coverage(seen, spans, frames, 2, 0.5).first()
    assert (r.frames, r.covered, r.never_examined, r.missed) == (24, 5, 6, 13)


def test_usage(spark):
    calls = spark.createDataFrame([("r", "m", 1000, 200, 400), ("r", "m", None, None, None)], "run_id string, model_id string, total_input_tokens int, total_output_tokens int, total_thought_tokens int")
    prices = spark.createDataFrame([("m", 10.0, 100.0)], "model_id string, usd_per_m_in double, usd_per_m_out double")
    assert [(r.billable_output_tokens, r.estimated_cost_usd) for r in accounting.usage_cost(calls, prices).collect()] == [(600.0, 0.07), (0.0, 0.0)]
    assert accounting.unpriced_models(calls, prices).isEmpty()
    with pytest.raises(Exception, match="no price is known for m"):
        accounting.usage_cost(calls, prices.limit(0)).collect()
    maps = spark.createDataFrame([("r", {"a": 10.0, "b": 0.5}), ("r", {"a": 4.0}), ("r", {})], "run_id string, usage map<string,double>")
    assert accounting.usage_map(maps).first().usage == {"a": 14.0, "b": 0.5}


@pytest.mark.parametrize(("errors", "want"), [(["x", None, None], (1, None)), (["x", "y", "z"], (3, "all 3 call(s) failed"))])
def test_run_status(spark, errors, want):
    calls = spark.createDataFrame([("r", "c", e) for e in errors], "run_id string, clip_id string, error string")
    r = accounting.run_status(calls).first()
    assert (r.failed_windows, r.error) == want


def test_slugs(spark):
    row = spark.range(1).select(
        text.tracking_slug(F.lit("a b/yolo26x.pt"), F.lit("tracktrack.yaml"), F.lit("auto"), F.lit(1280), F.lit(3.0)).alias("t"),
        text.run_tag(F.lit("m"), F.lit(8.0), F.lit(2.5), F.lit("2026-01-02 03:04:05.678").cast("timestamp_ntz")).alias("r"),
        text.run_tag(F.lit("m"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("timestamp_ntz")).alias("w"),
    ).first()
    assert row == ("yolo26x__tracktrack__reid-auto__imgsz1280__buf3", "m__w8s2.5__a3__20260102-030405-678", "m__a3")


def test_discovery_and_probe(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for name in ("b.mp4", "a.mp4", "x.txt", "sub/c.mp4"):
        (tmp_path / "in" / name).write_bytes(b"12")
    found = clip_source.discover_clips(spark, f"{tmp_path}/in")
    assert [r.clip_id for r in found.collect()] == ["a", "b"]
    assert clip_source.discover_clips(spark, f"{tmp_path}/in/a.mp4").count() == 1
    for where in ("none", "in/sub/none"):
        with pytest.raises(FileNotFoundError):
            clip_source.discover_clips(spark, f"{tmp_path}/{where}")
    with pytest.raises(ValueError):
        clip_source.discover_clips(spark, f"{tmp_path}/in", f"{tmp_path}/in/")
    probe = lambda path: {"width": 64, "height": 48, "fps": "0/0" if path.endswith("b.mp4") else "25/1", "duration_s": 2.0}
    headers = {r.path[-5:]: r for r in clip_source.probe_clips(found, probe).collect()}
    assert headers["a.mp4"].error is None and "no frame rate" in headers["b.mp4"].error


def test_tracker_seam(spark):
    one = lambda clip: iter([[(1, 0, 0.9, 0.0, 0.0, 5.0, 5.0)], [], [(None, 2, 0.8, 0.0, 0.0, 5.0, 5.0)]])
    raw = track_clips(spark.createDataFrame([("a",), ("b",)], "clip_id string"), one)
    assert (raw.count(), tracks.detections(raw).count()) == (4, 2)
    assert tracker_config({"tracker_type": "botsort", "track_buffer": 30, "with_reid": False}, 90, "m.onnx") == {"tracker_type": "botsort", "track_buffer": 90, "with_reid": True, "model": "m.onnx"}
    for bad in ({"tracker_type": "none"}, {"tracker_type": "botsort"}, {"tracker_type": "bytetrack", "track_buffer": 1}):
        with pytest.raises(ValueError):
            tracker_config(bad, 90, "m.onnx")


def test_documents(spark, tmp_path):
    events = spark.createDataFrame([("r", "c", 0, ["P1"], 1.5), ("r", "c", 1, [], 2.5)], "run_id string, clip_id string, event_index long, person_ids array<string>, start_time_s double")
    summary = spark.createDataFrame([("r", "c", 3, "line"), ("r", "d", 0, "line")], "run_id string, clip_id string, failed_windows int, line string")
    made = event_documents(events, summary)
    write_documents(made, f"{tmp_path}/out")
    back = {r.clip_id: r.value for r in spark.read.text(f"{tmp_path}/out").collect()}
    assert set(back) == {"c", "d"} and back["c"].index('"event_index":0') < back["c"].index('"event_index":1')


def test_live_activity(spark, tmp_path):
    boxes(spark, [(0, 1, 0), (1, 1, 0), (2, None, 0)]).withColumn("seen_at", F.lit("2026-01-01 00:00:01").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    run = label_activity(stream).writeStream.outputMode("complete").format("memory").queryName("activity").option("checkpointLocation", f"{tmp_path}/state").start()
    run.processAllAvailable()
    run.stop()
    assert [(r.boxes, r.identities) for r in spark.table("activity").collect()] == [(2, 1)]


def test_probing_by_ffprobe(spark):
    told = lambda out, code=0: lambda command, **_: SimpleNamespace(returncode=code, stdout=json.dumps(out), stderr="broken header")
    here = lambda name: f"/bin/{name}"
    stream = {"width": 640, "height": 360, "avg_frame_rate": "30000/1001", "nb_frames": "818"}
    assert clip_source.ffprobe("a.mp4", told({"streams": [stream], "format": {"duration": "27.3"}}), here) == {"width": 640, "height": 360, "fps": "30000/1001", "duration_s": 27.3, "frames": 818}
    for out, code, error in (({}, 1, RuntimeError), ({"streams": []}, 0, ValueError)):
        with pytest.raises(error, match="a.mp4"):
            clip_source.ffprobe("a.mp4", told(out, code), here)
    with pytest.raises(FileNotFoundError, match="ffprobe"):
        clip_source.ffprobe("a.mp4", told({}), lambda name: None)
    headers = {"a": {**stream, "avg_frame_rate": "0/0"}, "b": stream, "c": {**stream, "nb_frames": "N/A"}}
    probe = lambda path: clip_source.ffprobe(path, told({"streams": [headers[path]], "format": {} if path == "b" else {"duration": "3"}}), here)
    got = {r.path: r for r in clip_source.probe_clips(spark.createDataFrame([(p,) for p in headers], "path string"), probe).collect()}
    assert "frame rate" in got["a"].error and "duration" in got["b"].error and (got["c"].error, got["c"].frames, got["c"].duration_s) == (None, None, 3.0)


def test_reports(spark):
    none = spark.createDataFrame([("c", None)], "clip_id string, duration_s double")
    assert reports.shortest_clip(none).isEmpty() and reports.shortest_clip(none.unionByName(spark.createDataFrame([("b", 2.0), ("a", 2.0)], none.schema))).first().clip_id == "a"
    names = spark.createDataFrame([("c", "person", f"P{k}") for k in (10, 9, 1, 2)], "clip_id string, category string, label string")
    assert [r.label for r in reports.label_order(names).orderBy("place").collect()] == ["P1", "P2", "P9", "P10"]
    covered = spark.createDataFrame([("r", "c", k) for k in range(0, 40, 2)], "run_id string, clip_id string, frame long")
    shown = lambda f: sorted(r.frame for r in coverage.strip_frames(covered, evidence=spark.createDataFrame([("r", "c", f)], covered.schema)).collect())
    assert sorted(r.frame for r in coverage.strip_frames(covered).collect()) == shown(None) == shown(8) == [0, 8, 16, 22, 30, 38]
    assert shown(12) == [0, 12, 16, 22, 30, 38] and shown(34) == [0, 8, 16, 22, 34, 38]
    at = spark.sql("SELECT TIMESTAMP'2024-03-01 12:00:00.0125' AS t").select(text.iso_time(F.col("t")).alias("s")).first().s
    assert re.fullmatch(r"2024-0[23]-[0-9]{2}T[0-9:]{8}\.012\+00:00", at)
