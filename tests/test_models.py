"""Backends over stub clients, options, rendering, and a batch from detections to documents."""

import json
from types import SimpleNamespace

import pytest

from framewake.plans.options import Options, parse, size_or_auto
from framewake.plans.run import run_batch
from framewake.sources.backend import Replay, ask
from framewake.sources.models import Hosted, Local, Uploads, pick_device, pick_runtime, response_schema, usage_of
from framewake.sources.render import render_clips


def uploads(states, log):
    it = iter(states)
    make = lambda *_: SimpleNamespace(name="f", state=next(it))
    return Uploads(lambda p: (log.append(p), make())[1], make, lambda n: log.append(f"-{n}"), timeout_s=0.2, poll_s=0.01)


def test_upload_states():
    log = []
    up = uploads(["PROCESSING", "ACTIVE"], log)
    assert up("a") is up("a") and log == ["a"] and up.clear() == ["f"] and up.clear() == []
    for states, error in ((["FAILED"], RuntimeError), (["ODD"], RuntimeError), (["PROCESSING"] * 99, TimeoutError)):
        with pytest.raises(error):
            uploads(states, [])("a")
    up.delete, up.handles = (lambda n: 1 / 0), {"a": SimpleNamespace(name="f")}
    assert up.clear() == [] and not up.handles


def test_hosted_and_local():
    seen = []
    call = lambda handle, prompt, window, schema, store: (seen.append((window, store)), ("{}", {"total_input_tokens": 1000, "total_output_tokens": 200, "total_thought_tokens": 400}))[1]
    hosted = Hosted(uploads(["ACTIVE"], []), call, {"c": "c.mp4"})
    answer = hosted.generate("c", "p", (4.0, 8.0))
    assert seen == [((4.0, 8.0), False)] and answer.usage["billable_output_tokens"] == 600 and answer.usage["estimated_cost_usd"] == 0.003 and hosted.tolerance_s == 0.5
    assert usage_of(None, "gemini-3.8-flash") == {}
    with pytest.raises(ValueError):
        Hosted(None, call, {}, "other")
    cut = []
    local = Local(lambda p, w: (cut.append(w), "seg")[1], lambda p, q: (p + q[-20:], {"n": 1.0}), {"c": "c.mp4"}, "m", response_schema())
    assert local.generate("c", "p", (4.0, 8.0)).usage == {"n": 1.0, "estimated_cost_usd": 0.0} and cut == [(4.0, 8.0)] and local.tolerance_s == 1.0
    with pytest.raises(ValueError):
        Local(local.trim, local.run, local.path_of, "m", {"properties": {}}).generate("c", "p", (4.0, 8.0))
    assert [pick_device(*x) for x in ((True, True), (False, True), (False, False))] == ["cuda", "mps", "cpu"]
    assert pick_runtime("Darwin", "arm64") == "mlx" and pick_runtime("Linux", "x86_64") == "torch"


def test_uploads_go_when_calls_are_made(spark):
    """Whatever a backend has open is closed by the task that used it, after failing calls too."""
    closed = spark.sparkContext.accumulator(0)

    class Failing:
        tolerance_s, segment_local = 0.0, False

        def generate(self, clip_id, prompt, window):
            raise RuntimeError("no")

        def close(self):
            closed.add(1)

    requests = spark.createDataFrame([("r", "c", 0, 0.0, 1.0, "p")], "run_id string, clip_id string, window_index int, start_s double, end_s double, prompt string")
    assert "no" in ask(requests.coalesce(1), Failing()).collect()[0].error and closed.value == 1


def test_options():
    assert Options("i", "o").window() == (8.0, 4.0) and Options("i", "o", whole_clip=True).window() is None
    assert parse(["i", "o", "--backend", "local", "--model-id", "m", "--max-new-tokens", "9", "--seed", "2"]).backend_settings() == {"max_new_tokens": 9, "seed": 2}
    for bad in ({"whole_clip": True, "window_s": 8.0}, {"window_s": -1.0}, {"window_s": 2.0}, {"backend": "local"}, {"max_new_tokens": 9}, {"backend": "local", "model_id": "m", "fps": 2.0}, {"backend": "x"}, {"buffer_seconds": 0.0}):
        with pytest.raises(ValueError):
            Options("i", "o", **bad).check()
    with pytest.raises(SystemExit):
        parse(["i", "o", "--window-s", "0"])
    assert size_or_auto("auto") is None and size_or_auto("640") == 640
    with pytest.raises(Exception, match="whole number"):
        size_or_auto("-1")


def test_render(spark, tmp_path):
    clips = spark.createDataFrame([("a", "a.mp4", f"{tmp_path}/a.out", 4, 4), ("b", "b.mp4", f"{tmp_path}/b.out", 3, 4), ("c", f"{tmp_path}/c", f"{tmp_path}/c", 4, 4), ("d", "d.mp4", f"{tmp_path}/d.out", 4, 4)], "clip_id string, path string, output string, width int, height int")
    layouts = spark.createDataFrame([("a", 1, "person", 2, "P2", 0, 0, 1, 1, False), ("a", 0, "person", 1, "P1", 0, 0, 1, 1, False)], "clip_id string, frame_index long, category string, track_id long, label string, rect_left long, rect_top long, rect_right long, rect_bottom long, fallback boolean")

    def encode(clip, frames, file):
        with open(file, "w") as f:
            rows = [(k, [x["label"] for x in own]) for k, own in frames]
            f.write(json.dumps(rows))
        if clip["clip_id"] == "d":
            raise RuntimeError("broken")
        return len(rows)

    got = {r.clip_id: r for r in render_clips(clips, layouts, encode).collect()}
    assert got["a"].frames == 2 and json.loads((tmp_path / "a.out").read_text()) == [[0, ["P1"]], [1, ["P2"]]]
    assert "even" in got["b"].error and "source" in got["c"].error and "broken" in got["d"].error
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.out"]


def test_batch(spark, tmp_path):
    clips = spark.createDataFrame([("a", 10.0, "25/1", None), ("b", 10.0, "25/1", None), ("x", None, None, "ValueError: no frames")], "clip_id string, duration_s double, fps string, error string")
    raw = spark.createDataFrame([("a", f, 0, 7, 0, 0.9, 0.0, 0.0, 5.0, 5.0) for f in range(50)] + [("a", f, 1, 3, 2, 0.9, 0.0, 0.0, 5.0, 5.0) for f in range(50)], "clip_id string, frame_index long, box_position int, track_id long, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double")
    item = {"person_ids": ["P1", "P5"], "vehicle_ids": ["V1"], "person_description": "a", "vehicle_description": "b", "interaction": "c", "start_time_s": 0.5, "evidence_time_s": 1.0, "end_time_s": 1.5, "confidence": 0.9}
    backend = Replay({("a", 0.0): json.dumps({"interactions": [item]}), ("b", 0.0): "!late"}, tolerance_s=0.5)
    results, code = run_batch(clips, raw, backend, "r1", None, f"{tmp_path}/out")
    got = {r.clip_id: r for r in results.collect()}
    assert code == 1 and got["a"].merged_interaction_count == 1 and (got["a"].people, got["a"].vehicles) == (1, 1) and got["b"].run_error == "all 1 call(s) failed" and got["x"].error
    records = {r.clip_id: json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out/records").collect()}
    assert records["a"]["run_tag"] == "r1" and "lasts 10.0 s" in records["a"]["calls"][0]["prompt"] and (records["b"]["failed_windows"], "late" in records["b"]["calls"][0]["error"]) == (1, True)
    documents = {r.clip_id: json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out/documents").collect()}
    assert documents["a"]["interactions"][0]["person_ids"] == ["P1"] and spark.read.parquet(f"{tmp_path}/out/calls").count() == 2
