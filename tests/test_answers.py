"""Answers of models to sightings."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from framewake.operators import responses, verify
from framewake.plans.run import events_of, find_interactions
from framewake.sources.backend import Replay, example_of, time_fields

BASE = {"person_ids": ["P1"], "vehicle_ids": ["V2"], "person_description": "a", "vehicle_description": "b", "interaction": "c", "start_time_s": 4.0, "evidence_time_s": 6.0, "end_time_s": 8.0, "confidence": 0.9}
LENGTH, SPAN, SLACK = 31.7, (9.0, 14.0), 0.75
GONE = object()


def rules(item, window):
    """Which rules an item breaks, from their definition."""
    if not isinstance(item, dict):
        return ["not_object"]
    times, ids = ("start_time_s", "evidence_time_s", "end_time_s"), {"person_ids": "P", "vehicle_ids": "V"}
    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool)
    label = lambda x, letter: isinstance(x, str) and re.fullmatch(f"{letter}[1-9][0-9]*", x)
    out = [f"missing:{k}" for k in BASE if k not in item]
    out += [f"not_number:{k}" for k in (*times, "confidence") if k in item and not number(item[k])]
    out += [f"not_string:{k}" for k in ("person_description", "vehicle_description", "interaction") if k in item and not isinstance(item[k], str)]
    for k, letter in ids.items():
        if k in item and not isinstance(item[k], list):
            out.append(f"not_list:{k}")
        elif not all(label(x, letter) for x in item.get(k, [])):
            out.append(f"bad_label:{k}")
    if out:
        return out
    start, seen, end = (item[k] for k in times)
    out = [f"outside_clip:{k}" for k in times if not 0 <= item[k] <= LENGTH]
    out += ["reversed_span"] if start > end else ["evidence_outside_span"] if not start <= seen <= end else []
    out += ["confidence_range"] if not 0 <= item["confidence"] <= 1 else []
    if window:
        low, high = window[0] - SLACK, window[1] + SLACK
        out += ["span_outside_window"] if end < low or start > high else []
        out += ["evidence_outside_window"] if not low <= seen <= high else []
    return out


def drawn_items(rng, count):
    """Items with up to three fields of any sort, among them those at the edges of every rule."""
    odd = [None, True, "7.5", "", 12, [], {}, [[]]]
    moments = [0, 0.0, -0.1, 8.25, 8.2, 9, 9.5, 14.75, 14.8, 31.7, 31.75, 40, *odd]
    pools = {k: moments for k in ("start_time_s", "evidence_time_s", "end_time_s")} | {"confidence": [0, 1, 1.001, -0.5, 0.25, *odd]}
    pools |= {k: ["text", "", *odd] for k in ("person_description", "vehicle_description", "interaction")}
    for k, own, other in (("person_ids", "P", "V"), ("vehicle_ids", "V", "P")):
        named = [f"{own}3", f"{own}12", f"{own}00", f"{own}07", f"{other}4", own, own.lower() + "2", f" {own}2", f"{own}2x", 8, None, ""]
        pools[k] = [[], *([x] for x in named), [f"{own}3", f"{own}3"], [f"{own}5", f"{other}5"], *odd]
    out = [BASE | dict(zip(("start_time_s", "evidence_time_s", "end_time_s"), sorted(rng.choice([8, 8.2, 8.25, 10, 14.75, 14.8, 20]) for _ in range(3)), strict=True)) for _ in range(count // 4)]
    while len(out) < count:
        item = dict(BASE)
        for k in rng.sample(sorted(pools), rng.randrange(4)):
            item[k] = rng.choice([GONE, *pools[k]])
        out.append({k: v for k, v in item.items() if v is not GONE})
    return [*out, *odd[:-2], [1], "text"]


@pytest.mark.parametrize("window", [None, SPAN])
def test_rules(spark, window):
    items = drawn_items(random.Random(3), 400)
    rows = [(k, json.dumps({"interactions": [item]}), LENGTH, *SPAN) for k, item in enumerate(items)]
    df = spark.createDataFrame(rows, "k int, raw_text string, duration_s double, start_s double, end_s double")
    got = responses.validated(responses.items(responses.parse(df)), window is not None, SLACK).select("k", "errors").collect()
    assert {r.k: sorted(r.errors) for r in got} == {k: sorted(rules(item, window)) for k, item in enumerate(items)}
    assert {e.partition(":")[0] for r in got for e in r.errors} >= {"missing", "not_number", "not_string", "not_list", "bad_label", "outside_clip", "reversed_span", "evidence_outside_span", "confidence_range", "not_object"}


def test_a_clip_has_one_length(spark):
    """What the prompt says is what an answer is held against: an end at the stated length is inside the clip."""
    clips = spark.createDataFrame([("c", 27.29863), ("d", 27.25)], "clip_id string, duration_s double")
    to = lambda end: json.dumps({"interactions": [BASE | {"end_time_s": end}]})
    run = find_interactions(clips, Replay({("c", 0.0): to(27.3), ("d", 0.0): to(27.25)}), "r")
    assert [r.end_time_s for r in run.sightings.collect()] == [27.3] and [r.errors for r in run.malformed.collect()] == [["outside_clip:end_time_s"]]
    prompts = {r.clip_id: r.prompt for r in run.calls.collect()}
    assert "lasts 27.3 s." in prompts["c"] and "<= 27.3." in prompts["c"] and "lasts 27.2 s." in prompts["d"] and "You see" not in prompts["c"]


@pytest.mark.parametrize(
    ("text", "outcome"),
    [
        ('{"interactions": []}', None), ('```json\n{"interactions": []}\n```', None), ('```\n{"interactions": []}\n```', None), ('Sure: {"interactions": []} ok', None),
        ("no json", "not JSON"), ('{"interactions": 5}', "no interactions list"), ("[1]", "no interactions list"), ('{"a": 1} and {"interactions": []}', "not JSON"), ('{"interactions": []} }', "not JSON"), (None, "no text"), ("", "not JSON"),
    ],
)
def test_repair(spark, text, outcome):
    df = spark.createDataFrame([(text,)], "raw_text string")
    assert responses.parse(df).first().parse_error == outcome


def test_shift_moves_numbers_only(spark):
    item = BASE | {"start_time_s": 1, "evidence_time_s": 2.0, "end_time_s": "3", "extra": {"start_time_s": 9}}
    df = spark.createDataFrame([(json.dumps({"interactions": [item, 7]}),)], "raw_text string")
    moved = responses.shift_times(responses.items(responses.parse(df)), F.lit(12.0))
    first, second = (json.loads(r.j) for r in moved.orderBy("position").select(F.to_json("item").alias("j")).collect())
    assert (first["start_time_s"], first["evidence_time_s"], first["end_time_s"], first["extra"], second) == (13.0, 14.0, "3", {"start_time_s": 9}, 7)


def test_verification_moves_labels_and_keeps_order(spark):
    rows = [("r", "c", 0, ["P5", "P1", "P1"], ["V2"], [], ["V8"], 17.5, 20.0)]
    schema = "run_id string, clip_id string, position long, person_ids array<string>, vehicle_ids array<string>, unverified_person_ids array<string>, unverified_vehicle_ids array<string>, start_time_s double, end_time_s double"
    times = spark.createDataFrame([("c", "P1", 18.0), ("c", "V2", 14.25), ("c", "V2", 15.6), ("d", "P5", 18.0)], "clip_id string, label string, t_s double")
    r = verify.verify_labels(spark.createDataFrame(rows, schema), times, 0.5).first()
    assert (r.person_ids, r.unverified_person_ids, r.vehicle_ids, r.unverified_vehicle_ids) == (["P1", "P1"], ["P5"], [], ["V8", "V2"])


def test_a_run_from_answers_to_events(spark):
    clips = spark.createDataFrame([("c", 14.0)], "clip_id string, duration_s double")
    spans = [(0.0, 6.0), (4.0, 10.0), (8.0, 14.0)]
    local = lambda s, e: json.dumps({"interactions": [BASE | {"start_time_s": s, "evidence_time_s": (s + e) / 2, "end_time_s": e}, "odd"]})
    answers = {("c", 0.0): local(4.5, 5.5), ("c", 4.0): local(0.5, 3.0), ("c", 8.0): "!late"}
    run = find_interactions(clips, Replay(answers, tolerance_s=1.0, segment_local=True), "r", 6.0, 4.0)
    calls = {r.start_s: r for r in run.calls.collect()}
    assert sorted(calls) == [s for s, _ in spans] and "late" in calls[8.0].error and calls[0.0].error is None
    got = [(r.start_time_s, r.end_time_s, r.position) for r in run.sightings.orderBy("position").collect()]
    assert got == [(4.5, 5.5, 0), (4.5, 7.0, 1)] and run.malformed.count() == 2
    windows = run.calls.select("run_id", "clip_id", "window_index", "start_s", "end_s", "error")
    events, summary = events_of(run, None, windows)
    assert (events.count(), summary.first().line) == (1, "c: 2 record(s) -> 1 event(s)  [1 call(s) failed, 2 malformed -- clip not fully examined]")


def test_whole_clip_and_bad_settings(spark):
    clips = spark.createDataFrame([("c", 14.0)], "clip_id string, duration_s double")
    run = find_interactions(clips, Replay({("c", 0.0): json.dumps({"interactions": [BASE]})}), "r")
    assert (run.calls.count(), run.sightings.count()) == (1, 1)
    for bad in ((6.0, None), (-1.0, 1.0), (4.0, 6.0)):
        with pytest.raises(ValueError):
            find_interactions(clips, Replay({}), "r", *bad)


def test_schema_helpers():
    schema = {"properties": {"interactions": {"type": "array", "items": {"$ref": "#/$defs/I"}}}, "$defs": {"I": {"type": "object", "properties": {"start_time_s": {"type": "number"}, "what": {"type": "string"}}}}}
    assert json.loads(example_of(schema)) == {"interactions": [{"start_time_s": 0.0, "what": "..."}]}
    assert time_fields(schema) == ("interactions", ["start_time_s"])
    with pytest.raises(ValueError):
        time_fields({"properties": {}})
