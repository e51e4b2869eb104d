"""Merging sightings to events."""

import random

import pytest

from framewake.operators import closure, merge

SCHEMA = "run_id string, clip_id string, window_index int, position long, person_ids array<string>, vehicle_ids array<string>, person_description string, vehicle_description string, interaction string, start_time_s double, evidence_time_s double, end_time_s double, confidence double"


def sighting(position, window, start, end, people=("P1",), vehicles=("V1",), confidence=0.95, text="opens", evidence=None):
    return ("r", "c", window, position, list(people), list(vehicles), f"person {position}", f"vehicle {position}", text, start, (start + end) / 2 if evidence is None else evidence, end, confidence)


def events(spark, rows, band=merge.CONFIDENCE_BAND):
    windows = spark.createDataFrame([("r", "c", 0, 0.0, 6.0), ("r", "c", 1, 4.0, 10.0), ("r", "c", 2, 8.0, 14.0)], "run_id string, clip_id string, window_index int, start_s double, end_s double")
    return merge.merge_events(spark.createDataFrame(rows, SCHEMA), windows, band).orderBy("event_index").collect()


@pytest.mark.parametrize(
    ("one", "other", "count"),
    [
        ({}, {"people": ["P9", "P1"]}, 1),
        ({}, {"people": ["P2"]}, 2),
        ({}, {"vehicles": ["V2"]}, 2),
        ({"people": []}, {"people": []}, 2),
        ({"vehicles": []}, {}, 2),
        ({"start": 1.0, "end": 3.0}, {"start": 3.5, "end": 5.0}, 2),
        ({"start": 1.0, "end": 4.5}, {"start": 4.5, "end": 5.0}, 1),
    ],
)
def test_what_matches(spark, one, other, count):
    rows = [sighting(0, 0, **{"start": 1.0, "end": 5.0} | one), sighting(1, 1, **{"start": 4.5, "end": 8.0} | other)]
    assert len(events(spark, rows)) == count


def test_bridge_joins_three(spark):
    rows = [sighting(0, 0, 1.0, 3.0), sighting(1, 1, 2.5, 9.0), sighting(2, 2, 8.5, 11.0)]
    (event,) = events(spark, rows)
    assert (event.sightings, event.window_indexes) == (3, [0, 1, 2])


def test_contained_wins_within_the_band_and_spans_stand(spark):
    rows = [sighting(0, 0, 4.5, 6.0, confidence=0.95, text="cut"), sighting(1, 1, 4.5, 8.0, confidence=0.92, text="whole")]
    (event,) = events(spark, rows)
    assert (event.interaction, event.start_time_s, event.end_time_s, event.confidence) == ("whole", 4.5, 8.0, 0.92)


def test_a_vetoed_contained_record_still_stops_the_union(spark):
    rows = [sighting(0, 0, 4.5, 6.0, confidence=0.95, text="cut"), sighting(1, 1, 4.5, 8.0, confidence=0.35, text="whole", people=["P1", "P7"])]
    (event,) = events(spark, rows)
    assert (event.interaction, event.end_time_s, event.person_ids) == ("cut", 6.0, ["P1", "P7"])


def test_nothing_contained_unites(spark):
    rows = [sighting(0, 0, 3.0, 6.0, text="reaches", people=["P1", "P4", "P1"]), sighting(1, 1, 4.0, 10.0, text="loads", people=["P4", "P7"]), sighting(2, 2, 8.0, 14.0, text="reaches", people=["P7"])]
    (event,) = events(spark, rows)
    assert (event.interaction, event.start_time_s, event.end_time_s) == ("reaches | loads", 3.0, 14.0)
    assert event.person_ids == ["P1", "P4", "P7"]


def test_band(spark):
    rows = [sighting(0, 0, 4.5, 6.0, confidence=0.95, text="cut"), sighting(1, 1, 4.5, 8.0, confidence=0.5, text="whole")]
    assert events(spark, rows)[0].interaction == "cut"
    assert events(spark, rows, 0.5)[0].interaction == "whole"
    with pytest.raises(ValueError):
        events(spark, rows, -0.1)


def test_empty(spark):
    assert events(spark, []) == []


@pytest.mark.parametrize("most", [500_000, 16])
def test_closure_against_union_find(spark, monkeypatch, most):
    monkeypatch.setattr(closure, "EDGES_A_TASK", most)
    rng = random.Random(5)
    rows = []
    for k in range(160):
        start = rng.randrange(0, 120) / 2
        rows.append(sighting(k, rng.randrange(3), start, start + rng.randrange(0, 6) / 2, [f"P{rng.randrange(1, 5)}" for _ in range(rng.randrange(3))], [f"V{rng.randrange(1, 4)}" for _ in range(rng.randrange(3))]))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if set(a[4]) & set(b[4]) and set(a[5]) & set(b[5]) and a[9] <= b[11] and b[9] <= a[11]:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    got = {r.position: r.group for r in merge.group_sightings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: find(k) for k in range(len(rows))}


def test_integrity(spark):
    windows = spark.createDataFrame([("r", "c", 0, 0.0, 1.0), ("r", "c", 0, 0.0, 1.0)], "run_id string, clip_id string, window_index int, start_s double, end_s double")
    found = merge.integrity_faults(spark.createDataFrame([sighting(0, 7, 0.0, 1.0)], SCHEMA), windows).collect()
    assert {(r.window_index, r.fault) for r in found} == {(0, "duplicate"), (7, "missing")}


@pytest.mark.parametrize("fault", ["missing", "twice"])
def test_merging_refuses_faulty_windows(spark, fault):
    """A sighting whose window is missing would be lost, one whose window is listed twice would count twice."""
    own = spark.createDataFrame([sighting(k, k, 8.0 * k, 8.0 * k + 1) for k in range(2)], SCHEMA)
    spans = spark.createDataFrame([("r", "c", k, 8.0 * k, 8.0 * k + 8) for k in range(2)], "run_id string, clip_id string, window_index int, start_s double, end_s double")
    assert merge.merge_events(own, spans).count() == 2
    faulty = spans.where("window_index = 0") if fault == "missing" else spans.unionByName(spans.where("window_index = 1"))
    with pytest.raises(Exception, match="missing or listed twice"):
        merge.merge_events(own, faulty).collect()
