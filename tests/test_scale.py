"""Steps whose work or memory must not grow faster than their input."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from framewake.operators import accounting, closure, merge, responses
from framewake.plans.bridge import Bridge

from .test_merge import SCHEMA, sighting


def odd_sightings(n, seed=3):
    """Nested, equal, empty, reversed and endless spans, of several people and vehicles, some of them listed twice."""
    rng = random.Random(seed)
    rows = []
    for k in rng.sample(range(n), n):
        start = rng.randrange(0, 400) / 10
        end = rng.choice([start, start + 0.1, start + rng.randrange(1, 30) / 10, start + rng.randrange(0, 300) / 10, start + 16.0, start - 2.0, None])
        row = list(sighting(k, 0, start, start, [f"P{rng.randrange(1, 5)}" for _ in range(rng.randrange(4))], [f"V{rng.randrange(1, 4)}" for _ in range(rng.randrange(4))]))
        row[11] = end
        rows.append(tuple(row))
    return rows


def test_pairs_against_all_comparisons(spark):
    rows = odd_sightings(250)
    want = []
    for a in rows:
        for b in rows:
            if a[3] < b[3] and None not in (a[11], b[11]) and a[9] <= b[11] and b[9] <= a[11] and set(a[4]) & set(b[4]) and set(a[5]) & set(b[5]):
                want.append((a[3], b[3]))
    got = [(r.left_position, r.right_position) for r in merge.same_event_pairs(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(want) > 500 and sorted(got) == sorted(want)


def test_pairs_of_a_long_island_meet_in_cells(spark):
    """Spans that touch the next one form one island, of which few meet: all of it against all of it would be quadratic, and a last distinct would deal out every pair again."""
    rows = [sighting(k, 0, float(k), k + 1.0) for k in range(3000)]
    found = merge.same_event_pairs(spark.createDataFrame(rows, SCHEMA))
    joined = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x and "position" in x]
    assert joined and all("cell" in x for x in joined)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]
    assert found.count() == 2999


def test_ties_are_of_islands_not_of_sightings(spark, monkeypatch):
    """However many sightings an island holds, none of them goes into the closure; those of two pairs tie two islands once."""
    given = []
    monkeypatch.setattr(merge, "components", lambda links: given.append(links.count()) or closure.components(links))
    rows = [sighting(k, 0, 0.0, 9.0, ["P1", "P2"] if k % 3 == 0 else [f"P{1 + k % 2}"]) for k in range(300)] + [sighting(300, 0, 0.0, 9.0, ["P3"])]
    got = {r.position: r.group for r in merge.group_sightings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert given[0] <= 1
    assert got == {k: 300 if k == 300 else 0 for k in range(301)}


def test_groups_of_odd_sightings_are_named_by_their_least_member(spark):
    """Positions in no order of time."""
    rows = [r for r in odd_sightings(200, 8) if r[11] is not None and r[11] >= r[9]]
    found = {r[3]: {r[3]} for r in rows}
    for a in rows:
        for b in rows:
            if a[9] <= b[11] and b[9] <= a[11] and set(a[4]) & set(b[4]) and set(a[5]) & set(b[5]) and found[a[3]] is not found[b[3]]:
                found[a[3]] |= found[b[3]]
                found.update({k: found[a[3]] for k in found[a[3]]})
    got = {r.position: r.group for r in merge.group_sightings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: min(own) for k, own in found.items()}


def _edges(nodes, u, v):
    kind = pa.struct([("clip", pa.string()), ("position", pa.int64())])
    told = lambda at: pa.array([nodes[k] for k in at], kind)
    return pa.RecordBatch.from_arrays([told(u), told(v)], names=["u", "v"])


def test_stars_of_structs_follow_spark_order():
    nodes = [{"clip": c, "position": p} for c in (None, "", "B", "a", "é", "😀") for p in (None, -1, 0, 7)]
    rng = random.Random(2)
    order = list(range(len(nodes)))
    u = [rng.choice(order) for _ in range(14)]
    v = [rng.choice(order) for _ in range(14)]
    label = closure.least_reachable(np.array(u), np.array(v), len(nodes))
    (got,) = closure._stars(iter([_edges(nodes, u, v)]), True)
    assert {(repr(r["u"]), repr(r["v"])) for r in got.to_pylist()} == {(repr(nodes[k]), repr(nodes[label[k]])) for k in {*u, *v}}


def test_stars_of_structs_take_no_object_a_node():
    n = 50_000
    nodes = [{"clip": f"clip{k % 30}", "position": k} for k in range(n)]
    batch = _edges(nodes, range(1, n), range(n - 1))
    tracemalloc.start()
    list(closure._stars(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 * n


def test_calls_are_not_dealt_by_model(spark):
    """Two models would be two tasks, however many calls there are."""
    prices = spark.createDataFrame([("a", 1.0, 2.0), ("b", 0.0, 0.0)], "model_id string, usd_per_m_in double, usd_per_m_out double")
    tokens = ("id AS total_input_tokens", "id AS total_output_tokens", "0 AS total_thought_tokens")
    priced = accounting.usage_cost(spark.range(0, 1000, 1, 4).selectExpr("IF(id % 3 = 0, 'a', 'b') AS model_id", *tokens), prices)
    plan = priced._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert priced.where("model_id = 'a'").count() == 334


def test_answers_are_dealt_over_all_cores(spark):
    """A table of one row group would be one task, in which all answers are read."""
    answers = Bridge(spark, "/root/testdata/sf0.001").table("responses")
    sizes = answers.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(r[1] for r in sizes) < answers.count() / 4


def test_odd_answers(spark):
    want = {
        '{"interactions": [1]}': None,
        '{"interactions": null}': "no interactions list",
        '{"interactions": "[1]"}': "no interactions list",
        '{"interactions": {"a": 1}}': "no interactions list",
        "null": "no interactions list",
        "": "not JSON",
        "{},": "no interactions list",
        '{"a": 1, "a": 2}': "not JSON",
        '```json\n{"interactions": []}\n```': None,
        'so {"interactions": []} it is': None,
        '{"interactions": []} {"interactions": []}': "not JSON",
    }
    got = responses.parse(spark.createDataFrame([(t,) for t in want], "raw_text string")).collect()
    assert {r.raw_text: r.parse_error for r in got} == want
