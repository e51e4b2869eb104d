"""The driver's events as clips, detections, windows, calls, sightings and answers.

There is no video in the test tables, so a day is a clip, a tick of `tick_us`
microseconds a tenth of a second, and everything else follows by whole-number
arithmetic, once as SQL for both engines: {US}, {A}, {Z} and {E} stand for what they
spell differently (microseconds since 2024, an array's brackets, an empty one).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.windows import make_windows

#: Ten seconds of a day make a tenth of a second of a clip.
TICK_US = 10_000_000
_SPARK = {"US": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)", "A": "array(", "Z": ")", "E": "CAST(array() AS ARRAY<STRING>)", "DAY": "DATE_ADD(DATE'2024-01-01', CAST(clip AS INT))"}
_DUCK = {"US": "(epoch_us(ts) - 1704067200000000)", "A": "[", "Z": "]", "E": "CAST([] AS VARCHAR[])", "DAY": "(DATE '2024-01-01' + CAST(clip AS INTEGER))"}

# In order: each may use those before it.
TABLES = {
    "ev": """
SELECT event_id, user_id, event_type, value, CAST(floor({US} / 86400000000) AS BIGINT) AS clip, CAST(floor(({US} % 86400000000) / {TICK}) AS BIGINT) AS t
FROM events WHERE ts IS NOT NULL""",
    "clips": """
SELECT concat('clip', clip) AS clip_id, clip, (8640 - (clip % 5) * 3) / 10.0D + (clip % 7) * 0.0137D AS duration_s,
  CASE clip % 3 WHEN 0 THEN '30000/1001' WHEN 1 THEN '25/1' ELSE '6/1' END AS fps,
  CASE clip % 4 WHEN 0 THEN 3840 WHEN 1 THEN 1920 WHEN 2 THEN 1280 ELSE 352 END AS width,
  CASE clip % 4 WHEN 0 THEN 2160 WHEN 1 THEN 1080 WHEN 2 THEN 720 ELSE 288 END AS height,
  CASE clip % 2 WHEN 0 THEN 'models/yolo 26x.pt' ELSE 'yolo26s.pt' END AS weights, 'tracktrack.yaml' AS tracker,
  CASE clip % 3 WHEN 0 THEN 'none' ELSE 'a/yolo26x-reid.onnx' END AS reid, CASE clip % 2 WHEN 0 THEN 3.0D ELSE 2.5D END AS buffer_seconds
FROM (SELECT DISTINCT clip FROM ev) c""",
    "raw_detections": """
SELECT concat('clip', clip) AS clip_id, CAST(floor(t / 4) AS BIGINT) AS frame_index, event_id AS box_position,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE user_id % 11 + 1 END AS track_id,
  CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 2 WHEN 'signup' THEN 7 WHEN 'purchase' THEN 0 ELSE 1 END AS class_id,
  (event_id % 1000) / 1000.0D AS confidence,
  (event_id * 37 % 340) + 0.5D * (event_id % 3) - 8 AS x1, (event_id * 53 % 280) + 0.25D * (event_id % 5) - 6 AS y1,
  (event_id * 37 % 340) + 12.0D + event_id % 90 AS x2, (event_id * 53 % 280) + 10.5D + event_id % 70 AS y2
FROM ev""",
    "sightings": """
SELECT 'run1' AS run_id, clip_id, window_index, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY start_time_s, end_time_s, window_index, event_id) - 1 AS BIGINT) AS position, event_id,
  person_ids, vehicle_ids, person_description, vehicle_description, interaction, start_time_s, evidence_time_s, end_time_s, confidence, {E} AS unverified_person_ids, {E} AS unverified_vehicle_ids
FROM (SELECT concat('clip', clip) AS clip_id, CAST(least(floor(t / 40), 212) AS INT) AS window_index, event_id,
  CASE WHEN event_id % 11 = 0 THEN {E} WHEN event_id % 5 = 0 THEN {A}concat('P', user_id % 7 + 1), concat('P', event_id % 3 + 1){Z} ELSE {A}concat('P', user_id % 7 + 1){Z} END AS person_ids,
  CASE WHEN event_id % 13 = 0 THEN {E} ELSE {A}concat('V', event_id % 3 + 1){Z} END AS vehicle_ids,
  concat('person ', event_id % 5) AS person_description, concat('vehicle ', event_id % 4) AS vehicle_description,
  CASE event_id % 4 WHEN 0 THEN 'opens a door' WHEN 1 THEN 'loads' WHEN 2 THEN 'gets in' ELSE 'walks past' END AS interaction,
  t / 10.0D AS start_time_s, (t + floor(floor(value) / 2)) / 10.0D AS evidence_time_s, (t + floor(value)) / 10.0D AS end_time_s, (event_id % 100) / 100.0D AS confidence
FROM ev) s""",
    "responses": """
SELECT 'run1' AS run_id, concat('clip', clip) AS clip_id, event_id, CAST(t AS DOUBLE) AS start_s, CAST(t + 400 AS DOUBLE) AS end_s, 8640.0D AS duration_s,
  CASE event_id % 16 WHEN 0 THEN concat('```json\\n', body, '\\n```') WHEN 1 THEN concat('Here it is: ', body, ' Done.') WHEN 2 THEN concat(body, ' }}') WHEN 3 THEN 'no json at all'
    WHEN 4 THEN '{{"interactions": 5}}' WHEN 5 THEN NULL WHEN 6 THEN concat('```\\n', body, '\\n```') WHEN 7 THEN '[1, 2]' ELSE body END AS raw_text
FROM (SELECT event_id, clip, t, concat('{{"interactions": [{{"person_ids": ', CASE event_id % 19 WHEN 0 THEN '"P1"' WHEN 1 THEN '["P0", 3]' WHEN 2 THEN '["P1", "P1"]' ELSE '["P2"]' END,
    ', "vehicle_ids": ["V', event_id % 4, '"], "person_description": ', CASE WHEN event_id % 23 = 0 THEN '7' ELSE '"a person"' END, CASE WHEN event_id % 29 = 0 THEN '' ELSE ', "vehicle_description": "a car"' END,
    ', "interaction": "opens", "start_time_s": ', CASE WHEN event_id % 31 = 0 THEN concat('"', t, '"') WHEN event_id % 37 = 0 THEN 'true' ELSE concat(t, '') END,
    ', "evidence_time_s": ', t + CASE WHEN event_id % 7 = 0 THEN 600 ELSE 1 END, ', "end_time_s": ', CASE WHEN event_id % 41 = 0 THEN 900000 WHEN event_id % 10 = 0 THEN t - 1 ELSE t + 10 END,
    ', "confidence": ', CASE WHEN event_id % 43 = 0 THEN '1.5' ELSE concat('0.', event_id % 9 + 1) END, '}}, ', CASE WHEN event_id % 3 = 0 THEN '"odd"' ELSE 'null' END, ']}}') AS body FROM ev) b""",
    "calls": """
SELECT 'run1' AS run_id, concat('clip', l_orderkey % 30) AS clip_id, l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN 'gemini-3.8-flash' ELSE 'org/local-27b' END AS model_id,
  l_partkey % 5000 AS total_input_tokens, CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE l_suppkey % 700 END AS total_output_tokens, l_orderkey % 300 AS total_thought_tokens,
  CASE WHEN l_orderkey % 30 = 7 OR l_orderkey % 9 = 0 THEN 'TimeoutError: late' ELSE NULL END AS error
FROM lineitem""",
}


def _text(dialect: dict, tick_us: int, table: str) -> str:
    out = TABLES[table].format(**dialect, TICK=tick_us)
    return out if dialect is _SPARK else re.sub(r"\b(\d+(?:\.\d+)?)D\b", r"CAST(\1 AS DOUBLE)", out).replace("\\n", "' || chr(10) || '")


def duck_cte(*tables: str, tick_us: int = TICK_US) -> str:
    """The definitions, for DuckDB, of these tables and of all before them in TABLES that they need; windows are numbered tenths, the regular ones and the last."""
    names = [t for t in TABLES if t in tables or t == "ev" or (t == "clips" and "windows" in tables)]
    parts = [f"{t} AS ({_text(_DUCK, tick_us, t)})" for t in names]
    if "windows" in tables:
        parts.append("""windows AS (SELECT 'run1' AS run_id, clip_id, CAST(k AS INTEGER) AS window_index, s / CAST(10 AS DOUBLE) AS start_s, e / CAST(10 AS DOUBLE) AS end_s, CASE WHEN k % 13 = 5 OR clip % 9 = 4 AND k % 2 = 0 THEN 'TimeoutError: late' END AS error FROM (
  SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY s) - 1 AS k FROM (
    SELECT clip_id, clip, 40 * k AS s, 40 * k + 80 AS e FROM clips, range(0, 300) r(k) WHERE 4 * k + 8 < duration_s
    UNION SELECT clip_id, clip, CAST(round_even((duration_s - 8) * 10, 0) AS BIGINT), CAST(round_even(duration_s * 10, 0) AS BIGINT) FROM clips)))""")
    return "WITH RECURSIVE " + ",\n".join(parts)


class Bridge:
    """The tables as DataFrames over an input folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, tick_us: int = TICK_US):
        self.spark, self.dir, self.tick = spark, sf_dir, tick_us

    def table(self, name: str) -> DataFrame:
        source = "lineitem" if name == "calls" else "events" if name == "ev" else "ev"
        base = self.spark.read.parquet(f"{self.dir}/{source}.parquet") if source != "ev" else self.table("ev")
        if name == "responses":
            base = self._dealt(base, "event_id", "t")
        return self.spark.sql(_inlined(name, self.tick, source), base=base)

    def _dealt(self, df: DataFrame, *by: str) -> DataFrame:
        """df over enough tasks for all cores: reading an answer takes far longer than reading its row, and a table may lie in few row groups. The number is given, as by size the tasks would be few again."""
        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 3 * self.spark.sparkContext.defaultParallelism)
        return df.repartition(n, *by)

    def windows(self) -> DataFrame:
        """Windows of 8 s every 4 s, some of whose calls failed."""
        from pyspark.sql import functions as F

        clip = F.substring("clip_id", 5, 10).cast("int")
        bad = (F.col("window_index") % 13 == 5) | ((clip % 9 == 4) & (F.col("window_index") % 2 == 0))
        return make_windows(self.table("clips"), 8.0, 4.0).withColumn("run_id", F.lit("run1")).withColumn("error", F.when(bad, "TimeoutError: late"))


def _inlined(name: str, tick_us: int, source: str) -> str:
    """The text with its source as a parameter of spark.sql()."""
    text = _text(_SPARK, tick_us, name)
    return text.replace("{", "{{").replace("}", "}}").replace(f"FROM {source}", "FROM {base}")
