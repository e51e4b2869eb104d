"""Events and runs as files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_documents(events: DataFrame, summary: DataFrame) -> DataFrame:
    """(run_id, clip_id, document): one JSON document per run, its events in order and its counters. A run's events are what one clip holds."""
    keys = ["run_id", "clip_id"]
    cols = [c for c in events.columns if c not in (*keys, "group")]
    packed = events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("event_index", *(c for c in cols if c != "event_index")))).alias("interactions"))
    counters = [c for c in summary.columns if c not in (*keys, "line")]
    whole = summary.join(packed, keys, "left")
    return whole.select(*keys, F.to_json(F.struct("clip_id", "run_id", *counters, "interactions")).alias("document"))


def run_documents(calls: DataFrame, malformed: DataFrame, tag: str, config: dict, prompt_version: str) -> DataFrame:
    """(run_id, clip_id, document): a run's record under its tag: with what it was asked, what came back and what was refused, before anything is derived."""
    keys = ["run_id", "clip_id"]
    asked = F.struct("window_index", "start_s", "end_s", "prompt", "raw_text", "usage", "error")
    refused = F.struct("window_index", "position", "errors", "raw")
    whole = calls.groupBy(*keys).agg(F.array_sort(F.collect_list(asked), lambda a, b: a["window_index"] - b["window_index"]).alias("calls"), F.count_if(F.col("error").isNotNull()).alias("failed_windows"))
    whole = whole.join(malformed.groupBy(*keys).agg(F.array_sort(F.collect_list(refused)).alias("malformed")), keys, "left")
    # What a run was set to is fixed for all of its clips.
    fixed = [F.lit(tag).alias("run_tag"), F.lit(prompt_version).alias("prompt_version"), F.lit(json.dumps(config, sort_keys=True)).alias("config")]
    return whole.select(*keys, F.to_json(F.struct("clip_id", "run_id", *fixed, "failed_windows", "calls", "malformed")).alias("document"))


def write_documents(documents: DataFrame, path: str) -> None:
    """A folder per clip; only clips that are written are replaced."""
    documents.select("clip_id", F.col("document").alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("clip_id").text(path)


def write_run(calls: DataFrame, events: DataFrame, path: str) -> None:
    """The calls as they came first, then what is derived from them."""
    calls.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/calls")
    events.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/events")
