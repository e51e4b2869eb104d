"""Usage, cost, failures and summaries of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import exact_round
from ..functions.text import merge_summary


def usage_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls with billable_output_tokens and estimated_cost_usd. calls: model_id and input, output, thought tokens (null counts as 0); prices: a row per model, in dollars per million.

    A model without a price fails the job, as a cost left out would look like none; unpriced_models() lists them.
    Prices are broadcast: a list of models is short, and dealt by model all calls would meet in a task for each model.
    """
    tokens = {c: F.coalesce(c, F.lit(0)).cast("double") for c in ("total_input_tokens", "total_output_tokens", "total_thought_tokens")}
    out = calls.withColumns(tokens).withColumn("billable_output_tokens", F.col("total_output_tokens") + F.col("total_thought_tokens"))
    cost = F.col("total_input_tokens") / 1e6 * F.col("usd_per_m_in") + F.col("billable_output_tokens") / 1e6 * F.col("usd_per_m_out")
    unknown = F.raise_error(F.concat(F.lit("no price is known for "), F.coalesce("model_id", F.lit("null")))).cast("double")
    priced = out.join(F.broadcast(prices), "model_id", "left").withColumn("__cost", F.when(cost.isNull(), unknown).otherwise(cost))
    return priced.withColumn("estimated_cost_usd", exact_round(F.col("__cost"), 6)).drop("usd_per_m_in", "usd_per_m_out", "__cost")


def unpriced_models(calls: DataFrame, prices: DataFrame) -> DataFrame:
    return calls.select("model_id").distinct().join(prices, "model_id", "left_anti")


def usage_sum(calls: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """(keys, usage_key, total): usage maps of all calls added key by key."""
    each = calls.select(*keys, F.explode("usage").alias("usage_key", "value"))
    return each.groupBy(*keys, "usage_key").agg(F.sum("value").alias("total"))


def usage_map(calls: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """The same as one map per run, its keys in order."""
    entries = F.array_sort(F.collect_list(F.struct("usage_key", "total")))
    return usage_sum(calls, keys).groupBy(*keys).agg(F.map_from_entries(entries).alias("usage"))


def run_status(calls: DataFrame) -> DataFrame:
    """(run_id, clip_id, calls, failed_windows, error): a run fails only where all its calls do."""
    failed = F.count_if(F.col("error").isNotNull())
    out = calls.groupBy("run_id", "clip_id").agg(F.count("*").alias("calls"), failed.alias("failed_windows"))
    return out.withColumn("error", F.when(F.col("failed_windows") == F.col("calls"), F.format_string("all %d call(s) failed", "calls")))


def run_summary(sightings: DataFrame, events: DataFrame, calls: DataFrame, malformed: DataFrame) -> DataFrame:
    """(run_id, clip_id, four counts, line), a row for each run that has calls."""
    keys = ["run_id", "clip_id"]
    n = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    out = run_status(calls).select(*keys, "failed_windows")
    for df, name in ((sightings, "source_interaction_count"), (events, "merged_interaction_count"), (malformed, "malformed_count")):
        out = out.join(n(df, name), keys, "left").fillna(0, [name])
    return out.withColumn("line", merge_summary(F.col("clip_id"), F.col("source_interaction_count"), F.col("merged_interaction_count"), F.col("failed_windows"), F.col("malformed_count")))


def report_rollup(sightings: DataFrame) -> DataFrame:
    """(clip_id, records, unlabelled, people_claims, vehicle_claims), a row per clip and one for all with a null clip."""
    bare = (F.size("person_ids") == 0) | (F.size("vehicle_ids") == 0)
    return sightings.rollup("clip_id").agg(
        F.count("*").alias("records"), F.count_if(bare).alias("unlabelled"), F.sum(F.size("person_ids")).alias("people_claims"), F.sum(F.size("vehicle_ids")).alias("vehicle_claims")
    )


def surest(sightings: DataFrame) -> DataFrame:
    """(run_id, clip_id, position, evidence_time_s, confidence) of each run's surest sighting, the first of several."""
    best = F.max_by(F.struct("position", "evidence_time_s", "confidence"), F.struct("confidence", -F.col("position")))
    return sightings.groupBy("run_id", "clip_id").agg(best.alias("b")).select("run_id", "clip_id", "b.*")


def compare_modes(whole: DataFrame, windowed: DataFrame) -> DataFrame:
    """(clip_id, whole_records, windowed_records, difference) of clips that both have."""
    n = lambda df, name: df.groupBy("clip_id").agg(F.count("*").alias(name))
    return n(whole, "whole_records").join(n(windowed, "windowed_records"), "clip_id").withColumn("difference", F.col("windowed_records") - F.col("whole_records"))


def batch_outcome(clips: DataFrame) -> DataFrame:
    """(clips, answered, failed, exit_code) of clip results with error and run_error."""
    failed = F.count_if(F.col("error").isNotNull() | F.col("run_error").isNotNull())
    return clips.agg(F.count("*").alias("clips"), (F.count("*") - failed).alias("answered"), failed.alias("failed"), F.when(failed > 0, 1).otherwise(0).alias("exit_code"))
