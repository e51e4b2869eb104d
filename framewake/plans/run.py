"""From clips to events, for a batch of clips at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import accounting, merge, responses, tracks, verify
from ..functions.text import PROMPT_VERSION, stated
from ..operators.windows import check_window_settings, make_windows
from ..sources.backend import Backend, ask, request
from ..storage import written


@dataclass
class Run:
    calls: DataFrame
    sightings: DataFrame
    malformed: DataFrame


def find_interactions(clips: DataFrame, backend: Backend, run_id: str, window_s: float | None = None, stride_s: float | None = None) -> Run:
    """Ask a backend about each window of each clip and read its answers. clips: (clip_id, duration_s).

    Calls are written before anything is derived from them: an answer is never asked for twice.
    """
    check_window_settings(window_s, stride_s)
    spans = make_windows(clips, window_s, stride_s).withColumn("run_id", F.lit(run_id))
    # The length that the prompt tells is the one that answers are held against.
    clips = clips.withColumn("duration_s", stated(F.col("duration_s")))
    calls = written(ask(request(spans, clips, backend.segment_local, window_s is not None), backend, window_s is not None), "calls")
    parsed = responses.parse(calls.join(clips.select("clip_id", "duration_s"), "clip_id"))
    calls = parsed.withColumn("error", F.coalesce("error", F.when(F.col("raw_text").isNotNull(), F.col("parse_error")))).select(*calls.columns)
    items = responses.items(parsed)
    if backend.segment_local:
        items = responses.shift_times(items, F.col("start_s"))
    accepted, malformed = responses.split_items(responses.validated(items, window_s is not None, backend.tolerance_s))
    return Run(calls, in_clip_order(accepted), malformed)


def in_clip_order(accepted: DataFrame) -> DataFrame:
    """Sightings with position: by start, end, then order of call and place in its answer."""
    from pyspark.sql.window import Window

    at = Window.partitionBy("run_id", "clip_id").orderBy("start_time_s", "end_time_s", "window_index", "position")
    return accepted.withColumn("position", F.row_number().over(at) - 1)


def events_of(run: Run, times: DataFrame | None, windows: DataFrame, tolerance_s: float = 0.0, confidence_band: float = merge.CONFIDENCE_BAND) -> tuple[DataFrame, DataFrame]:
    """(events, summary) of a run, its labels verified first if times are given."""
    sightings = run.sightings if times is None else verify.verify_labels(run.sightings, times, tolerance_s)
    events = written(merge.merge_events(sightings, windows, confidence_band), "events")
    return events, accounting.run_summary(sightings, events, run.calls, run.malformed)


def drawn_times(raw: DataFrame, clips: DataFrame) -> DataFrame:
    """Label times of raw detections."""
    return tracks.label_times(tracks.relabel(tracks.detections(raw)), clips)


def run_batch(clips: DataFrame, raw: DataFrame, backend: Backend, run_id: str, window: tuple[float, float] | None, path: str) -> tuple[DataFrame, int]:
    """(a result for each clip, exit code): ask, verify against raw detections, merge, and write calls, then events and a document per clip.

    clips: (clip_id, duration_s, fps, error); clips with an error are reported and not asked about.
    """
    from ..sources.sinks import event_documents, run_documents, write_documents, write_run

    good = clips.where("error IS NULL")
    run = find_interactions(good, backend, run_id, *(window or (None, None)))
    events, summary = events_of(run, drawn_times(raw, good), run.calls, backend.tolerance_s)
    config = getattr(backend, "config", dict)()
    write_documents(run_documents(run.calls, run.malformed, run_id, config, PROMPT_VERSION), f"{path}/records")
    write_run(run.calls, events, path)
    write_documents(event_documents(events, summary), f"{path}/documents")
    status = accounting.run_status(run.calls).select("clip_id", F.col("error").alias("run_error"))
    people = tracks.identity_counts(tracks.detections(raw))
    results = clips.select("clip_id", "error").join(status, "clip_id", "left").join(people, "clip_id", "left").join(summary.drop("run_id"), "clip_id", "left")
    return results, accounting.batch_outcome(results).first().exit_code
