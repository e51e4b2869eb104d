"""File name parts, tags, prompts and report lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import INITIALS
from .numbers import compact_number, exact_round

PROMPT_VERSION = "a3"


def stem(path: Column) -> Column:
    """The last component without its last extension; a name that only begins with a dot keeps it."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def slug_part(value: Column) -> Column:
    return F.regexp_replace(stem(value), r"[^A-Za-z0-9._-]", "-")


def tracking_slug(weights: Column, tracker: Column, reid: Column, imgsz: Column, buffer_seconds: Column) -> Column:
    return F.concat(slug_part(weights), F.lit("__"), slug_part(tracker), F.lit("__reid-"), slug_part(reid), F.lit("__imgsz"), imgsz.cast("string"), F.lit("__buf"), compact_number(buffer_seconds))


def backend_slug(kind: Column, model_id: Column) -> Column:
    """A hosted model without its family's prefix, a local one by the last part of its path."""
    return F.when(kind == "hosted", F.regexp_replace(model_id, "gemini-", "")).otherwise(F.element_at(F.split(model_id, "/"), -1))


def run_slug(backend: Column, window_s: Column, stride_s: Column, version: str = PROMPT_VERSION) -> Column:
    windowing = F.when(window_s.isNotNull(), F.concat(F.lit("__w"), compact_number(window_s), F.lit("s"), compact_number(stride_s))).otherwise("")
    return F.concat(backend, windowing, F.lit(f"__{version}"))


def run_tag(backend: Column, window_s: Column, stride_s: Column, started_at: Column, version: str = PROMPT_VERSION) -> Column:
    """The slug and, to the millisecond, when the run began; without a start the slug alone."""
    slug = run_slug(backend, window_s, stride_s, version)
    return F.when(started_at.isNull(), slug).otherwise(F.concat(slug, F.lit("__"), F.date_format(started_at, "yyyyMMdd-HHmmss-SSS")))


#: What every prompt ends with; {end} is the clip's stated length.
_TASK = (
    " Boxes found by a detector carry labels at their corners: {person}1, {person}2 and so on for people, {vehicle}1, {vehicle}2 and so on for vehicles of any kind; equal numbers mean nothing across the two."
    " These labels are a help and not the truth: objects may go without one, lose it for a while, or get another."
    " List every moment in which a person enters, leaves, opens, loads or otherwise handles a vehicle, labelled or not; passing by is none."
    " Give person_ids and vehicle_ids as read from frames of the moment, in order of appearance, and [] where none was shown; never make one up."
    " Give person_description, vehicle_description and interaction as text, and confidence from 0 to 1, below 0.5 where in doubt."
    " Give start_time_s, evidence_time_s and end_time_s in seconds with decimals, so that 0 <= start_time_s <= evidence_time_s <= end_time_s <= "
)
_FORM = '. Answer with JSON alone: {"interactions": [...]}, the list empty if there is none.'


def stated(seconds: Column) -> Column:
    """Seconds as a prompt states them and answers are held against them: one decimal."""
    return exact_round(seconds, 1)


def prompt(clip_id: Column, duration_s: Column, start_s: Column | None = None, end_s: Column | None = None) -> Column:
    """What a model is asked about a clip or one of its windows; times have one decimal, those of answers run on the clip's own clock."""
    tenth = lambda x: F.format_string("%.1f", stated(x))
    scope = F.concat(F.lit("Clip "), clip_id, F.lit(" lasts "), tenth(duration_s), F.lit(" s."))
    if start_s is not None:
        seen = F.concat(F.lit(" You see "), tenth(start_s), F.lit(" s to "), tenth(end_s), F.lit(" s of it; times count from the beginning of the whole clip, so what you see first is at "), tenth(start_s), F.lit("."))
        scope = F.concat(scope, F.when(start_s.isNull(), "").otherwise(seen))
    return F.concat(scope, F.lit(_TASK.format(**INITIALS)), tenth(duration_s), F.lit(_FORM))


def iso_time(at: Column) -> Column:
    """A moment in UTC to the millisecond, as ISO 8601 has it."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'")


def merge_summary(clip_id: Column, source: Column, merged: Column, failed: Column, malformed: Column) -> Column:
    line = F.format_string("%s: %d record(s) -> %d event(s)", clip_id, source, merged)
    warn = F.format_string("  [%d call(s) failed, %d malformed -- clip not fully examined]", failed, malformed)
    return F.concat(line, F.when((failed > 0) | (malformed > 0), warn).otherwise(""))


def shortened(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def unverified_summary(labels: Column, records: Column) -> Column:
    """What the clip didn't support; null if nothing. labels: array<struct<label, times>> in order; records: how many it concerns."""
    total = F.aggregate(labels, F.lit(0).cast("long"), lambda a, x: a + x["times"])
    each = F.array_join(F.transform(labels, lambda x: F.concat(x["label"], F.lit(" x"), x["times"].cast("string"))), ", ")
    return F.when(F.size(labels) > 0, F.concat(total.cast("string"), F.lit(" unsupported label(s) in "), records.cast("string"), F.lit(" record(s): "), each))
