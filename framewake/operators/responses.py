"""Answers to sightings: repair, parse, validate, split into accepted and malformed, shift.

Schemas guarantee types, not sense, and some models guarantee neither: an
answer's items are Variants until every field has shown its type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import cut, field, is_single, kind, values
from ..functions.labels import INITIALS, is_label

TIMES = ("start_time_s", "evidence_time_s", "end_time_s")
STRINGS = ("person_description", "vehicle_description", "interaction")
IDS = {"person_ids": INITIALS["person"], "vehicle_ids": INITIALS["vehicle"]}
REQUIRED = (*IDS, *STRINGS, *TIMES, "confidence")


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once: what a generator gives isn't repeated in every expression and filter above."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def parse(responses: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """responses with the repaired text, payload, and parse_error: null, no text, not JSON, or no interactions list."""
    text = F.col(text_col)
    # Most answers are JSON as they come: parts are cut and read only where one isn't.
    out = settled(responses, __own=values(text))
    own = is_single(F.col("__own"))
    out = settled(out, __cut=F.when(~own, cut(text)))
    out = settled(out, repaired_text=F.coalesce("__cut", text), payload=F.when(own, F.get("__own", F.lit(0))).otherwise(F.try_parse_json("__cut"))).drop("__own", "__cut")
    listed = F.try_variant_get("payload", "$.interactions", "array<variant>")
    error = F.when(text.isNull(), "no text").when(F.col("payload").isNull(), "not JSON").when(listed.isNull(), "no interactions list")
    return settled(out, parse_error=error)


def items(answers: DataFrame) -> DataFrame:
    """A row for each reported item, with its position, the item as a Variant and its JSON as it came but for number formats."""
    # The answer is split once; its JSON for an item is the item's share of that.
    good = answers.where("parse_error IS NULL").withColumn("__texts", F.from_json("repaired_text", "interactions array<string>")["interactions"])
    each = F.posexplode(F.arrays_zip(F.try_variant_get(F.col("payload"), "$.interactions", "array<variant>").alias("item"), F.col("__texts").alias("raw")))
    return good.select("*", each.alias("position", "__item")).select(*answers.columns, "position", "__item.item", "__item.raw")


def _not_label(initial: str):
    return lambda x: ~((kind(x) == "string") & is_label(F.try_variant_get(x, "$", "string"), initial))


def with_numbers(items: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """items with n_<name>: fields that are numbers, as doubles; null for any other."""
    out = settled(items, **{f"f_{n}": field(F.col("item"), n) for n in names})
    out = settled(out, **{f"k_{n}": kind(F.col(f"f_{n}")) for n in names})
    return settled(out, **{f"n_{n}": F.when(F.col(f"k_{n}") == "number", F.try_variant_get(F.col(f"f_{n}"), "$", "double")) for n in names}).drop(*(f"{x}_{n}" for n in names for x in "fk"))


def validated(items: DataFrame, window: bool = False, tolerance_s: float = 0.0) -> DataFrame:
    """items with errors, every rule that an item breaks, and n_<name> of its numbers.

    items: item, duration_s and, if the window counts, start_s and end_s. Ranges are
    looked at only where all types are right.
    """
    c = F.col
    out = settled(items, __kind=kind(c("item")), **{f"f_{n}": field(c("item"), n) for n in REQUIRED})
    out = settled(out, **{f"k_{n}": kind(c(f"f_{n}")) for n in REQUIRED})
    out = settled(out, **{f"n_{n}": F.when(c(f"k_{n}") == "number", F.try_variant_get(c(f"f_{n}"), "$", "double")) for n in (*TIMES, "confidence")})
    there = lambda n, want: (c(f"k_{n}") != "missing") & (c(f"k_{n}") != want)
    typed = [F.when(c(f"k_{n}") == "missing", f"missing:{n}") for n in REQUIRED]
    typed += [F.when(there(n, "number"), f"not_number:{n}") for n in (*TIMES, "confidence")]
    typed += [F.when(there(n, "string"), f"not_string:{n}") for n in STRINGS]
    for n, initial in IDS.items():
        labels = F.try_variant_get(c(f"f_{n}"), "$", "array<variant>")
        typed.append(F.when(there(n, "array"), f"not_list:{n}").when((c(f"k_{n}") == "array") & F.exists(labels, _not_label(initial)), f"bad_label:{n}"))
    start, evidence, end = (c(f"n_{n}") for n in TIMES)
    ranged = [F.when(~c(f"n_{n}").between(0.0, c("duration_s")), f"outside_clip:{n}") for n in TIMES]
    ranged.append(F.when(start > end, "reversed_span").when(~evidence.between(start, end), "evidence_outside_span"))
    ranged.append(F.when(~c("n_confidence").between(0.0, 1.0), "confidence_range"))
    if window:
        low, high = c("start_s") - tolerance_s, c("end_s") + tolerance_s
        ranged.append(F.when((end < low) | (start > high), "span_outside_window"))
        ranged.append(F.when(~evidence.between(low, high), "evidence_outside_window"))
    out = settled(out, __types=F.array_compact(F.array(*typed)))
    errors = F.when(c("__kind") != "object", F.array(F.lit("not_object"))).when(F.size("__types") > 0, c("__types")).otherwise(F.array_compact(F.array(*ranged)))
    return settled(out, errors=errors).drop("__kind", "__types", *(f"{x}_{n}" for n in REQUIRED for x in "fk"))


def record() -> list[Column]:
    """The fields of a valid item as typed columns, and its empty lists of unverified labels."""
    item = F.col("item")
    return [
        *(F.try_variant_get(item, f"$.{n}", "array<string>").alias(n) for n in IDS),
        *(F.try_variant_get(item, f"$.{n}", "string").alias(n) for n in STRINGS),
        *(F.col(f"n_{n}").alias(n) for n in (*TIMES, "confidence")),
        *(F.array().cast("array<string>").alias(f"unverified_{n}") for n in IDS),
    ]


def split_items(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, malformed) of items with a column errors. The window's own index stands, whatever an item says of it."""
    keys = [c for c in ("run_id", "clip_id", "window_index", "position") if c in checked.columns]
    accepted = checked.where(F.size("errors") == 0).select(*keys, *record())
    return accepted, checked.where(F.size("errors") > 0).select(*keys, "errors", "raw")


def shift_times(items: DataFrame, offset_s: Column) -> DataFrame:
    """items with each item's numeric times moved by an offset: from a segment's clock to the clip's. Nothing else changes, nothing is clipped, no item fails."""
    out = with_numbers(items, TIMES)
    fields = F.from_json("raw", "map<string,variant>")
    out = settled(out, __fields=F.when(kind(F.col("item")) == "object", fields), **{f"s_{n}": F.col(f"n_{n}") + offset_s for n in TIMES})
    moved = F.array(*(F.when(F.col(f"s_{n}").isNotNull(), F.struct(F.lit(n).alias("key"), F.to_variant_object(F.array(f"s_{n}")).alias("value"))) for n in TIMES))
    moved = F.transform(F.array_compact(moved), lambda e: F.struct(e["key"], F.try_variant_get(e["value"], "$[0]", "variant").alias("value")))
    others = F.filter(F.map_entries("__fields"), lambda e: ~F.exists(moved, lambda m: m["key"] == e["key"]))
    item = F.try_parse_json(F.to_json(F.map_from_entries(F.concat(others, moved))))
    out = settled(out, __moved=F.coalesce(F.when(F.col("__fields").isNotNull(), item), F.col("item")))
    return out.withColumn("item", F.col("__moved")).drop("__moved", "__fields", *(f"{x}_{n}" for n in TIMES for x in "sn"))
