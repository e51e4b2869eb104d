"""Track labels such as P3 and V12."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes of the detector that count, with their category, and the categories' initials.
CLASSES = ((0, "person", "person"), (2, "car", "vehicle"), (3, "motorcycle", "vehicle"), (5, "bus", "vehicle"), (7, "truck", "vehicle"))
INITIALS = {"person": "P", "vehicle": "V"}


def label_text(category: Column, number: Column) -> Column:
    return F.concat(F.when(category == "person", INITIALS["person"]).otherwise(INITIALS["vehicle"]), number.cast("string"))


def is_label(label: Column, initial: str) -> Column:
    """The initial and a number that begins with 1 to 9; as ever with $, one closing line break is let pass."""
    return F.coalesce(label.rlike(f"^{initial}[1-9][0-9]*$"), F.lit(False))


def bad_labels(labels: Column, initial: str) -> Column:
    """The elements that aren't labels, with their places."""
    at = F.transform(labels, lambda x, i: F.struct(i.alias("position"), x.alias("label")))
    return F.filter(at, lambda e: ~is_label(e["label"], initial))


def ordered_union(lists: Column) -> Column:
    """Elements of lists of lists, first occurrence kept."""
    return F.array_distinct(F.flatten(lists))


def ids_text(labels: Column) -> Column:
    return F.when(F.size(labels) > 0, F.array_join(labels, ",")).otherwise("no id")
