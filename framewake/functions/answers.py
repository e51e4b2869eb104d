"""JSON answers of a model: repair, and values whose types matter.

Values are Variants. SQL null is a missing field, a variant null is JSON's; a
number is never a boolean or a string that looks like one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unfenced(text: Column) -> Column:
    """What a Markdown code fence around the whole text holds; null without one."""
    pattern = r"(?is)^\s*```(?:json)?\s*(.*?)\s*```\s*$"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def braced(text: Column) -> Column:
    """From the first opening to the last closing brace; null without such."""
    first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when((first > 0) & F.contains(text, F.lit("}")) & (last > first), F.substring(text, first, last - first + 1))


def values(text: Column) -> Column:
    """The values of a text read as an array's members: one if all of the text is one JSON value, which the parser alone would also find where something follows it. Null if that is no JSON."""
    return F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")


def is_single(members: Column) -> Column:
    return F.coalesce(F.size(members) == 1, F.lit(False))


def cut(text: Column) -> Column:
    """The first of a text's unfenced and its braced part that is JSON; null if neither is. The second is looked at only if the first is none."""
    return F.coalesce(*(F.when(is_single(values(part)), part) for part in (unfenced(text), braced(text))))


def kind(value: Column) -> Column:
    """missing, void (JSON's null), number, string, boolean, array or object."""
    # Types are told apart by their first two letters.
    names = {"BIGINT": "number", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number", "STRING": "string", "BOOLEAN": "boolean", "VOID": "void", "ARRAY": "array", "OBJECT": "object"}
    known = F.create_map(*(F.lit(x) for name, plain in names.items() for x in (name[:2], plain)))
    return F.coalesce(F.element_at(known, F.substring(F.schema_of_variant(value), 1, 2)), F.lit("missing"))


def field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")
