"""Models that answer questions about windows of clips, behind one interface.

A backend says how far off its times may be, whether it sees a window as a clip
of its own, and answers a request. Failures are data: a call that raises keeps its
text, if it got one, and a column error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.text import prompt
from pyspark.sql import functions as F

ANSWER = "run_id string, clip_id string, window_index int, start_s double, end_s double, prompt string, raw_text string, usage map<string,double>, error string"


@dataclass
class Answer:
    text: str
    usage: Mapping[str, float] = field(default_factory=dict)


class Backend(Protocol):
    tolerance_s: float
    segment_local: bool

    def generate(self, clip_id: str, prompt: str, window: tuple[float, float] | None) -> Answer: ...


@dataclass
class Replay:
    """Answers from a mapping of (clip_id, window_index or start) to text or an exception's message with a leading '!'."""

    answers: Mapping[tuple[str, float], str]
    tolerance_s: float = 0.0
    segment_local: bool = False

    def generate(self, clip_id: str, prompt: str, window: tuple[float, float] | None) -> Answer:
        text = self.answers[clip_id, window[0] if window else 0.0]
        if text.startswith("!"):
            raise RuntimeError(text[1:])
        return Answer(text, {"total_input_tokens": float(len(prompt)), "total_output_tokens": float(len(text))})


def request(windows: DataFrame, clips: DataFrame, segment_local: bool, windowed: bool = True) -> DataFrame:
    """windows with duration_s and prompt; a backend that sees only the segment is told the segment's length, one that is asked about whole clips no window."""
    both = windows.join(clips.select("clip_id", "duration_s"), "clip_id")
    if segment_local or not windowed:
        return both.withColumn("prompt", prompt(F.col("clip_id"), F.col("end_s") - F.col("start_s") if segment_local else F.col("duration_s")))
    return both.withColumn("prompt", prompt(F.col("clip_id"), F.col("duration_s"), F.col("start_s"), F.col("end_s")))


def ask(requests: DataFrame, backend: Backend, windowed: bool = True) -> DataFrame:
    """Calls: one answer for each request (run_id, clip_id, window_index, start_s, end_s, prompt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema(
            [("run_id", pa.string()), ("clip_id", pa.string()), ("window_index", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]
            + [("prompt", pa.string()), ("raw_text", pa.string()), ("usage", pa.map_(pa.string(), pa.float64())), ("error", pa.string())]
        )
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    text, usage, error = None, {}, None
                    try:
                        a = backend.generate(r["clip_id"], r["prompt"], (r["start_s"], r["end_s"]) if windowed else None)
                        text, usage = a.text, dict(a.usage)
                    except Exception as e:  # a call's failure is data
                        error = f"{type(e).__name__}: {e}"
                    rows.append({**r, "raw_text": text, "usage": list(usage.items()), "error": error})
                yield pa.RecordBatch.from_pylist(rows, schema=shape)
        finally:
            # Whatever a backend has open, such as uploads, ends with the task.
            getattr(backend, "close", lambda: None)()

    return requests.select("run_id", "clip_id", F.col("window_index").cast("int").alias("window_index"), "start_s", "end_s", "prompt").mapInArrow(run, ANSWER)


def example_of(schema: Mapping) -> str:
    """An example of what a JSON schema with one list of objects describes: far fewer tokens than the schema."""
    holders = {"string": "...", "number": 0.0, "integer": 0, "boolean": False}

    def of(node: Mapping):
        if "$ref" in node:
            return of(schema.get("$defs", {})[node["$ref"].rpartition("/")[2]])
        if node.get("type") == "array":
            return [of(node.get("items", {}))]
        if node.get("type") == "object" or "properties" in node:
            return {k: of(v) for k, v in node.get("properties", {}).items()}
        return holders.get(node.get("type", ""), None)

    return json.dumps(of(schema))


def time_fields(schema: Mapping) -> tuple[str, list[str]]:
    """The list's name and its items' numeric fields that end in _time_s; raises where there are none, before anything is spent."""
    for name, node in schema.get("properties", {}).items():
        if node.get("type") == "array":
            item = node.get("items", {})
            item = schema.get("$defs", {})[item["$ref"].rpartition("/")[2]] if "$ref" in item else item
            fields = [k for k, v in item.get("properties", {}).items() if k.endswith("_time_s") and v.get("type") in ("number", "integer")]
            if fields:
                return name, fields
    raise ValueError("the schema has no list with time fields")
