"""Backends over a hosted model's client or a local runtime, both handed in: nothing here needs a network or a GPU.

Clients and runtimes are opened on the first call, in the worker that makes it.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping
from contextlib import suppress
from dataclasses import dataclass, field
from typing import Any

import pandas as pd

from .backend import Answer, example_of, time_fields

#: Dollars per million tokens, in and out, of hosted models that are priced; what a client's counts are called.
PRICES = {"gemini-3.8-flash": (0.75, 3.75)}
_READ, _SAID, _THOUGHT, _ALL = "total_input_tokens", "total_output_tokens", "total_thought_tokens", "total_tokens"

#: What becomes of an upload by its state: it is used, asked about again, or given up for any other.
_READY, _PENDING = "ACTIVE", "PROCESSING"


def usage_of(counts: Mapping[str, float | None] | None, model_id: str) -> dict[str, float]:
    """A call's token counts, what of them is billed as output, and their price; empty without counts."""
    tokens = pd.Series(dict.fromkeys((_READ, _SAID, _THOUGHT, _ALL), 0.0) | {k: v or 0.0 for k, v in (counts or {}).items()}, dtype="float64")
    if counts is None:
        return {}
    billed = pd.Series({_READ: tokens[_READ], _SAID: tokens[[_SAID, _THOUGHT]].sum()})
    price = float((billed / 1e6 * PRICES[model_id]).sum())
    return tokens[[_READ, _SAID, _THOUGHT, _ALL]].to_dict() | {"billable_output_tokens": float(billed[_SAID]), "estimated_cost_usd": round(price, 6)}


def polled(first: Any, again: Callable[[Any], Any], waits: int, pause_s: float) -> Iterator[Any]:
    """A handle as it is at first and after each of so many pauses."""
    yield first
    for _ in range(waits):
        time.sleep(pause_s)
        first = again(first)
        yield first


class Uploads:
    """Handles of files, each put up on its first use. put(path) and get(name) give handles with name and state."""

    def __init__(self, put: Callable[[str], Any], get: Callable[[str], Any], delete: Callable[[str], None], timeout_s: float = 180.0, poll_s: float = 2.0):
        self.put, self.get, self.delete = put, get, delete
        self.waits, self.poll_s = int(timeout_s / poll_s), poll_s
        self.handles: dict[str, Any] = {}

    def __call__(self, path: str) -> Any:
        if path not in self.handles:
            self.handles[path] = self._ready(path)
        return self.handles[path]

    def _ready(self, path: str) -> Any:
        states = polled(self.put(path), lambda handle: self.get(handle.name), self.waits, self.poll_s)
        settled = next((h for h in states if h.state != _PENDING), None)
        if settled is None:
            raise TimeoutError(f"{path}: not ready after {self.waits * self.poll_s:g} s")
        if settled.state != _READY:
            raise RuntimeError(f"{path}: the upload ended as {settled.state}")
        return settled

    def clear(self) -> list[str]:
        """Forget all handles and delete their files. The names of those that could be deleted; one that is gone already doesn't keep the others."""
        names = [handle.name for handle in self.handles.values()]
        self.handles.clear()
        return [name for name in names if self._deleted(name)]

    def _deleted(self, name: str) -> bool:
        with suppress(Exception):
            self.delete(name)
            return True
        return False


@dataclass
class Hosted:
    """Sees the whole clip and is told the window. call(handle, prompt, window, schema, store=False, **settings) gives (text, counts).

    settings: what a request fixes besides, such as fps, resolution, seed and the most tokens of an answer; config() is what a run's record says of it.
    """

    upload: Uploads
    call: Callable[..., tuple[str, Mapping[str, float] | None]]
    path_of: Mapping[str, str]
    model_id: str = "gemini-3.8-flash"
    fps: float = 2.0
    schema: Mapping = field(default_factory=dict)
    segment_local: bool = False
    settings: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if self.model_id not in PRICES:
            raise ValueError(f"no price is known for {self.model_id}")

    @property
    def tolerance_s(self) -> float:
        return 1 / self.fps

    def generate(self, clip_id: str, prompt: str, window: tuple[float, float] | None) -> Answer:
        text, counts = self.call(self.upload(self.path_of[clip_id]), prompt, window, self.schema, store=False, **self.settings)
        return Answer(text, usage_of(counts, self.model_id))

    def config(self) -> dict[str, Any]:
        return {"kind": "hosted", "model_id": self.model_id, "fps": self.fps, **self.settings}

    def close(self) -> None:
        """Uploads go when a task has made its calls, failed or not."""
        self.upload.clear()


@dataclass
class Local:
    """Sees only the window's segment, which trim(path, window) cuts, on the segment's own clock. run(path, prompt) gives (text, counts)."""

    trim: Callable[[str, tuple[float, float]], str]
    run: Callable[[str, str], tuple[str, Mapping[str, float]]]
    path_of: Mapping[str, str]
    model_id: str
    schema: Mapping
    sample_fps: float = 2.0
    patch_frames: int = 2
    segment_local: bool = True

    @property
    def tolerance_s(self) -> float:
        return self.patch_frames / self.sample_fps

    def generate(self, clip_id: str, prompt: str, window: tuple[float, float] | None) -> Answer:
        if window and window[0]:
            time_fields(self.schema)  # nothing to move would be known only after the call was paid for
        path = self.trim(self.path_of[clip_id], window) if window else self.path_of[clip_id]
        text, counts = self.run(path, f"{prompt}\nAnswer like this, and with nothing else: {example_of(self.schema)}")
        return Answer(text, {**counts, "estimated_cost_usd": 0.0})

    def config(self) -> dict[str, Any]:
        return {"kind": "local", "model_id": self.model_id, "fps": self.sample_fps}


def pick_device(cuda: bool, mps: bool) -> str:
    return "cuda" if cuda else "mps" if mps else "cpu"


def pick_runtime(system: str, machine: str) -> str:
    """Which local runtime suits a machine."""
    return "mlx" if (system, machine) == ("Darwin", "arm64") else "torch"


def response_schema() -> dict:
    """The JSON schema that answers should follow."""
    text, number, ids = {"type": "string"}, {"type": "number"}, {"type": "array", "items": {"type": "string"}}
    fields = {"person_ids": ids, "vehicle_ids": ids, "person_description": text, "vehicle_description": text, "interaction": text, "start_time_s": number, "evidence_time_s": number, "end_time_s": number, "confidence": number}
    item = {"type": "object", "properties": fields, "required": list(fields)}
    return json.loads(json.dumps({"type": "object", "properties": {"interactions": {"type": "array", "items": item}}, "required": ["interactions"]}))
