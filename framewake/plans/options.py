"""What a batch is asked to do, checked before anything expensive begins."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from ..operators.windows import check_window_settings

DEFAULT_WINDOW, DEFAULT_STRIDE = 8.0, 4.0
#: Settings that mean something to one kind of backend only; None is "not given".
ONLY = {"hosted": ("fps", "resolution", "thinking_level", "max_output_tokens"), "local": ("max_new_tokens",)}


@dataclass
class Options:
    source: str
    output: str
    backend: str = "hosted"
    model_id: str | None = None
    window_s: float | None = None
    stride_s: float | None = None
    whole_clip: bool = False
    imgsz: int | None = None
    buffer_seconds: float = 3.0
    reid: str = "auto"
    seed: int | None = None
    fps: float | None = None
    resolution: str | None = None
    thinking_level: str | None = None
    max_output_tokens: int | None = None
    max_new_tokens: int | None = None

    def window(self) -> tuple[float, float] | None:
        """Window and stride, or None for one call per clip."""
        if self.whole_clip:
            if given := [n for n in ("window_s", "stride_s") if getattr(self, n) is not None]:
                raise ValueError(f"{', '.join(given)}: a whole clip has no windows")
            return None
        pair = (self.window_s if self.window_s is not None else DEFAULT_WINDOW, self.stride_s if self.stride_s is not None else DEFAULT_STRIDE)
        check_window_settings(*pair)
        return pair

    def backend_settings(self) -> dict:
        """The settings of the backend that runs; one that is meant for the other is refused, not ignored."""
        if self.backend not in ONLY:
            raise ValueError(f"unknown backend {self.backend!r}")
        for kind, names in ONLY.items():
            if kind != self.backend and (given := [n for n in names if getattr(self, n) is not None]):
                raise ValueError(f"{', '.join(given)}: for a {kind} backend only")
        if self.backend == "local" and not self.model_id:
            raise ValueError("a local backend needs a model id")
        return {n: getattr(self, n) for n in (*ONLY[self.backend], "seed") if getattr(self, n) is not None}

    def check(self) -> "Options":
        self.window()
        self.backend_settings()
        if self.buffer_seconds <= 0:
            raise ValueError("buffer_seconds must be positive")
        return self


def size_or_auto(text: str) -> int | None:
    """A positive whole number, or None for auto."""
    if text == "auto":
        return None
    if not text.isdigit() or int(text) <= 0:
        raise argparse.ArgumentTypeError(f"a positive whole number or auto, not {text!r}")
    return int(text)


def parse(argv: list[str]) -> Options:
    """Options from a command line; a bad one ends with exit code 2."""
    p = argparse.ArgumentParser(prog="framewake")
    p.add_argument("source")
    p.add_argument("output")
    p.add_argument("--backend", choices=tuple(ONLY), default="hosted")
    p.add_argument("--imgsz", type=size_or_auto)
    p.add_argument("--whole-clip", action="store_true")
    for name, kind in (("model_id", str), ("window_s", float), ("stride_s", float), ("seed", int), ("fps", float), ("resolution", str), ("thinking_level", str), ("max_output_tokens", int), ("max_new_tokens", int)):
        p.add_argument("--" + name.replace("_", "-"), type=kind)
    p.add_argument("--buffer-seconds", type=float, default=3.0)
    p.add_argument("--reid", default="auto")
    options = Options(**vars(p.parse_args(argv)))
    try:
        return options.check()
    except ValueError as e:
        p.error(str(e))
