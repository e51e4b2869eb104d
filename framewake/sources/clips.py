"""Clip discovery and headers."""

from __future__ import annotations

import json
import shutil
import subprocess
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stem

HEADER = "path string, width int, height int, fps string, duration_s double, frames long, error string"


def discover_clips(spark: SparkSession, source: str, output_dir: str | None = None, pattern: str = "*.mp4") -> DataFrame:
    """(path, clip_id, bytes) of the clips in a folder, not below it, in order of name; or of one file. Contents aren't read.

    Raises FileNotFoundError where there is none, ValueError where output would land on the input.
    """
    if output_dir is not None and output_dir.rstrip("/") == source.rstrip("/"):
        raise ValueError("the output folder is the input folder")
    reader = spark.read.format("binaryFile")
    suffix = pattern.lstrip("*")
    reader = reader if source.endswith(suffix) else reader.option("pathGlobFilter", pattern)
    try:
        found = reader.load(source).select("path", stem(F.col("path")).alias("clip_id"), F.col("length").alias("bytes"))
        if found.isEmpty():
            raise FileNotFoundError(f"no {pattern} in {source}")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(source) from e
        raise
    return found.orderBy("path")


def needed_binary(name: str, find: Callable[[str], str | None] = shutil.which) -> str:
    """Where a program is; an error that names it where it isn't, before any clip is opened."""
    path = find(name)
    if path is None:
        raise FileNotFoundError(f"{name} isn't installed here")
    return path


def ffprobe(path: str, run: Callable = subprocess.run, find: Callable[[str], str | None] = shutil.which) -> dict:
    """A header for probe_clips() by ffprobe: of the first video stream, and the container's duration."""
    command = [needed_binary("ffprobe", find), "-v", "error", "-of", "json", "-select_streams", "v:0", "-show_entries", "stream=width,height,avg_frame_rate,nb_frames:format=duration", path]
    done = run(command, capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(f"{path}: ffprobe says {(done.stderr or '').strip() or done.returncode}")
    told = json.loads(done.stdout)
    if not told.get("streams"):
        raise ValueError(f"{path}: no video stream")
    stream, length = told["streams"][0], told.get("format", {}).get("duration")
    frames = stream.get("nb_frames")
    return {"width": stream["width"], "height": stream["height"], "fps": stream["avg_frame_rate"], "duration_s": None if length is None else float(length), "frames": int(frames) if str(frames or "").isdigit() else None}


def probe_clips(paths: DataFrame, probe: Callable[[str], dict]) -> DataFrame:
    """A header for each path by a function (width, height, fps, duration_s and, if it knows, frames) such as ffprobe(); its exceptions become a column error.

    Degenerate rates (no or a zero numerator or denominator) and durations are errors too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    h = probe(path)
                    num, _, den = str(h["fps"]).partition("/")
                    if not int(num) or not int(den or 1):
                        raise ValueError(f"{path}: no frame rate")
                    if not h["duration_s"] or h["duration_s"] <= 0:
                        raise ValueError(f"{path}: no duration")
                    rows.append({"path": path, **{k: h[k] for k in ("width", "height", "fps", "duration_s")}, "frames": h.get("frames"), "error": None})
                except Exception as e:  # a clip's failure is data
                    rows.append({"path": path, "width": None, "height": None, "fps": None, "duration_s": None, "frames": None, "error": f"{type(e).__name__}: {e}"})
            shape = pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("fps", pa.string()), ("duration_s", pa.float64()), ("frames", pa.int64()), ("error", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    return paths.select("path").mapInArrow(run, HEADER)


def annotated_path(path, output_dir: str):
    """Where a clip's annotated copy goes."""
    return F.concat(F.lit(output_dir.rstrip("/") + "/"), stem(path), F.lit(".mp4"))
