"""Helpers that the corpus operators share.

Texts reach Python as UTF-8 bytes: ``bytes.split()`` cuts exactly at x20 and
x09-x0D, which is the word rule of these operators, and no Unicode white space.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import remove, written

__all__ = ["CHUNK_BYTES", "CHUNK_ROWS", "ENTRY_BYTES", "MEMO_BYTES", "Memo", "below_share", "chunks", "held_out", "load", "local_frame", "mapped", "per_text", "quoted", "remove", "utf8", "written"]

#: Documents that Python handles at once, and bytes of text after which a chunk ends.
CHUNK_ROWS, CHUNK_BYTES = 256, 2 << 20

#: Bytes a worker's memo may hold before it is emptied (it bounds memory; results never depend on it), and what an entry takes besides its own bytes.
MEMO_BYTES, ENTRY_BYTES = 48 << 20, 150


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def utf8(column: str = "text") -> Column:
    return quoted(column).cast("string").cast("binary")


def below_share(column: Column, rows: int, of: int) -> Column:
    """Whether a column's hash is among the smallest, so that about `rows` of `of` values pass. No order and no exchange, and the same at every run."""
    return F.xxhash64(column.cast("string")) <= F.lit(min((1 << 63) - 1, -(1 << 63) + (1 << 64) * rows // max(1, of)))


class Memo:
    """A dict `known` of bytes or text that trim() empties beyond MEMO_BYTES. entry: bytes an entry has besides its key."""

    def __init__(self, entry: int = ENTRY_BYTES):
        self.entry, self.held, self.known = entry, 0, {}

    def took(self, keys) -> None:
        self.held += sum(map(len, keys)) + self.entry * len(keys)

    def trim(self) -> dict:
        if self.held > MEMO_BYTES:
            self.known.clear()
            self.held = 0
        return self.known


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; rows without an id count as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3, F.lit(1)) == 1


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows and few bytes, so that memory stays bounded whatever the texts' lengths."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            n = min(CHUNK_ROWS, batch.num_rows - start)
            while n > 1 and batch.slice(start, n).nbytes > CHUNK_BYTES:
                n //= 2
            yield batch.slice(start, n)
            start += n


def release() -> None:
    """Give freed memory back to the machine. Allocators keep much of it, and a worker that waits for its next task would hold it beside the JVM's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow, after each task of which the worker gives back what run() has freed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(task, schema)


def local_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a DataFrame. They go to the JVM as Arrow, for a list of rows is read in Python workers of its own, which executors keep beside those of mapInArrow."""
    fields = to_arrow_schema(T.StructType.fromDDL(schema))
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields))


def per_text(
    df: DataFrame, columns: list[str | Column], text: str | Column, make: Callable[[], Callable], fields: list[T.StructField]
) -> DataFrame:
    """One output row for each row of df: `columns`, and the fields that make()(list of bytes or None) returns as Arrow arrays."""
    kept = df.select(*columns, utf8(text).alias("__text") if isinstance(text, str) else text.alias("__text"))
    schema = T.StructType([*kept.schema.fields[:-1], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in chunks(batches):
            out = work(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], names=schema.fieldNames())

    return mapped(kept, run, schema)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
