"""Connected components over tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import remove, written

#: Edges that one task contracts. As soon as no more are left in all, one task finishes.
EDGES_A_TASK = 500_000


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v), u > v. Large: a node ties its greater neighbours to its least one; small: its smaller ones and itself."""
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    # Written, so that its join may be split where a node is hot.
    least = written(around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    told = (around.where("v > u") if large else edges).join(least, "u").select(F.col("v").alias("x"), "m")
    if not large:
        told = told.unionByName(least.select(F.col("u").alias("x"), "m"))
    out = written(told.where("x <> m").select(F.greatest("x", "m").alias("u"), F.least("x", "m").alias("v")).distinct(), "edges")
    remove(least)
    return out


def least_reachable(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least that edges (u, v) reach from it: labels are hooked to lesser ones and shortened until nothing changes."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new[new]


def _stars(batches: Iterator[pa.RecordBatch], whole: bool = False) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a task as stars (node, least node reachable by them); whole: with a row for that node itself."""

    def stars(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        nodes = pa.concat_arrays([c for name in "uv" for c in table.column(name).chunks])
        values = nodes.to_numpy() if pa.types.is_integer(nodes.type) else _ranks(nodes)
        first, at = np.unique(values, return_index=True, return_inverse=True)[1:]
        label = least_reachable(at[: table.num_rows], at[table.num_rows :], len(first))
        kept = np.flatnonzero((label != np.arange(len(first))) | whole)
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(first[kept])), nodes.take(pa.array(first[label[kept]]))], names=["u", "v"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows > 2 * EDGES_A_TASK:
            # More than a fair share, as keys of one hash meet: these go on by themselves.
            yield stars(held)
            held, rows = [], 0
    if rows:
        yield stars(held)


def _ranks(values: pa.Array) -> np.ndarray:
    """Each value's rank among the distinct ones in Spark's order: nulls first, structs field by field. By columns, as an object for each value would take some hundred bytes."""
    if pa.types.is_struct(values.type):
        rank = values.is_valid().to_numpy(False).astype(np.int64)
        for own in map(_ranks, values.flatten()):
            rank = np.unique(rank * (own.max() + 1) + own, return_inverse=True)[1]
        return rank
    coded = values.dictionary_encode()
    count = len(coded.dictionary)
    rank = np.zeros(count + 1, np.int64)
    rank[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(1, count + 1)
    return rank[coded.indices.fill_null(count).to_numpy(False)]


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of each node of the links (a, b): the smallest node reachable. Nodes: whole numbers, strings or structs of such.

    Tasks contract their own edges to stars. While more edges are left than one
    task takes, alternating star contractions over tables bring the parts of tasks
    together; the driver sees two counters. An empty table has no components.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    schema, state = T.StructType([T.StructField(f.name, f.dataType) for f in edges.schema]), None
    while True:
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new[0] <= EDGES_A_TASK:
            return edges.coalesce(1).mapInArrow(partial(_stars, whole=True), schema).toDF("node", "comp")
        if new == state:
            break
        state = new
        own = written(edges.repartition(-(-new[0] // EDGES_A_TASK), "v").mapInArrow(_stars, schema), "stars")
        first = _step(own, True)
        second = _step(first, False)
        remove(edges, own, first)
        edges = second
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
