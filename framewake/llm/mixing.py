"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources in code point order, null last, get weights 5, 2, 1, repeating,
and share all words by weight; a source's target stops at `max_passes` times its
size, and the excess is shared again by weight among the others.

Draw: each source's rows are dealt into blocks by a hash of their id. A unit is one
pass of one block, and a source's quota is the number of units that its target
takes, the last of them only in part. A tree over the output shards halves the
quotas again and again, each split a multivariate hypergeometric draw of the units
left on one side, so every shard gets an exact quota of each source, and the mix of
all shards is that of the whole up to chance. Then shards draw: a source's blocks
stand in an order permuted by seed, anew for each pass, and each shard takes its
quota from where the shard before it ended. So shards are disjoint without ever
having to agree, and what they draw is what the mix takes. Of the last unit's block,
rows are taken in hashed order up to the point nearest to the target, so a source
misses its target by at most one row's size. Within its shard a row's place is a
hash of id and pass: the shuffle is local.

The driver holds, besides one row per source, about `PLAN_ROWS` rows of blocks and a
quota per source and shard: large sources have up to `BLOCKS` blocks, others fewer
where sources are many. Any number of sources works; the plan is broadcast only as
long as it has no more than `BROADCAST_ROWS` rows. A hot source is many blocks, the
rows of a block that is cut are ordered in `CUTS` parts with sums of the parts before,
and no exchange is keyed by source alone.

Null texts and texts without words have size 0 and are taken as their block is,
adding nothing. Null sources are one source of their own. A table of size 0
takes nothing. Repeated rows are rows of their own, in the same block. The same
input and seed give the same result. Other columns pass through mix() as they
are, whatever their names (one named as `shard_col` is replaced); assign() adds
names that begin with two underscores and raises an error if df has such.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import load, local_frame, quoted, remove, written

#: Blocks of a source at most (a power of two) and of all sources together about; parts of a cut block; output shards (a power of two); tasks of a shard.
BLOCKS, PLAN_ROWS, CUTS, SHARDS, SALT = 256, 1 << 16, 256, 64, 16
#: Rows of a plan that are broadcast at most.
BROADCAST_ROWS = 500_000
WEIGHTS, MAX_PASSES, SEED = (5, 2, 1), 3, 17


def word_count(text: str = "text") -> Column:
    """Words cut at x20 and x09-x0D, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> list[float]:
    """Each source's target, in the order of sizes."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free, rest = [0.0] * len(sizes), set(range(len(sizes))), sum(sizes)
    while free:
        total = sum(w[i] for i in free)
        over = [i for i in free if rest * w[i] > max_passes * sizes[i] * total]
        if not over:
            for i in free:
                out[i] = rest * w[i] / total
            break
        for i in over:
            out[i] = float(max_passes * sizes[i])
        free.difference_update(over)
        rest -= sum(max_passes * sizes[i] for i in over)
    return out


def split_tree(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """[shards, sources] units of each source that each shard gets; columns sum to quotas, rows to nearly equal totals."""
    quotas = np.asarray(quotas, np.int64)
    if shards == 1:
        return quotas[None]
    left, total = shards // 2, int(quotas.sum())
    rng = np.random.default_rng([seed, shards, total])
    take = rng.multivariate_hypergeometric(quotas, total * left // shards, method="marginals") if total else quotas * 0
    return np.concatenate([split_tree(take, left, 2 * seed + 1), split_tree(quotas - take, shards - left, 2 * seed + 2)])


def draw(quotas: list[int], passes: list[int], blocks: list[list[int]], shards: int = SHARDS, seed: int = SEED) -> list[dict[int, list[tuple[int, int]]]]:
    """For each source {block: [(pass, shard)]}: the tree's quotas, drawn by each shard from the source's permuted blocks.

    quotas: units of each source; passes: whole passes among them; blocks: its blocks.
    """
    out: list[dict[int, list[tuple[int, int]]]] = [{} for _ in quotas]
    dealt = split_tree(np.array(quotas, np.int64), shards, seed) if quotas else np.zeros((shards, 0), np.int64)
    for i, own in enumerate(blocks):
        rng = np.random.default_rng([seed, i])
        order = [(int(b), k) for k in range(passes[i] + 1) for b in rng.permutation(own)]
        # The units of all passes are shuffled among the shards, the last one, which may be cut, keeps its place in the count.
        units = [order[k] for k in rng.permutation(quotas[i])]
        at = np.append(0, np.cumsum(dealt[:, i]))
        for shard in range(shards):
            for b, k in units[at[shard] : at[shard + 1]]:
                out[i].setdefault(b, []).append((k, shard))
    return out


def _hash(id_col: str, *more: int) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), *map(F.lit, more))


def _prepared(df: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    if any(c.startswith("__") for c in df.columns):
        raise ValueError("columns that begin with two underscores are reserved")
    return df.withColumns({"__size": word_count(text_col), "__block": F.pmod(_hash(id_col, seed), F.lit(BLOCKS)).cast("int")})


def blocks_of(size: int, total: int, sources: int) -> int:
    """Blocks of a source: a power of two, up to BLOCKS; by its share where all sources together would have over PLAN_ROWS."""
    if sources * BLOCKS <= PLAN_ROWS:
        return BLOCKS
    return 1 << max(0, min(BLOCKS.bit_length() - 1, int(PLAN_ROWS * size / max(1, total)).bit_length() - 1))


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = SEED) -> tuple[list[tuple], dict]:
    """Rows (source, block, shards of its passes in order, cut or null), and {source: (size, target, blocks)}; cut: words wanted of the block's last pass."""
    spark = df.sparkSession
    sums = _prepared(df.select(id_col, text_col, source_col), id_col, text_col, seed).groupBy(F.col(source_col).cast("string").alias("s"), "__block").agg(F.sum("__size").alias("n"))
    sums = written(sums, "sizes")
    size_of = {r.s: r.n for r in sums.groupBy("s").agg(F.sum("n").alias("n")).toLocalIterator()}
    sources, total = sorted(size_of, key=lambda s: (s is None, s or "")), sum(size_of.values())
    n_blocks = {s: blocks_of(size_of[s], total, len(sources)) for s in sources}
    # Block numbers are hashes modulo a power of two, so those of fewer blocks are their remainders.
    fewer = local_frame(spark, list(n_blocks.items()), "t string, m int")
    at = sums.join(fewer, F.col("s").eqNullSafe(F.col("t"))).groupBy("s", (F.col("__block") % F.col("m")).alias("b")).agg(F.sum("n").alias("n"))
    by: dict[str | None, dict[int, int]] = {s: {} for s in sources}
    for r in at.toLocalIterator():
        by[r.s][r.b] = r.n
    remove(sums)
    wanted = targets([size_of[s] for s in sources])
    quotas, passes, cuts = [], [], {}
    for i, s in enumerate(sources):
        size = size_of[s]
        whole, rest = (int(wanted[i] // size), math.fmod(wanted[i], size)) if size else (0, 0.0)
        quota = whole * len(by[s])
        # The pass after the whole ones goes on until the target is met, as draw() permutes it.
        rng = np.random.default_rng([seed, i])
        for _ in range(whole):
            rng.permutation(sorted(by[s]))
        for b in rng.permutation(sorted(by[s])).tolist():
            if rest <= 0:
                break
            quota += 1
            if by[s][b] > rest:
                cuts[s, b] = rest
                break
            rest -= by[s][b]
        quotas.append(quota)
        passes.append(whole)
    drawn = draw(quotas, passes, [sorted(by[s]) for s in sources], shards, seed)
    rows = [(s, b, [shard for _, shard in sorted(units)], cuts.get((s, b))) for s, own in zip(sources, drawn, strict=True) for b, units in own.items()]
    return rows, {s: (size_of[s], wanted[i], n_blocks[s]) for i, s in enumerate(sources)}


def _small(rows: list, df: DataFrame) -> DataFrame:
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def assign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """df with __size, __source_size, __target and __shards: the shard of each pass in which the mix takes the row."""
    spark = df.sparkSession
    rows, totals = plan(df, id_col, text_col, source_col, shards, seed)
    units = local_frame(spark, rows, "__s string, __b int, __shards array<int>, __cut double")
    sums = local_frame(spark, [(s, *v) for s, v in totals.items()], "__t string, __source_size long, __target double, __blocks int")
    source = F.col(source_col).cast("string")
    in_block = source.eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__b"))
    ready = _prepared(df, id_col, text_col, seed).join(_small(totals, sums), source.eqNullSafe(F.col("__t")), "left").withColumn("__block", F.col("__block") % F.col("__blocks"))
    placed = ready.join(_small(rows, units), in_block, "left").drop("__t", "__s", "__b", "__block", "__blocks").withColumn("__shards", F.coalesce("__shards", F.array().cast("array<int>")))
    cut = [(s, b, float(c)) for s, b, _, c in rows if c is not None]
    if not cut:
        return placed.drop("__cut")
    # One block of each source at most has a cut. Its rows' sizes, without texts, are summed in hashed order up to a last
    # row that is still taken: sums of parts of the block first, so that only rows of one part are ever in one order.
    place = lambda i, size: F.struct(_hash(i, seed, 1).alias("h"), F.col(i).cast("string").alias("i"), F.col(size).alias("n"))
    of_cut = local_frame(spark, cut, "__s string, __b int, __c double")
    # Rows that repeat id and size go together; the last are taken if that ends nearer to the target.
    own = ready.select(F.col(id_col), source_col, source.alias("__k"), "__block", "__size").join(_small(cut, of_cut), in_block)
    own = own.groupBy("__k", "__c", place(id_col, "__size").alias("__place"), "__size").agg(F.count("*").alias("__copies"))
    own = written(own.withColumn("__part", F.floor(F.col("__place.h") / F.lit(2.0**64 / CUTS))), "cuts")
    whole = F.col("__size") * F.col("__copies")
    running = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    earlier = own.groupBy("__k", "__part").agg(F.sum(whole).alias("__n")).withColumn("__offset", F.coalesce(F.sum("__n").over(running("__k").orderBy("__part")), F.lit(0)))
    at = own.join(earlier.select(F.col("__k").alias("__k2"), F.col("__part").alias("__part2"), "__offset"), F.col("__k").eqNullSafe(F.col("__k2")) & (F.col("__part") == F.col("__part2")))
    before = F.col("__offset") + F.coalesce(F.sum(whole).over(running("__k", "__part").orderBy("__place")), F.lit(0))
    last = at.withColumn("__before", before).where(F.col("__before") + whole / 2 <= F.col("__c")).groupBy("__k").agg(F.max("__place").alias("__last"))
    last = written(last, "last")
    remove(own)
    taken = F.coalesce(place(id_col, "__size") <= F.col("__last"), F.lit(False))
    shorter = F.slice("__shards", 1, F.greatest(F.size("__shards") - 1, F.lit(0)))
    placed = placed.join(_small(cut, last), source.eqNullSafe(F.col("__k")), "left")
    return placed.withColumn("__shards", F.when(F.col("__cut").isNotNull() & ~taken, shorter).otherwise(F.col("__shards"))).drop("__k", "__last", "__cut")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = SEED, shard_col: str | None = "shard") -> DataFrame:
    """df's columns for each time the mix takes a row, and its shard unless shard_col is None; written in order of shard and, within it, shuffled."""
    names = {c: f"c{k}" for k, c in enumerate(df.columns)}
    own = df.select(*(quoted(c).alias(n) for c, n in names.items()))
    taken = assign(own, names[id_col], names[text_col], names[source_col], shards, seed).select(*own.columns, F.posexplode("__shards").alias("__pass", "__shard"))
    order = F.xxhash64(F.col(names[id_col]).cast("string"), "__pass", F.lit(seed))
    # A shard is dealt to several tasks, each of which shuffles its part.
    dealt = taken.repartition("__shard", F.pmod(order, F.lit(SALT))).sortWithinPartitions("__shard", order)
    out = [F.col(n).alias(c) for c, n in names.items() if c != shard_col]
    return dealt.select(*out, *([F.col("__shard").alias(shard_col)] if shard_col else []))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    rows = assign(load(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = (F.col("__size") * F.size("__shards")).alias("taken")
    return rows.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), taken, F.array_join("__shards", ",").alias("shards"))
