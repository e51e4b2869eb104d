"""Exact top-k inner products by dual-tree search over cover trees.

Rows are dealt to clusters, each row to the nearest of up to `CLUSTERS` centres that
a bounded sample gives, farthest first. For each cluster its rows' and its queries'
greatest distance from the centre is known. What meets in one task is a block of rows
and a group of queries, each of bounded bytes: small clusters share one, large ones
are cut by a hash of the id. There the block and the group get a cover tree each:
below a node of radius r, children are chosen farthest first until each point is
within r / BASE of one, so children lie apart and cover all points (after FANOUT of
them, points that none covers go to the nearest, whose radius grows to what it really
takes). A node whose points have no near neighbours stays whole, for no part of it
could be pruned that it isn't pruned with.

Pairs are pruned by one bound at every level, of clusters and of nodes: a pair with
<cq, cr> + rho_q |cr| + rho_r |cq| + rho_q rho_r, the most that any query and any
row below can score, less than the worst kth score of the queries below. In a task,
pairs of nodes are visited best bound first, and a node's worst kth score is the
least of its children's. Between tasks, each group first meets one block, of the
cluster that promises most; the kth row found there is each query's floor. A floor
goes along with its query, and the worst of a cluster's decides which clusters it
meets at all, before anything is shuffled to them. Two leaves meet by products of
tiles, in single precision where that is exact, and only scores that reach a query's
kth are looked at one by one. Where vectors point evenly in all directions nothing
can be pruned, and the search is such a blocked product.
Pruning is strict, so ties survive to be settled by the smaller id. What the
blocks return for one query, up to k rows each, is merged by rank.

Vectors that are null, or hold a null or non-finite component, take no part;
vectors of different lengths never meet (a query sees rows of its own length).
Null ids take no part. Rows that repeat an id are each a candidate, but a query
never meets rows of its own id. Fewer rows than k: all of them. An empty table
gives an empty result. Scores are exact while products stay below 2**63.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import below_share, load, written

#: Rows of a first block and of a cluster, queries of a group there (about, as a hash deals them out), points of a leaf, of one whose points lie in clusters, ratio of radii, children at most.
BLOCK_ROWS, GROUP_ROWS, LEAF, LEAST, BASE, FANOUT = 8192, 4096, 128, 16, 1.5, 16
#: Clusters at most, rows of the sample for each of them.
CLUSTERS, SAMPLED = 256, 16
#: After the first blocks: parts of the rows and of the queries, unless these get smaller than so many rows or larger than so many bytes.
ROW_PARTS, QUERY_PARTS, PART_ROWS, PART_BYTES = 16, 4, 1024, 128 << 20
#: Queries and rows of a tile, rows of the first one.
TILE_QUERIES, TILE_ROWS, FIRST_ROWS = 512, 2048, 256
#: Points that are asked for their neighbours, sample at most, share of the usual distance at which neighbours are no longer near.
PROBES, PROBED, EVEN = 32, 8192, 0.5
#: Points that a part needs to be worth a visit, for a visit takes as long as some 25,000 products: few points, many points, and the parts for which few are enough; of rows and of queries.
ROW_CELL, QUERY_CELL = (128, 512, 64), (8, 48, 48)
#: The id of no row.
NO_ID = np.iinfo(np.int64).max


class Node:
    __slots__ = ("center", "children", "norm", "parent", "points", "radius", "worst")

    def __init__(self, center: np.ndarray, points: np.ndarray, radius: float):
        self.center, self.points, self.radius = center, points, radius
        self.norm = math.sqrt(float(center @ center))
        self.children: list[Node] = []
        self.parent: Node | None = None
        self.worst = -math.inf

    def reached(self, worst: float) -> None:
        """The worst kth score of the queries below is known to be this; a parent's is the least of its children's."""
        node: Node | None = self
        while node and worst > node.worst:
            node.worst, node = worst, node.parent
            if node:
                worst = min(c.worst for c in node.children)


def distances(x: np.ndarray, center: np.ndarray) -> np.ndarray:
    """Of each row of x from center, in double precision, by pieces."""
    out = np.empty(len(x))
    for at in range(0, len(x), TILE_ROWS):
        apart = x[at : at + TILE_ROWS] - center
        out[at : at + TILE_ROWS] = np.sqrt(np.einsum("ij,ij->i", apart, apart))
    return out


def even(x: np.ndarray, cell: int) -> bool:
    """Whether rows of x have hardly `cell` neighbours nearer than the usual distance, as far as a sample tells: no small ball has many of them."""
    rng = np.random.default_rng(len(x))
    sample = x[rng.choice(len(x), min(len(x), PROBED), replace=False)].astype(np.float64)
    square = (sample**2).sum(1)
    d = np.sqrt(np.maximum(square[:PROBES, None] + square[None, :] - 2 * sample[:PROBES] @ sample.T, 0))
    # The first is the row itself.
    near = min(len(sample) - 1, math.ceil(cell * len(sample) / len(x)))
    return float(np.quantile(np.partition(d, near, axis=1)[:, near], 0.25)) > EVEN * float(np.median(d))


def cover_tree(x: np.ndarray, points: np.ndarray | None = None, center: int = 0, cell: int = LEAST) -> Node:
    """The tree of rows `points` of x (ascending), whose root's center is row `center`. cell: points that stay together."""
    own = x if points is None else x[points]
    points = np.arange(len(x)) if points is None else points
    middle = x[center].astype(np.float64)
    d = distances(own, middle)
    # Distances are rounded; a radius a little too large only prunes less.
    node = Node(middle, points, float(d.max()) * (1 + 1e-9))
    if len(points) <= cell or node.radius == 0 or (len(points) > LEAF and even(own, cell)):
        return node
    centers, owner, reach = [center], np.zeros(len(points), np.int64), node.radius / BASE
    while True:
        far = int(d.argmax())
        if d[far] <= reach:
            break
        if len(centers) == FANOUT:
            # The points lie too evenly to be covered by few; each goes to its nearest center, with the radius that takes.
            break
        new = distances(own, own[far].astype(np.float64))
        owner[new < d] = len(centers)
        d = np.minimum(d, new)
        centers.append(int(points[far]))
    # Few points stay together, for one product is faster than many, unless parts of them lie much closer than the whole.
    if len(points) <= LEAF and d.mean() > node.radius / 4:
        return node
    node.children = [cover_tree(x, points[owner == k], c, cell) for k, c in enumerate(centers) if (owner == k).any()]
    for child in node.children:
        child.parent = node
    return node


def bound(q: Node, r: Node) -> float:
    most = float(q.center @ r.center) + q.radius * r.norm + r.radius * q.norm + q.radius * r.radius
    return most + 1e-9 * (1 + abs(most))


def _exact_type(queries: np.ndarray, rows: np.ndarray) -> type:
    """The smallest type that holds every sum on the way to an inner product, which is at most the product of the lengths."""
    zero = np.zeros(queries.shape[1])
    most = float(distances(queries, zero).max(initial=0)) * float(distances(rows, zero).max(initial=0))
    return np.float32 if most < 2**24 - 2 else np.float64 if most < 2**53 - 2**10 else np.int64


class Best:
    """The k best rows of each query so far (`scores`, `ids`; by score, ties to the smaller id), and the score and id that a row must reach to be among them."""

    def __init__(self, query_ids: np.ndarray, k: int, kind: type, floors: tuple[np.ndarray, np.ndarray] | None):
        n, self.k, self.query_ids = len(query_ids), k, query_ids
        self.none = kind(-np.inf) if issubclass(kind, np.floating) else kind(-NO_ID)
        self.scores, self.ids = np.full((n, k), self.none), np.full((n, k), NO_ID)
        self.least, self.least_id = np.full(n, self.none), np.full(n, NO_ID)
        if floors:
            known = floors[1] != NO_ID
            self.least[known], self.least_id[known] = floors[0][known].astype(kind), floors[1][known]
        self.found: list[tuple] = []
        self.waiting = 0

    def look(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """score: of queries `who` with rows `ids` (ascending)."""
        # A tie with the kth row counts only before its id.
        hit = score >= (self.least[who] + (self.least_id[who] < ids[0]).astype(score.dtype))[:, None]
        at = np.flatnonzero(hit)
        if len(at) > 4 * self.k * len(who):
            # Most scores at the start, or many copies: no more than k of each query are of use.
            score = np.where(hit & (self.query_ids[who][:, None] != ids[None, :]), score, self.none)
            j = np.argsort(-score, axis=1, kind="stable")[:, : self.k]
            i = np.repeat(np.arange(len(who)), j.shape[1])
            j = j.ravel()
            ok = score[i, j] != self.none
        else:
            i, j = np.divmod(at, score.shape[1])
            ok = self.query_ids[who[i]] != ids[j]
        i, j = i[ok], j[ok]
        if len(i):
            self.found.append((who[i], score[i, j], ids[j]))
            self.waiting += len(i)

    def settle(self) -> None:
        """Take in what look() has found."""
        if not self.found:
            return
        who, score, ids = (np.concatenate(x) for x in zip(*self.found, strict=True))
        self.found, self.waiting = [], 0
        asked = np.unique(who)
        who = np.concatenate([np.repeat(asked, self.k), who])
        score, ids = np.concatenate([self.scores[asked].ravel(), score]), np.concatenate([self.ids[asked].ravel(), ids])
        order = np.lexsort((ids, -score, who))
        first = np.searchsorted(who[order], asked)[:, None] + np.arange(self.k)
        self.scores[asked], self.ids[asked] = score[order][first], ids[order][first]
        kth, kth_id = self.scores[asked, -1], self.ids[asked, -1]
        better = (kth > self.least[asked]) | ((kth == self.least[asked]) & (kth_id < self.least_id[asked]))
        self.least[asked[better]], self.least_id[asked[better]] = kth[better], kth_id[better]


def search(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, met: Callable[[int], None] = lambda pairs: None, floors: tuple[np.ndarray, np.ndarray] | None = None) -> Best:
    """The k best rows of another id for each query. met: told of each number of (query, row) pairs that are compared. floors: score and id of a row below which none is asked for (NO_ID: no such row)."""
    kind = _exact_type(queries, rows)
    order = np.argsort(row_ids, kind="stable")
    held = np.float32 if kind is np.float32 else np.float64
    queries, rows, row_ids = queries.astype(held, copy=False), rows[order].astype(held, copy=False), row_ids[order]
    q_root, r_root = (cover_tree(x, cell=max(few, min(many, len(x) // parts))) for x, (few, many, parts) in ((queries, QUERY_CELL), (rows, ROW_CELL)))
    qi, ri = queries.astype(kind, copy=False), rows.astype(kind, copy=False)
    best = Best(query_ids, k, kind, floors)

    def reached(q: Node) -> None:
        q.reached(float(best.least[q.points].min()))

    def base(q: Node, r: Node) -> None:
        start, step = 0, FIRST_ROWS
        while start < len(r.points):
            at = r.points[start : start + step]
            those, ids = ri[at[0] : at[-1] + 1] if r is r_root else ri[at], row_ids[at]
            for first in range(0, len(q.points), TILE_QUERIES):
                who = q.points[first : first + TILE_QUERIES]
                met(len(who) * len(at))
                best.look(who, qi[who] @ those.T, ids)
            if 2 * best.waiting > k * len(q.points):
                best.settle()
            start, step = start + step, min(2 * step, TILE_ROWS)
        reached(q)

    leaves = [q_root]
    while floors and leaves:
        if not (q := leaves.pop()).children:
            reached(q)
        leaves += q.children
    queue, n = [(-bound(q_root, r_root), 0, q_root, r_root)], 1
    while queue:
        most, _, q, r = heapq.heappop(queue)
        if -most < q.worst:
            continue
        if not q.children and not r.children:
            base(q, r)
            continue
        if q.children and (q.radius >= r.radius or not r.children):
            pairs = [(c, r) for c in q.children]
        else:
            pairs = [(q, c) for c in r.children]
        for a, b in pairs:
            if (most := bound(a, b)) >= a.worst:
                heapq.heappush(queue, (-most, n, a, b))
                n += 1
    best.settle()
    return best


def dual_tree(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, met: Callable[[int], None] = lambda pairs: None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (ids, scores) of its k best rows of another id; as search()."""
    best = search(queries, query_ids, rows, row_ids, k, met)
    return [(ids[ok], scores[ok].astype(np.int64)) for ids, scores in zip(best.ids, best.scores, strict=True) for ok in [scores != best.none]]


def finite(vector_col: str) -> Column:
    """Whether every component is a finite number; null for a null vector."""
    return F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def farthest_first(x: np.ndarray, count: int) -> np.ndarray:
    """Up to `count` different rows of x, each the farthest from those before."""
    chosen, d = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < count and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def _by_length(vectors: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) of the vectors of each length."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.array(vectors.value_lengths())
    return [(int(n), at, vectors.take(pa.array(at)).flatten().to_numpy().reshape(len(at), n)) for n in np.unique(sizes) for at in [np.flatnonzero(sizes == n)]]


def _centres(sample: DataFrame, clusters: int) -> dict[int, np.ndarray]:
    """For each length in a bounded sample, centres."""
    found = [x for batch in sample.select("v").toArrow().to_batches() if batch.num_rows for x in _by_length(batch.column(0))]
    return {size: farthest_first(np.concatenate([x for s, _, x in found if s == size]), clusters) for size in {s for s, *_ in found}}


_PLACED = "id long, q boolean, size int, c int, away double, kind int, v binary"
#: Types of a packed vector, by bytes a component.
_KINDS = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.float64}


def _packed(x: np.ndarray) -> tuple[int, pa.Array]:
    """Rows of x as bytes, in the smallest type that holds them, and its bytes."""
    most = float(np.abs(x).max(initial=0))
    kind = next((b for b in (1, 2, 4) if most < 2 ** (8 * b - 1)), 8) if (x == np.rint(x)).all() else 8
    data = np.ascontiguousarray(x, dtype=_KINDS[kind])
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (kind * x.shape[1])
    return kind, pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.tobytes())])


def _unpacked(table: pa.Table, size: int) -> np.ndarray:
    """Vectors of a table of one length: floats, double ones if single ones might not hold them."""
    kinds = table.column("kind").to_numpy()
    x = np.empty((table.num_rows, size), np.float32 if (kinds <= 2).all() else np.float64)
    for kind in np.unique(kinds) if size else []:
        here = kinds == kind
        data = b"".join(b"".join(chunk.to_pylist()) for chunk in table.column("v").filter(pa.array(here)).chunks)
        x[here] = np.frombuffer(data, _KINDS[int(kind)]).reshape(-1, size)
    return x


def _placed(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """rows, packed, with their length, the nearest centre of that length (0, which is the origin, where the sample has none), and the distance from it."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            for n, at, x in _by_length(batch.column(1)):
                own = shared.value.get(n, np.zeros((1, n)))
                near = ((own**2).sum(1)[None, :] - 2 * x @ own.T).argmin(1)
                (kind, v), here, those = _packed(x), batch.take(pa.array(at)), len(at)
                yield pa.RecordBatch.from_arrays(
                    [here.column(0), here.column(2), pa.array(np.full(those, n, np.int32)), pa.array(near.astype(np.int32)), pa.array(np.sqrt(((x - own[near]) ** 2).sum(1))), pa.array(np.full(those, kind, np.int32)), v],
                    names=["id", "q", "size", "c", "away", "kind", "v"],
                )

    return rows.mapInArrow(run, _PLACED)


def _searched(held: DataFrame, pairs: list[tuple], k: int) -> DataFrame:
    """Of each query and block that it meets: the query, and `ids` and `scores` of the k best of the block, as far as they reach the query's floor.

    held: rows (q false) and queries (q true) with their floors. pairs: (size, c of queries, their part, its groups, c of rows, their part, its blocks, only), one for each two clusters that meet, where only is one block's number, or null for all blocks of the part.
    """
    spark = held.sparkSession
    met_by = F.broadcast(spark.createDataFrame(sorted({(s, c, qp, groups, rp, blocks, -1 if o is None else o) for s, _, qp, groups, c, rp, blocks, o in pairs}), "size int, c int, qp int, groups int, rp int, blocks int, only int"))
    meets = F.broadcast(spark.createDataFrame(sorted({(s, c, qp, groups, rp, blocks, -1 if o is None else o) for s, c, qp, groups, _, rp, blocks, o in pairs}), "size int, c int, qp int, groups int, rp int, blocks int, only int"))
    each = lambda n: F.sequence(F.lit(0), n - 1)
    block, group = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("groups")).cast("int")
    key, own = ["size", "qp", "g", "rp", "b"], ["id", "q", "c", "kind", "v", "floor", "floor_id"]
    rows = held.where("NOT q").join(met_by, ["size", "c"]).withColumn("b", block).where("only < 0 OR only = b").withColumn("g", F.explode(each(F.col("groups"))))
    asked = held.where("q").join(meets, ["size", "c"]).withColumn("g", group).withColumn("b", F.explode(F.when(F.col("only") < 0, each(F.col("blocks"))).otherwise(F.array("only"))))
    dealt = rows.select(*key, *own).unionByName(asked.select(*key, *own))

    def work(table: pa.Table) -> pa.Table:
        is_q = table.column("q").to_numpy()
        size = table.column("size")[0].as_py()
        queries, those = table.filter(pa.array(is_q)), table.filter(pa.array(~is_q))
        ids, scores, ok = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((queries.num_rows, 0), bool)
        if queries.num_rows and those.num_rows:
            floors = queries.column("floor").fill_null(0).to_numpy(), queries.column("floor_id").fill_null(NO_ID).to_numpy()
            best = search(_unpacked(queries, size), queries.column("id").to_numpy(), _unpacked(those, size), those.column("id").to_numpy(), k, floors=floors)
            ok = best.scores != best.none
            ids, scores = best.ids[ok], best.scores[ok].astype(np.int64)
        ends = np.concatenate([[0], ok.sum(1).cumsum()]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (ids, scores)]
        return pa.table([*(queries.column(c).combine_chunks() for c in ("id", "size", "c", "kind", "v")), *lists], names=["id", "size", "c", "kind", "v", "ids", "scores"])

    return dealt.groupBy(*key).applyInArrow(work, "id long, size int, c int, kind int, v binary, ids array<long>, scores array<long>")


def _parts(counts: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """For each cluster its part and the pieces which that is cut into: clusters share a part up to `most`, larger ones are cut."""
    out, part, held = {}, -1, most
    for c, n in counts.items():
        if held + n > most:
            part, held = part + 1, 0
        held += n
        out[c] = (part, math.ceil(n / most))
    return out


def top_k(df: DataFrame, is_query, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(query_id, rank, id, score) of each query's k best other rows by inner product of whole numbers held as doubles."""
    usable = lambda df: df.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(finite(vector_col), F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    )
    # Rows that take no part count here, for it only steers how many clusters there are.
    n = df.count()
    clusters = max(1, min(CLUSTERS, math.ceil(n / block_rows)))
    sample = usable(df).limit(SAMPLED) if clusters == 1 else usable(df.where(below_share(F.col(id_col).cast("long"), clusters * SAMPLED, n))).limit(4 * clusters * SAMPLED)
    centres = _centres(sample, clusters)
    placed = written(_placed(usable(df), centres), "placed")
    # One row for each length and cluster.
    stats = placed.groupBy("size", "c").agg(F.count("*").alias("rows"), F.max("away").alias("away"), F.count_if("q").alias("asked"), F.max(F.when(F.col("q"), F.col("away"))).alias("q_away")).orderBy("size", "c").collect()
    of: dict[int, list] = {}
    for r in stats:
        of.setdefault(r["size"], []).append(r)

    # For each length, the most that a cluster's queries (down) and a cluster's rows (across) can score.
    bounds = {}
    for size, own in of.items():
        c = centres.get(size, np.zeros((1, size)))[[r.c for r in own]]
        norm, away, q_away = np.sqrt((c**2).sum(1)), np.array([r.away for r in own]) * (1 + 1e-9), np.array([r.q_away or 0 for r in own]) * (1 + 1e-9)
        most = c @ c.T + q_away[:, None] * norm + norm[:, None] * away + q_away[:, None] * away
        bounds[size] = most + 1e-9 * (1 + np.abs(most))
    first = []
    for size, own in of.items():
        c = centres.get(size, np.zeros((1, size)))[[r.c for r in own]]
        for q, most in zip(own, c @ c.T, strict=True):
            # Not by the bound, which is greatest for a wide cluster.
            r = own[int(most.argmax())]
            if q.asked:
                first.append((size, q.c, q.c, math.ceil(q.asked / group_rows), r.c, r.c, math.ceil(r.rows / block_rows), 0))
    floorless = F.lit(None).cast("long")
    rows = placed.withColumns({"q": F.lit(False), "floor": floorless, "floor_id": floorless}).drop("away")
    queries = placed.where("q").withColumns({"floor": floorless, "floor_id": floorless}).drop("away")
    met = _searched(rows.unionByName(queries), first, k)
    # A query of fewer than k rows so far has no floor.
    asked = written(met.select("id", F.lit(True).alias("q"), "size", "c", "kind", "v", F.get("scores", F.lit(k - 1)).alias("floor"), F.get("ids", F.lit(k - 1)).alias("floor_id")), "asked")
    limit = {(r["size"], r.c): r.least for r in asked.groupBy("size", "c").agg(F.min(F.coalesce(F.col("floor").cast("double"), F.lit(-math.inf))).alias("least")).collect()}
    pairs = []
    for size, own in of.items():
        held = PART_BYTES // (8 * max(1, size))
        n_rows, n_asked = sum(r.rows for r in own), sum(r.asked for r in own)
        row_part = _parts({r.c: r.rows for r in own}, max(1, min(held, max(n_rows // ROW_PARTS, min(block_rows, PART_ROWS)))))
        asked_part = _parts({r.c: r.asked for r in own if r.asked}, max(1, min(held // 2, max(n_asked // QUERY_PARTS, group_rows))))
        for q, most in zip(own, bounds[size], strict=True):
            if q.asked:
                pairs += [(size, q.c, *asked_part[q.c], r.c, *row_part[r.c], None) for r, b in zip(own, most, strict=True) if b >= limit[size, q.c]]
    # The first blocks are met again, with all that reaches the floors.
    found = _searched(rows.unionByName(asked), pairs, k).select(F.col("id").alias("query_id"), F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("scores").alias("score"))))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op8_topk(spark, sf_dir: str) -> DataFrame:
    # The floor of a double is a long, which is always finite: such vectors go before it.
    whole = F.expr("transform(embedding, x -> CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE))")
    rows = load(spark, sf_dir, "embeddings").withColumn("embedding", F.when(finite("embedding"), whole))
    found = top_k(rows, F.col("vec_id") % 20 == 0, 20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
