"""N-gram Jaccard join: prefix filtering, rarest first, with length, positional and suffix filters.

A document is the set of its distinct shingles (runs of `width` words, ASCII
letters in lower case), held as 64-bit hashes. Two documents link when
100 * intersection >= percent * union. No link between different sets is lost:

1. One pass over all texts hashes the sets, names each by a hash (copies share
   their name and go on as one), and counts shingles in a bounded sketch.
2. A second pass orders each set by (count in the sketch, hash), a global order
   with rare shingles first, and emits its prefix: linked sets share a shingle
   of it. Equal shingles meet by a shuffle; those of a single set end there, and
   those that the sketch calls frequent are dealt to several tasks.
3. Sets that share a prefix shingle are a group; groups of equal members are one.
4. Chains. A group is sorted by two minima of each set's hashes, so that similar
   sets stand side by side, and each member is paired with the nearest of the few
   before it that passes the filters: at most one pair a member, however large the
   group. Pairs are verified by their whole sets, and the links closed to
   components. Groups of over `BLOCK` members are cut into blocks; one
   member of each component then stands for it in further chains of the group.
5. The rest, exactly. Groups in which all members are of one component are done.
   In the others, members of different components are compared in blocks: those
   outside the group's largest component with each other and with it. Sets
   that pass the filters with any such partner are fetched, and their pairs
   verified where they meet, most similar first; a pair that earlier links have
   joined is skipped, and only links that join parts are emitted. A pair that
   meets in several groups is looked at in the least of them.

Filters: sizes (length); the shingles left behind the common one in both prefixes
(positional); and sizes of parts (suffix): common pivots cut an order of all
shingles into parts, and what two sets hold of a part differs by at least the
difference of the counts. For whole groups this is done with counts mod 2, a bit
a part, over up to `BITS` parts; before a pair's sets are intersected, with
true counts at pivots of one of them.

Components come from alternating star contractions over tables, with nothing but
counters on the driver.

Null and empty texts and texts without words have no shingles and link with
nothing, not even each other; their component is their own id. Rows with equal
sets are one component. Repeated rows give repeated results. An id given to rows
with different texts is judged row by row. A null id is nobody's component unless
all ids of the component are null. An empty table gives an empty result. Texts are
read whole; other columns never, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.closure import components
from .common import ENTRY_BYTES, MEMO_BYTES, Memo, chunks, load, local_frame, mapped, quoted, remove, utf8, written

WIDTH, PERCENT = 5, 80
#: Counters of the sketch (8 bytes each on the driver and in every worker) and the pieces in which they are summed.
COUNTERS, PIECES = 1 << 20, 16
#: Rows of one shingle from which its members are dealt to several tasks: this many, or so many times the mean of a counter.
HOT_ROWS, HOT_MEANS = 4096, 16
#: Members of a block and shingles that they have in all; members of a group that a task holds to name it by them; rows of candidate ids that are broadcast at most.
BLOCK, BLOCK_SHINGLES, HELD, BROADCAST_ROWS = 512, 1 << 20, 4096, 2_000_000
#: Bytes, written as text, of what is asked of texts and broadcast at most.
ASKED_BYTES = 64 << 20
#: Bits of a bitmap at most; members before it that one is compared with in a chain; rounds of chains at most.
BITS, LOOK, CHAINS = 2048, 4, 4
#: Names of sets that a task remembers so as to emit each once.
SEEN = 300_000
# Odd factors of a shingle's words.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Shingles:
    """The sorted distinct shingle hashes of a text; words' hashes are remembered."""

    def __init__(self, width: int = WIDTH):
        self.width, self.memo = width, Memo()

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        memo, n = self.memo.trim(), len(words)
        if new := set(words).difference(memo):
            memo.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
            self.memo.took(new)
        h, k = np.fromiter(map(memo.__getitem__, words), np.uint64, n), min(n, self.width)
        total = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            total += _mixed(h[i : n - k + 1 + i] * _FACTORS[i % 8] + np.uint64(i))
        return np.unique(_mixed(total))


def set_name(shingles: np.ndarray) -> int:
    return int.from_bytes(md5(shingles.tobytes()).digest()[:8], "little", signed=True)


def bitmap(shingles: np.ndarray) -> bytes:
    """The suffix filter's parts, with their sizes mod 2: 2 parts a shingle or more, up to BITS, a power of two. Pivots cut the order of the hashes' bits from 40 on, lowest first."""
    bits = 64
    while bits < min(2 * len(shingles), BITS):
        bits *= 2
    odd = np.bincount((shingles >> np.uint64(40)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def required(nx, ny, percent: int):
    """The least intersection of sets of these sizes that link."""
    return -(-(percent * (nx + ny)) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """A linked set shares at least ceil(percent % of n) shingles, so one among the first this many."""
    return n + 1 - -(-percent * n // 100)


_SETS = T.StructType(
    [
        T.StructField("row", T.BooleanType()), T.StructField("doc", T.LongType()), T.StructField("n", T.LongType()), T.StructField("node", T.LongType()),
        T.StructField("bits", T.BinaryType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("read", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("counts", T.BinaryType()),
    ]
)


def _sets(df: DataFrame, width: int) -> DataFrame:
    """Rows of sets (row is true) and pieces of each task's sketch. df: (doc, t, read), where read is a hash of the text."""

    def run(batches):
        shingles, sketch = Shingles(width), np.zeros(COUNTERS, np.uint32)
        for batch in chunks(batches):
            found = [shingles(t) for t in batch.column(1).to_pylist()]
            at = np.concatenate(found) & np.uint64(COUNTERS - 1)
            np.add.at(sketch, at.astype(np.int64), 1)
            k = len(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([True] * k), batch.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([set_name(s) if len(s) else None for s in found], pa.int64()),
                    pa.array([bitmap(s) if len(s) else None for s in found], pa.binary()),
                    *(pa.array([s[at].view(np.int64) if len(s) else None for s in found], pa.int64()) for at in (0, -1)), batch.column(2), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()),
                ],
                names=_SETS.fieldNames(),
            )
        if sketch.any():
            parts = [zlib.compress(p.tobytes(), 1) for p in np.split(sketch, PIECES)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([False] * PIECES), *(pa.nulls(PIECES, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())), pa.array(range(PIECES), pa.int32()), pa.array(parts, pa.binary())],
                names=_SETS.fieldNames(),
            )

    return mapped(df, run, _SETS)


def _summed(sketches: DataFrame) -> np.ndarray:
    """The counters of all tasks, summed by piece on the executors."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(part), np.uint32).astype(np.uint64)
                sums[piece] = sums[piece] + own if piece in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["piece", "counts"])

    out = np.zeros((PIECES, COUNTERS // PIECES), np.uint64)
    for piece, part in mapped(sketches.select("piece", "counts").repartition("piece"), add, "piece int, counts binary").collect():
        out[piece] += np.frombuffer(part, np.uint64)
    return np.minimum(out.reshape(-1), 2**32 - 1).astype(np.uint32)


def _prefixes(df: DataFrame, counts, width: int, percent: int) -> DataFrame:
    """(h, salt, node, pos) of each set's prefix; a task emits a set once. salt: 0, or for frequent shingles the task to which the set is dealt, from 1 on."""
    names = ["h", "node", "at"]

    def run(batches):
        shingles, seen, sketch = Shingles(width), set(), counts.value
        hot = max(HOT_ROWS, HOT_MEANS * int(sketch.mean()))
        for batch in chunks(batches):
            out: tuple[list, ...] = ([], [], [])
            for text in batch.column(0).to_pylist():
                s = shingles(text)
                if not len(s) or (name := set_name(s)) in seen:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(name)
                p = prefix_length(len(s), percent)
                rank = (sketch[(s & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(32)) | (s >> np.uint64(32))
                first = np.argpartition(rank, p - 1)[:p] if p < len(s) else np.arange(len(s))
                # Ties in counter and half of the hash are broken by the hash: s is sorted by it.
                cut = rank[first].max()
                first = np.sort(np.flatnonzero(rank <= cut))
                first = first[np.argsort(rank[first], kind="stable")][:p]
                rows = (rank[first] >> np.uint64(32)).astype(np.int64)
                salts = np.zeros(p, np.int32)
                often = rows > hot
                salts[often] = 1 + (name & 0x7FFFFFFFFFFFFFFF) % -(-rows[often] // hot)
                for part, value in zip(out, (s[first].view(np.int64), np.full(p, name), (salts.astype(np.int64) << 32) + np.arange(p)), strict=True):
                    part.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=names)

    # Three numbers a row are what is shuffled.
    return mapped(df, run, "h long, node long, at long")


def _groups(prefixes: DataFrame) -> DataFrame:
    """(gid, node, pos) of shingles that two sets or more have; groups of equal members get one gid."""
    names = ["gid", "node", "pos"]

    def run(batches):
        known: dict[int, np.ndarray] = {}
        held = 0
        out: list[np.ndarray] = []

        def group(h: int, rows: np.ndarray, whole: bool):
            """rows: [node, pos] of one shingle, each node once. A group that came in parts is named by its shingle."""
            nonlocal held
            if whole:
                if len(rows) < 2:
                    return
                gid = int(_mixed(rows[:, 0].astype(np.uint64)).sum(dtype=np.uint64).view(np.int64))
                if held > MEMO_BYTES:
                    known.clear()
                    held = 0
                # Known members: only lesser positions are news, as the positional filter holds for a pair's first common shingle.
                least = np.minimum(rows[:, 1], known[gid]) if gid in known else rows[:, 1].copy()
                if gid in known and (least == known[gid]).all():
                    return
                held += 0 if gid in known else 8 * len(rows) + ENTRY_BYTES
                known[gid] = least
            else:
                gid = h
            out.append(np.column_stack([np.full(len(rows), gid, np.int64), rows]))

        def sent():
            table = np.concatenate(out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1]), pa.array(table[:, 2].astype(np.int32))], names=names)

        open_key, parts, size, split = None, [], 0, False
        for batch in batches:
            h, at = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            salt, rows = at >> 32, np.column_stack([batch.column(1).to_numpy(), at & 0xFFFFFFFF])
            if not len(h):
                continue
            new = np.append(True, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1]) | (rows[1:, 0] != rows[:-1, 0]))
            h, salt, rows = h[new], salt[new], rows[new]
            begin = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])))
            size_of = np.diff(np.append(begin, len(h)))
            for i in np.flatnonzero((size_of > 1) | (begin == 0) | (begin + size_of == len(h)) | (salt[begin] > 0)):
                key, own = (int(h[begin[i]]), int(salt[begin[i]])), rows[begin[i] : begin[i] + size_of[i]]
                if key == open_key:
                    if parts and parts[-1][-1, 0] == own[0, 0]:
                        own = own[1:]
                else:
                    if parts:
                        group(open_key[0], np.concatenate(parts), not split)
                    open_key, parts, size, split = key, [], 0, key[1] > 0
                if len(own):
                    parts.append(own)
                    size += len(own)
                if size > HELD:
                    # Too many to be held together: what is here goes out under the shingle's own name.
                    split = True
                    group(key[0], np.concatenate(parts), False)
                    parts, size = [], 0
            if out:
                yield sent()
        if parts:
            group(open_key[0], np.concatenate(parts), not split)
        if out:
            yield sent()

    salt = F.shiftright("at", 32)
    dealt = prefixes.repartition("h", salt).sortWithinPartitions("h", salt, "node")
    # The same group may be known to several tasks; the least position of each member bounds for all of them.
    return mapped(dealt, run, "gid long, node long, pos int").groupBy("gid", "node").agg(F.min("pos").alias("pos"))


@dataclass
class Block:
    """Members of a group that one task compares. side: each member's block if only pairs across two blocks count. gids: the groups each member is in."""

    gid: int
    node: np.ndarray
    n: np.ndarray
    bits: list[bytes]
    comp: np.ndarray
    side: np.ndarray | None
    gids: list[list[int]]

    def passing(self, percent: int) -> Iterator[tuple[int, int]]:
        """Places (i, j) of pairs of different components, as comp is by then, that pass the length and suffix filters and are this group's to look at; the most similar of each i first."""
        order = np.lexsort((self.node, self.n))
        n, widths = self.n[order].astype(np.int64), np.array([len(self.bits[i]) for i in order])
        side = None if self.side is None else self.side[order]
        groups = [frozenset(self.gids[i]) for i in order]
        maps: dict[int, tuple[int, np.ndarray]] = {}

        def folded(width: int, first: int, last: int) -> np.ndarray:
            """Bitmaps of members first..last, none narrower, folded to this width."""
            if width not in maps or maps[width][0] > first or maps[width][0] + len(maps[width][1]) < last:
                maps[width] = (first, np.array([fold(np.frombuffer(self.bits[i], np.uint64), width) for i in order[first:last]]))
            start, table = maps[width]
            return table[first - start : last - start]

        ends = np.searchsorted(n, 100 * n // percent, "right")
        for i in range(len(n)):
            last = int(ends[i])
            if last <= i + 1:
                continue
            comp = self.comp[order[i:last]]
            js = np.arange(i + 1, last)
            ok = comp[1:] != comp[0]
            if side is not None:
                ok &= side[js] != side[i]
            js = js[ok]
            if not len(js):
                continue
            # Sorted by size, i is the smallest and its bitmap the narrowest.
            table = folded(int(widths[i]), i, last)
            apart = np.bitwise_count(table[0][None, :] ^ table[js - i]).sum(1, dtype=np.int64)
            spare = n[i] + n[js] - 2 * required(n[i], n[js], percent) - apart
            for j in js[np.argsort(-spare, kind="stable")][: int((spare >= 0).sum())]:
                if min(groups[i] & groups[j]) == self.gid:
                    yield int(order[i]), int(order[j])


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """A bitmap of fewer parts, width bytes."""
    while len(bits) * 8 > width:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def links_of(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets (sorted hashes) link: the suffix filter with true counts, then the intersection."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    least = int(required(len(x), len(y), percent))
    if least > len(small):
        return False
    at = np.searchsorted(large, small[:: max(1, len(small) // 8)])
    own = np.arange(0, len(small), max(1, len(small) // 8))
    parts = np.abs(np.diff(np.append(at, len(large))) - np.diff(np.append(own, len(small)))).sum() + at[0]
    if parts > len(x) + len(y) - 2 * least:
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return int((large[at] == small).sum()) >= least


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys, over the ends of batches."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = np.column_stack([batch.column(c).to_numpy() for c in keys])
        begin = np.flatnonzero(np.append(True, (table[1:] != table[:-1]).any(1)))
        for b, e in zip(begin, np.append(begin[1:], len(table)), strict=True):
            key = tuple(table[b])
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(b, e - b))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _few(ids: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def _chained(members: DataFrame, attrs: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b), a < b: each member and the nearest before it that passes. members: (gid, node, pos); attrs: (node, n, bits, k1, k2)."""
    large = written(members.groupBy("gid").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "large")
    dealt = members.join(_few(large), "gid", "left").withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.col("blocks"))).cast("int"))
    dealt = dealt.join(attrs, "node").select("gid", "block", "k1", "k2", "node", "n", "pos", "bits")

    def run(batches):
        before: deque = deque(maxlen=LOOK)
        group = None
        for batch in batches:
            a, b = [], []
            gid, block, node, n, pos = (batch.column(c).to_pylist() for c in ("gid", "block", "node", "n", "pos"))
            for own in zip(gid, block, node, n, pos, batch.column("bits"), strict=True):
                if own[:2] != group:
                    before.clear()
                    group = own[:2]
                own = (*own[2:5], own[5].as_py())
                for other in reversed(before):
                    (x, nx, px, bx), (y, ny, py, by) = own, other
                    least = required(nx, ny, percent)
                    if 1 + min(nx - px - 1, ny - py - 1) >= least and apart(bx, by) <= nx + ny - 2 * least:
                        a.append(min(x, y))
                        b.append(max(x, y))
                        break
                before.append(own)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return mapped(dealt.repartition("gid", "block").sortWithinPartitions("gid", "block", "k1", "k2", "node"), run, "a long, b long").distinct()


def apart(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ, the wider one folded."""
    if len(x) == len(y):
        return (int.from_bytes(x) ^ int.from_bytes(y)).bit_count()
    width = min(len(x), len(y))
    x, y = (fold(np.frombuffer(z, np.uint64), width) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _with_sets(rows: DataFrame, texts: DataFrame, reps: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """rows (node, ...) with s, the whole set of the node, at least once each, and the written table that it reads. texts: (doc, t, read); reps: (node, doc, read, ...).

    What is asked for goes to the texts, and a set goes from there to where it is
    needed: no set is shuffled but once for each row that needs it.
    """
    # A node's list is as long as the groups that its prefix gives it.
    asked = rows.join(reps.select("node", F.col("doc").alias("asked_doc"), F.col("read").alias("asked_read")), "node")
    asked = written(asked.groupBy("asked_doc", "asked_read").agg(F.collect_list(F.struct(*rows.columns)).alias("asked")), "asked")
    same = (F.col("read") == F.col("asked_read")) & F.col("doc").eqNullSafe(F.col("asked_doc"))
    lists, size = asked.agg(F.count("*"), F.sum(F.length(F.to_json("asked")))).first()
    if (size or 0) <= ASKED_BYTES:
        source = texts.join(F.broadcast(asked), same).select("t", "asked")
    else:
        # Lists too large to be everywhere: their keys leave only the texts that are asked about, and these meet them by a shuffle.
        keys = asked.select("asked_doc", "asked_read")
        wanted = texts.join(F.broadcast(keys) if lists <= BROADCAST_ROWS else keys, same, "left_semi")
        source = wanted.join(asked.hint("merge"), same).select("t", "asked")
    schema = T.StructType([*rows.schema.fields, T.StructField("s", T.BinaryType())])

    def run(batches):
        shingles, seen = Shingles(width), set()
        for batch in chunks(batches):
            for text, lists in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingles(text)
                name = set_name(s) if len(s) else None
                if name is None or name in seen:
                    continue
                # Rows that repeat an id and a text give the same; one of a task is enough.
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(name)
                own = pa.RecordBatch.from_struct_array(lists.values)
                own = own.filter(pc.equal(own.column("node"), name))
                if own.num_rows:
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array([s.tobytes()] * own.num_rows, pa.binary())], names=schema.fieldNames())

    return mapped(source, run, schema), asked


def _verified(pairs: DataFrame, texts: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """A written table of those of the pairs (a, b) of sets that link, by their whole sets."""
    both, asked = _with_sets(pairs.select(F.explode(F.array("a", "b")).alias("node"), "a", "b"), texts, reps, width)

    def compare(batches):
        first = None
        for batch in batches:
            found = []
            for node, a, b, s in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                if first and first[:2] == (a, b):
                    # a's set came first, as a < b; a repeated one changes nothing.
                    if node == b and first[2] is not None:
                        if links_of(first[2], np.frombuffer(s.as_py(), np.uint64), percent):
                            found.append((a, b))
                        first = (a, b, None)
                else:
                    first = (a, b, np.frombuffer(s.as_py(), np.uint64))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    met = both.repartition("a", "b").sortWithinPartitions("a", "b", "node")
    links = written(mapped(met, compare, "a long, b long"), "links")
    remove(asked)
    return links


def _blocks(members: DataFrame) -> DataFrame:
    """Members (gid, node, n, comp) of groups of several components, dealt: with gids, and a row for each pair of blocks (lo, hi) in which a member's block meets another."""
    parts = members.groupBy("gid", "comp").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    # The largest component of each group.
    of = parts.groupBy("gid").agg(F.max(F.struct("rows", "shingles", "comp")).alias("most"), F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"), F.count("*").alias("parts")).where("parts > 1")
    count = lambda rows, shingles: F.greatest(F.ceil(rows / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")
    one = (F.col("rows") <= BLOCK) & (F.col("shingles") <= BLOCK_SHINGLES)
    of = of.select(
        "gid", F.when(~one, F.col("most.comp")).alias("main"), F.when(one, 1).otherwise(count(F.col("rows") - F.col("most.rows"), F.col("shingles") - F.col("most.shingles"))).alias("rest_blocks"),
        F.when(one, 0).otherwise(count(F.col("most.rows"), F.col("most.shingles"))).alias("main_blocks"),
    )
    cut = written(members.join(written(of, "open"), "gid"), "cut")
    gids = cut.groupBy("node").agg(F.collect_set("gid").alias("gids"))
    h, main = F.xxhash64("node"), F.coalesce(F.col("comp") == F.col("main"), F.lit(False))
    cut = cut.withColumn("block", F.when(main, F.col("rest_blocks") + F.pmod(h, F.col("main_blocks"))).otherwise(F.pmod(h, F.col("rest_blocks"))).cast("int"))
    # Blocks of the main component meet those of the rest only.
    others = F.sequence(F.lit(0), F.when(main, F.col("rest_blocks")).otherwise(F.col("rest_blocks") + F.col("main_blocks")) - 1)
    met = cut.join(gids, "node").withColumn("other", F.explode(others))
    return met.select("gid", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "n", "comp", "gids")


def _rest(members: DataFrame, attrs: DataFrame, texts: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """A written table of links (a, b) that join all components which any link joins. members: (gid, node, n, comp)."""
    met = written(_blocks(members), "met")
    keys = ["gid", "lo", "hi"]

    def block(table: pa.Table) -> Block:
        gid, lo, hi = (table.column(c)[0].as_py() for c in keys)
        col = lambda c: table.column(c).to_numpy()
        return Block(gid, col("node"), col("n"), table.column("bits").to_pylist(), col("comp").copy(), None if lo == hi else col("block"), table.column("gids").to_pylist())

    def look(batches):
        for table in _runs(batches, keys):
            b = block(table)
            needed = {k for pair in b.passing(percent) for k in pair}
            if needed:
                yield from table.select([*keys, "block", "node", "n", "comp", "gids", "bits"]).take(pa.array(sorted(needed))).combine_chunks().to_batches()

    schema = "gid long, lo int, hi int, block int, node long, n long, comp long, gids array<long>, bits binary"
    sorted_by = lambda df: df.repartition(*keys).sortWithinPartitions(*keys)
    needed = written(mapped(sorted_by(met.join(attrs.select("node", "bits"), "node")), look, schema), "needed")

    def settle(batches):
        for table in _runs(batches, keys):
            # A set that came twice counts once.
            table = table.take(pa.array(np.unique(table.column("node").to_numpy(), return_index=True)[1]))
            b, found = block(table), []
            s = [np.frombuffer(x, np.uint64) for x in table.column("s").to_pylist()]
            for i, j in b.passing(percent):
                x, y = b.comp[i], b.comp[j]
                if x != y and links_of(s[i], s[j], percent):
                    b.comp[b.comp == x] = y
                    found.append(sorted((int(b.node[i]), int(b.node[j]))))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    whole, asked = _with_sets(needed.select("node", *(c for c in needed.columns if c != "node")), texts, reps, width)
    links = written(mapped(whole.repartition(*keys).sortWithinPartitions(*keys, "node"), settle, "a long, b long"), "links")
    remove(met, needed, asked)
    return links


def _placed(df: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: (doc, n, node) of each row of df, and (node, comp), the component of each set. df: (doc, text)."""
    spark = df.sparkSession
    texts = df.select(F.col("doc").cast("long").alias("doc"), utf8("text").alias("t")).withColumn("read", F.xxhash64("t"))
    sets = written(_sets(texts, width), "shingles")
    counts = spark.sparkContext.broadcast(_summed(sets.where("NOT row")))
    named = sets.where("row AND node IS NOT NULL")
    # Where a set is read: of the row with the smallest id.
    row = F.min(F.struct(F.col("doc").isNull().alias("no"), "doc", "read")).alias("row")
    reps = written(named.groupBy("node").agg(row, *(F.first(c).alias(c) for c in ("n", "bits", "k1", "k2"))).select("node", "row.doc", "row.read", "n", "bits", "k1", "k2"), "reps")
    attrs = reps.select("node", "n", "bits", "k1", "k2")
    members = written(_groups(_prefixes(texts.select("t"), counts, width, percent)), "members")

    links, found, tried, tables = None, None, None, []
    ends = members
    for _ in range(CHAINS):
        pairs = _chained(ends, attrs, percent)
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        new = _verified(pairs, texts, reps, width, percent)
        tables += [pairs, new]
        if new.isEmpty():
            break
        links = new if links is None else links.unionByName(new)
        found = written(components(links), "components")
        tables.append(found)
        # Groups of one block have met whole; in larger ones one member of each component goes on.
        large = members.groupBy("gid").agg(F.count("*").alias("rows")).where(F.col("rows") > BLOCK).select("gid")
        now = members.join(large, "gid", "left_semi").join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        ends = now.groupBy("gid", "comp").agg(F.min("node").alias("node"), F.min_by("pos", "node").alias("pos"))
        ends = written(ends.drop("comp"), "ends")
        tables.append(ends)
        if ends.isEmpty() or ends.count() == ends.select("gid").distinct().count():
            break
    if found is None:
        found = local_frame(spark, [], "node long, comp long")
    grouped = members.drop("pos").join(reps.select("node", "n"), "node").join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    grouped = written(grouped, "members")
    more = _rest(grouped, attrs, texts, reps, width, percent)
    if not more.isEmpty():
        found = written(components(more if links is None else links.unionByName(more)), "components")
        tables.append(found)
    placed = written(reps.select("node").join(found, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), "placed")
    rows = written(sets.where("row").select("doc", "n", "node"), "rows")
    remove(sets, reps, members, grouped, more, *tables)
    return rows, placed


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id), a row for each row of df; ids are whole numbers."""
    rows, placed = _placed(df.select(quoted(id_col).alias("doc"), quoted(text_col).alias("text")), width, percent)
    at = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc").alias("doc")).join(placed, "node")
    least = at.groupBy("comp").agg(F.min("doc").alias("component_id"))
    named = written(placed.join(least, "comp").select("node", "component_id"), "named")
    remove(placed)
    out = rows.join(named, "node", "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """df with one row of each component: that of the smallest id and, if rows with different sets share it, of the least set name; of equal sets under one id the least text, then the least hash of the row.

    Rows without shingles and rows without an id stay. Columns keep their names, whatever they are.
    """
    columns = {c: f"c{k}" for k, c in enumerate(df.columns)}
    own = df.select(*(quoted(c).alias(n) for c, n in columns.items()))
    doc, text = columns[id_col], columns[text_col]
    rows, placed = _placed(own.select(F.col(doc).alias("doc"), F.col(text).alias("text")), width, percent)
    kinds = rows.where("doc IS NOT NULL").groupBy("doc", "node").agg(F.count("*").alias("rows")).join(placed, "node", "left")
    kept = written(kinds.where("node IS NOT NULL").groupBy("comp").agg(F.min(F.struct("doc", "node")).alias("k")).select("k.doc", "k.node", F.lit(True).alias("kept")), "kept")
    # A row without shingles is nobody's copy.
    state = kinds.join(kept, ["doc", "node"], "left").withColumn("stays", F.coalesce("kept", F.col("node").isNull()))
    by_id = state.groupBy("doc").agg(F.sum("rows").alias("rows"), F.sum(F.when(F.col("node").isNull(), F.col("rows")).otherwise(F.col("stays").cast("long"))).alias("left")).where("rows <> left")
    by_id = written(by_id, "others")
    gone, mixed = by_id.where("left = 0").select(F.col("doc").alias("__doc")), by_id.where("left > 0").select(F.col("doc").alias("__doc"))
    remove(placed, rows)
    same = F.col(doc) == F.col("__doc")
    left = own.join(_few(gone), same, "left_anti")
    if not mixed.isEmpty():
        mixed = _few(mixed)
        rest = left.join(mixed, same, "left_semi").withColumn("__t", utf8(text))
        schema = T.StructType([*rest.schema.fields[:-1], T.StructField("__node", T.LongType())])

        def named(batches):
            shingles = Shingles(width)
            for batch in chunks(batches):
                found = [shingles(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([set_name(s) if len(s) else None for s in found], pa.int64())], names=schema.fieldNames())

        rest = mapped(rest, named, schema)
        hashed = [c for c in own.columns if "map<" not in dict(own.dtypes)[c] and "variant" not in dict(own.dtypes)[c]]
        first = Window.partitionBy(doc, "__node").orderBy(text, F.xxhash64(*hashed))
        chosen = rest.join(kept.select(F.col("doc").alias("__doc"), F.col("node").alias("__kept")), same & (F.col("__node") == F.col("__kept")), "left_semi")
        chosen = chosen.withColumn("__row", F.row_number().over(first)).where("__row = 1")
        left = left.join(mixed, same, "left_anti").unionByName(rest.where("__node IS NULL").select(*own.columns)).unionByName(chosen.select(*own.columns))
    return left.select(*(F.col(n).alias(c) for c, n in columns.items()))


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(load(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT r, unnest(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) ELSE [array_to_string(ws, ' ')] END)) AS g
  FROM w WHERE len(ws) > 0
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
common AS (SELECT x.r AS a, y.r AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.r < y.r GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT r AS a, r AS b FROM w UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM w LEFT JOIN n USING (r) JOIN (SELECT reach.a AS r, min(d.doc_id) AS component_id FROM reach JOIN w d ON d.r = reach.b GROUP BY 1) m USING (r)
"""
