"""Language identification by prediction by partial matching.

Each language has a variable-order byte context tree: how often each byte
followed each context of up to `order` bytes in its training texts. A byte's
code length under frozen statistics is exact (method C): in the longest context
the tree has, count / (total + kinds) if the byte followed it, else the escape
probability kinds / (total + kinds) times what the next shorter context says,
down to a uniform byte. The language whose tree codes a text shortest wins.

Texts are read as words: ASCII letters in lower case and all bytes from x80 on;
everything else separates. Each word is coded after a separator and closed by
one, and contexts don't reach across a separator, so a word's code length is a
property of the word and is remembered by it.

Only trained on rows that the caller passes; the sample is bounded: rows whose id's
xxhash64 lies below a bound that about `train_rows` rows of the language pass, all
of them where there are fewer. Any number of languages is learned; trees on the
driver and in the workers grow with it. A null id's rows share one hash.

Null texts and texts without a letter: `und`, score 0. So are all texts where no
language could be learned. Null languages train nothing. Ties go to the language
first in code point order. Empty tables give empty results, repeated rows repeat
theirs; a very long text is coded whole, word by word.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ENTRY_BYTES, Memo, chunks, held_out, load, per_text, quoted, utf8

#: Bytes of the longest context.
ORDER = 4
#: Training texts of each language, about: those with the smallest hashes of their ids.
TRAIN_ROWS = 800
_SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A separator in the trees.
_EDGE = 32


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_SPLIT).split()


def _grams(words: list[bytes], order: int) -> list[np.ndarray]:
    """For k = 0..order: each coded byte with its k bytes of context as one number, -1 where the context leaves the word."""
    flat = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.int64)
    coded = np.arange(1, len(flat))
    start = np.maximum.accumulate(np.where(flat == _EDGE, np.arange(len(flat)), 0))[:-1]
    value, out = flat[1:].copy(), []
    for k in range(order + 1):
        if k:
            at = coded - k
            value = np.where(at >= start, value + (flat[np.maximum(at, 0)] << (8 * k)), -1)
        out.append(value)
    return out


def count_grams(words: dict[bytes, int], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For k = 0..order: the numbers that occur, sorted, and how often. words: each word's count."""
    keys = list(words)
    weight = np.repeat(np.fromiter(words.values(), np.int64, len(words)), [len(w) + 1 for w in keys])
    out = []
    for value in _grams(keys, order):
        seen = value >= 0
        at, inverse = np.unique(value[seen], return_inverse=True)
        out.append((at, np.bincount(inverse, weight[seen], len(at)).astype(np.int64)))
    return out


class Tree:
    """Frozen statistics of one language as code lengths in bits."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]):
        self.levels = []
        for keys, n in counts:
            contexts, inverse = np.unique(keys >> 8, return_inverse=True)
            total, kinds = np.bincount(inverse, n), np.bincount(inverse)
            bits = np.log2((total + kinds)[inverse]) - np.log2(n)
            self.levels.append((keys, bits, contexts, np.log2(total + kinds) - np.log2(kinds)))

    def bits(self, grams: list[np.ndarray]) -> np.ndarray:
        """The code length of each coded byte; grams: of _grams()."""
        out = np.zeros(len(grams[0]))
        left = np.arange(len(out))
        for k in range(len(self.levels) - 1, -1, -1):
            keys, bits, contexts, escape = self.levels[k]
            value = grams[k][left]
            if not len(keys) or not len(left):
                continue
            at = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
            found = keys[at] == value
            out[left[found]] += bits[at[found]]
            context = value >> 8
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            escaped = ~found & (contexts[at] == context) & (value >= 0)
            out[left[escaped]] += escape[at[escaped]]
            left = left[~found]
        out[left] += 8.0
        return out


def train(df: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, train_rows: int = TRAIN_ROWS) -> dict[str, Tree]:
    """A tree for each language of df. Words are counted in the tasks and summed by word; the driver gets one row for each word of the sample."""
    known = df.where(quoted(lang_col).isNotNull() & quoted(text_col).isNotNull()).select(quoted(lang_col).cast("string").alias("l"), quoted(id_col).alias("i"), utf8(text_col).alias("t"))
    rows = {r.l: r.n for r in known.groupBy("l").agg(F.count("*").alias("n")).collect()}
    bounds = [(lang, min((1 << 63) - 1, -(1 << 63) + (1 << 64) * train_rows // n)) for lang, n in rows.items()]
    of = df.sparkSession.createDataFrame(bounds, "b string, bound long")
    # Before the texts are read: the join has one small row for each language.
    texts = known.join(of, F.col("l") == F.col("b")).where(F.xxhash64(F.col("i").cast("string")) <= F.col("bound")).select("l", "t")
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])

    def run(batches):
        counts: dict[str, dict[bytes, int]] = {}
        for batch in chunks(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = counts.setdefault(lang, {})
                for w in words_of(text):
                    own[w] = own.get(w, 0) + 1
        for lang, own in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())], names=schema.fieldNames())

    found: dict[str, dict[bytes, int]] = {}
    for batch in texts.mapInArrow(run, schema).groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow().to_batches():
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found.setdefault(lang, {})[word] = n
    return {lang: Tree(count_grams(dict(sorted(own.items())), order)) for lang, own in sorted(found.items()) if own}


def identify(df: DataFrame, trees: dict[str, Tree], id_cols: list, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """The id columns, lang_pred, score: the share of the winner if each language's probability is 2 to the power of minus its bits."""
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def make():
        names, models = list(shared.value), list(shared.value.values())
        memory = Memo(ENTRY_BYTES + 8 * len(names))
        memo = memory.known
        table = np.zeros((0, len(names)))

        def rows(words: list[list[bytes]]) -> np.ndarray:
            nonlocal table
            if not memory.trim():
                table = table[:0]
            new = list(set(chain.from_iterable(words)).difference(memo))
            if new:
                grams = _grams(new, order)
                ends = np.cumsum([len(w) + 1 for w in new])
                bits = np.stack([np.add.reduceat(m.bits(grams), np.append(0, ends[:-1])) for m in models], 1)
                memory.took(new)
                memo.update(zip(new, range(len(table), len(table) + len(new)), strict=True))
                table = np.concatenate([table, bits])
            return table

        def work(texts: list[bytes | None]) -> list[pa.Array]:
            words = [words_of(t) if t and models else [] for t in texts]
            bits = rows(words)
            found, scores = [], []
            for text, own in zip(texts, words, strict=True):
                if not own or not (any(b"a"[0] <= b <= b"z"[0] for b in own[0]) or any(map(str.isalpha, text.decode("utf-8", "replace")))):
                    found.append("und")
                    scores.append(0.0)
                    continue
                at = np.fromiter(map(memo.__getitem__, own), np.int64, len(own))
                total = bits[at].sum(0)
                best = int(total.argmin())
                found.append(names[best])
                scores.append(1 / math.fsum(2.0 ** max(-1000.0, total[best] - x) for x in total.tolist()))
            return [pa.array(found, pa.string()), pa.array(scores, pa.float64())]

        return work

    return per_text(df, id_cols, text_col, make, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def op5_language(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    trees = train(docs.where(~held_out()))
    return identify(docs.withColumn("held_out", held_out()), trees, ["doc_id", "held_out"])
