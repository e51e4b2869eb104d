"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target to the raw corpus.

Two multinomials over hashed character n-grams (three code points) are counted
over all documents: one of the trusted rows, one of every row. Character n-grams
stay few however large the corpus is, so the buckets don't fill up and a
threshold means the same at every size. A document's verdict is its mean log
ratio per n-gram against that threshold, so the same document always gets the
same verdict for the same corpus. The target is smoothed by the raw corpus (a
Dirichlet prior of `prior` n-grams), which keeps an n-gram that no trusted row
has from deciding alone.

Besides, some plain counts (words, symbols, repeated lines and windows) reject
what no model is needed for. Words are cut at x20 and x09-x0D.

Null and empty texts: no words, counts 0, base_failed, not kept. Rows are
handled one by one: a repeated row repeats its result (and counts again in the
raw corpus). Trusted ids match every row of that id; null ids match none. With
no trusted row at all the ratio is 0 and the verdict is the base rules' alone.
Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, load, mapped, per_text, quoted, utf8

#: Buckets of the hashed n-grams (a prime): what the driver gathers is two counts for each, whatever the corpus.
BUCKETS = 65521
#: Code points of an n-gram, and the factor of its hash.
WIDTH, FACTOR = 3, 8191
#: n-grams that the raw corpus's distribution adds to the target's counts.
PRIOR = 1000.0
#: The least mean log ratio of a kept document.
THRESHOLD = -0.6
#: Trusted ids that are broadcast at most; more are joined by a shuffle. Every one counts either way.
MAX_BROADCAST = 1_000_000
#: Code points hashed at once.
_PIECE = 1 << 20
_SYMBOLS = b"#*$%&|<>"
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def grams(text: bytes, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """The buckets of a text's n-grams, a piece after another; none if the text is shorter than one."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    for start in range(0, len(points) - WIDTH + 1, _PIECE):
        piece = points[start : start + _PIECE + WIDTH - 1].astype(np.int64)
        n, h = len(piece) - WIDTH + 1, np.int64(0)
        for k in range(WIDTH):
            h = h * FACTOR + piece[k : k + n]
        yield h % buckets


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words in windows of `width` words that the text has twice or more."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[bytes, int] = {}
    key = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    window, size = key[: n - width + 1], len(ids)
    for k in range(1, width):
        if size * len(ids) >= 1 << 62:
            _, window = np.unique(window, return_inverse=True)
            size = int(window.max()) + 1
        window = window * len(ids) + key[k : n - width + 1 + k]
        size *= len(ids)
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(width):
        covered[k : n - width + 1 + k] |= twice
    return int(covered.sum())


def base_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    return (
        len(words),
        len(text.translate(None, _SPACE).decode("utf-8", "replace")),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def gram_counts(df: DataFrame, trusted: str, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """[buckets, 2] counts over all rows: of the trusted ones (a boolean column), of all. Each task sums before it sends."""
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("target", T.LongType()), T.StructField("raw", T.LongType())])

    def run(batches):
        sums = np.zeros((2, buckets), np.int64)
        for batch in chunks(batches):
            of: tuple[list, list] = ([], [])
            for text, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                of[bool(good)].extend(grams(text or b"", buckets))
            for good, found in enumerate(of):
                if found:
                    n = np.bincount(np.concatenate(found), minlength=buckets)
                    sums[1] += n
                    sums[0] += n * good
        at = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], names=schema.fieldNames())

    out = np.zeros((buckets, 2), np.int64)
    sums = mapped(df.select(utf8(text_col).alias("t"), F.col(trusted).alias("g")), run, schema)
    for r in sums.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toArrow().to_batches():
        out[r.column(0).to_numpy()] = np.stack([r.column(1).to_numpy(), r.column(2).to_numpy()], 1)
    return out


def log_ratios(counts: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log of smoothed target probability over raw probability; 0 for what the corpus lacks."""
    target, raw = counts[:, 0].astype(float), counts[:, 1].astype(float)
    n_target, n_raw = target.sum(), raw.sum()
    if not n_target:
        return np.zeros(len(counts))
    with np.errstate(divide="ignore", invalid="ignore"):
        p = raw / n_raw
        return np.where(raw > 0, np.log((target + prior * p) / (n_target + prior) / p), 0.0)


def score_quality(
    df: DataFrame,
    trusted_ids: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    prior: float = PRIOR,
    threshold: float = THRESHOLD,
    max_broadcast: int = MAX_BROADCAST,
    keep: list | None = None,
) -> DataFrame:
    """A row for each row of df: the columns `keep` (the id), the five base counts, base_failed, llr (mean log ratio per n-gram), kept."""
    ids = trusted_ids.select(F.col(trusted_ids.columns[0]).alias("__trusted_id")).where("__trusted_id IS NOT NULL").distinct().withColumn("__good", F.lit(True))
    rows, same = df.select(quoted(id_col).alias("__id"), quoted(text_col).alias("__t")), F.col("__id") == F.col("__trusted_id")
    good = F.coalesce("__good", F.lit(False)).alias("__good")
    if ids.count() <= max_broadcast:
        counts = gram_counts(rows.join(F.broadcast(ids), same, "left").select("__t", good), "__good", "__t", buckets)
    else:
        # Trusted rows meet their ids by a shuffle; the raw corpus is counted without one.
        counts = gram_counts(rows.withColumn("__good", F.lit(False)), "__good", "__t", buckets)
        counts[:, 0] = gram_counts(rows.join(ids.hint("shuffle_hash"), same).select("__t", good), "__good", "__t", buckets)[:, 0]
    ratio = log_ratios(counts, prior)
    shared = df.sparkSession.sparkContext.broadcast(ratio)

    def make():
        weight = shared.value

        def work(texts: list[bytes | None]) -> list[pa.Array]:
            counts, means = [], []
            for text in texts:
                words = (text or b"").split()
                counts.append(base_counts(text or b"", words))
                sums = [(float(weight[g].sum()), len(g)) for g in grams(text or b"", buckets)]
                means.append(sum(x for x, _ in sums) / sum(n for _, n in sums) if sums else 0.0)
            return [*(pa.array([c[i] for c in counts], pa.int64()) for i in range(5)), pa.array(means, pa.float64())]

        return work

    fields = [*(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("llr", T.DoubleType())]
    out = per_text(df, keep or [quoted(id_col)], text_col, make, fields)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def trusted_rows(spark, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    scored = score_quality(load(spark, sf_dir, "documents"), trusted_rows(spark, sf_dir))
    return scored.select("doc_id", *_COUNTS, "base_failed", "kept")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT doc_id, t, r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, list_transform(string_split(t, ''), lambda x: CAST(unicode(x) AS BIGINT)) AS u FROM d),
windows AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT i + k.k) AS n FROM twice, range(0, 3) k(k) GROUP BY r),
grams AS (SELECT r, unnest(list_transform(range(1, len(u) - 1), lambda i: ((u[i] * 8191 + u[i + 1]) * 8191 + u[i + 2]) % 65521)) AS b FROM w WHERE len(u) > 2),
trusted AS (SELECT r FROM d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
counts AS (SELECT b, count(*) AS raw, count(trusted.r) AS target FROM grams LEFT JOIN trusted USING (r) GROUP BY b),
totals AS (SELECT sum(raw) AS n_raw, sum(target) AS n_target FROM counts),
ratios AS (SELECT b, CASE WHEN n_target = 0 THEN 0 ELSE ln((target + 1000.0 * (raw / n_raw)) / (n_target + 1000.0) / (raw / n_raw)) END AS x FROM counts, totals),
means AS (SELECT r, avg(x) AS llr FROM grams JOIN ratios USING (b) GROUP BY r),
base AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words, coalesce(llr, 0) AS llr FROM w LEFT JOIN repeated USING (r) LEFT JOIN means USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND llr >= -0.6 AS kept
FROM base
"""
