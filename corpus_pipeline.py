"""Documents to training tokens: quality rules, near-duplicate removal, secret redaction, source mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of docs, whatever further ones there are and however they are named; the last
returns doc_id, n_tokens and ids. An empty table gives an empty one at every stage.
Each stage's docstring says what it does with nulls, empty texts and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewake.llm import bpe, mixing, ngram_join, quality, secrets
from framewake.llm.common import load, quoted, remove, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose n-grams look like the trusted ones'. Null, empty and short texts go; of repeated rows all stay or go; a null id is trusted by nobody."""
    row = F.struct(*(quoted(c).alias(f"c{k}") for k, c in enumerate(docs.columns))).alias("__row")
    scored = quality.score_quality(docs, quality.trusted_rows(spark, sf_dir), keep=[row])
    return scored.where("kept").select(*(F.col(f"__row.c{k}").alias(c) for k, c in enumerate(docs.columns)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of near copies; of repeated rows one. Texts without words and rows without an id stay; different texts of one id are judged each by itself."""
    return ngram_join.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced. Null and empty texts and repeated rows stay as they are."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. A null source is one of its own, texts without words weigh nothing, rows that repeat an id are taken alike."""
    return mixing.mix(docs, shard_col=None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, a row for each; null and empty texts have none."""
    coded = bpe.encode_documents(docs, bpe.word_vocabulary())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", keep_quality), ("near_copies", drop_near_copies), ("secrets", redact_secrets), ("mixing", mix_sources), ("encoding", encode)]

#: SQL can express neither the mixing draw nor byte-pair merges; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            remove(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
