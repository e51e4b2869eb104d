"""The pipeline against a plain version of each stage, on its own input."""

import re

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from framewake.llm import bpe, mixing, quality, secrets
from framewake.storage import written

from .test_operators import ascii_words, brute_components, secret_base

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(written(stage(spark, out[-1], DATA), name))
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:5]) and stages[5].columns == ["doc_id", "n_tokens", "ids"]


def test_quality_keeps_what_it_scores_well(spark, stages):
    scored = quality.score_quality(stages[0], quality.trusted_rows(spark, DATA))
    assert sorted(r.doc_id for r in scored.where("kept").collect()) == sorted(r.doc_id for r in stages[1].collect())


def test_one_of_each_group(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(d for d, (_, c) in brute_components(rows).items() if c == d)


def test_no_secret_is_left(stages):
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[2:4])
    assert set(before) == set(after)
    for d, r in after.items():
        if not any(k < 2 or k == 2 for _, k, _ in secret_base(before[d].text)):
            assert r == before[d] or re.search("://|user|login", before[d].text)
        else:
            assert "[SECRET]" in r.text and not secret_base(r.text)


def test_mix(stages):
    rows = stages[3].collect()
    words = {r.doc_id: len(ascii_words(r.text)) for r in rows}
    order = sorted({r.source for r in rows})
    want = dict(zip(order, mixing.targets([sum(words[r.doc_id] for r in rows if r.source == s) for s in order]), strict=True))
    for s in order:
        assert abs(sum(words[r.doc_id] for r in stages[4].collect() if r.source == s) - want[s]) <= max(words[r.doc_id] for r in rows if r.source == s)


def test_tokens_and_run(spark, stages):
    library = Tokenizer.from_file(bpe.word_vocabulary())
    texts = sorted((r.doc_id, r.text) for r in stages[4].collect())
    got = sorted((r.doc_id, r.n_tokens, tuple(r.ids)) for r in stages[5].collect())
    want = library.encode_batch([t for _, t in texts], add_special_tokens=False)
    assert got == sorted((d, len(e.ids), tuple(e.ids)) for (d, _), e in zip(texts, want, strict=True))
    assert sorted((r.doc_id, r.n_tokens, tuple(r.ids)) for r in pipeline.run(spark, DATA).collect()) == got
    assert secrets.KINDS[:3] == secrets.BASE_KINDS


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and clashing or dotted names go through every stage; nothing but what a stage is for is lost."""
    prose = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").where("lang = 'en' AND n_chars > 800").orderBy("doc_id").limit(8).collect()]
    texts = [None, "", " \n", "short", *prose, prose[0], prose[0] + " token=abcdefgh1234", "a b " * 20_000, prose[1]]
    rows = [(k, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "web", len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, prose[2], None, None, None), (5, prose[3], "en", "web", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, name in enumerate(("a.b", "__id", "__row", "__n", "__size", "shard", "kept", "node", "ids", "spans", "`q`", "text.x", "c0")):
        df = df.withColumn(name, F.lit(k) if k % 2 else F.lit(None).cast("string"))
    passing = df
    for name, stage in pipeline.STAGES:
        out = written(stage(spark, passing, DATA), name)
        if name != "encoding":
            assert out.columns == df.columns, name
        if name == "secrets":
            assert out.count() == passing.count() and out.where("text LIKE '%abcdefgh1234%'").isEmpty()
        if name == "near_copies":
            assert out.where("doc_id IS NULL").count() == passing.where("doc_id IS NULL").count() and 0 < out.count() < passing.count()
            assert out.where("doc_id = 5").count() <= 2
        if name == "encoding":
            assert out.count() == passing.count() and out.where("n_tokens <> size(ids) OR n_tokens IS NULL").isEmpty()
        none = stage(spark, df.limit(0), DATA)
        assert none.count() == 0 and (name == "encoding" or none.columns == df.columns)
        passing = out
    # What no stage before rejects, each takes as it comes.
    for name, stage in pipeline.STAGES[1:]:
        assert stage(spark, df, DATA).count() >= 0
