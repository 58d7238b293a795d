"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest

from talweg.llm import audio, bpe, html, linededup, mixing, neardup, pii, quality, sharding, toxicity

from .cases import edge_docs, edge_rows, empty_docs

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (4, 1, 0), (5, 1, 0), (None, 0, 1), (10, None, None), (7, 0, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "linededup": lambda s, d: linededup.dedup_lines(d, counts=True),
    "mixing": lambda s, d: mixing.mix(d),
    "neardup": lambda s, d: neardup.near_duplicates(d),
    "quality": lambda s, d: quality.judge(d, labels(s))[0],
    "bpe": lambda s, d: bpe.digests(d, RANKS, public_tokenizers.PATTERN),
    "html": lambda s, d: html.extract(d, "text", "out"),
    "sharding": lambda s, d: sharding.shard_documents(d, 24),
    "toxicity": lambda s, d: toxicity.classify(d, labels(s)),
    "pii": lambda s, d: pii.digests(d),
    "audio": lambda s, d: audio.aligned(d.selectExpr("doc_id as id", "cast(text as binary) as media")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows_keep_their_number(spark, name):
    rows = OPERATORS[name](spark, edge_docs(spark)).collect()
    assert len(rows) == len(edge_rows())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark, empty_docs(spark)).collect() == []


def test_pipeline_stages_keep_the_columns(spark):
    docs = edge_docs(spark)
    for out in (linededup.dedup_lines(docs), neardup.without_near_duplicates(docs), mixing.mixed_documents(docs)):
        assert out.columns == docs.columns
        assert out.schema == docs.schema
        out.collect()
    assert toxicity.score(docs, toxicity.train([], [], 0.1), "p").columns == [*docs.columns, "p"]


def test_null_text_and_null_id(spark):
    near = {(r.doc_id, r.n_shingles): r for r in neardup.near_duplicates(edge_docs(spark)).collect()}
    assert near[1, 0].component_id == 1 and near[1, 0].kept
    assert near[None, 3].component_id is None and near[None, 3].kept
    assert near[11, 5].component_id == 7 and not near[11, 5].kept
    shards = {r.doc_id: r for r in sharding.shard_documents(edge_docs(spark), 24).collect()}
    assert shards[1].size == 8 and shards[1].text_crc32 == 0
