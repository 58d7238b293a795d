"""Each stage of the pipeline against a plain version, on its own input."""

import pytest

from talweg.llm import neardup, toxicity
from talweg.llm.common import table

from .cases import near_components, removed_lines, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    out = [docs.toPandas()]
    from talweg.llm.common import materialise

    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialise(stage(spark, docs, SF))
        out.append(docs.toPandas())
    return out


def test_toxic_documents_go(spark, steps):
    import corpus_pipeline  # noqa: F401

    docs = table(spark, SF, "documents")
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    before = steps[0]
    scores = toxicity.text_scores(model, list(before.text))
    assert set(steps[1].doc_id) == set(before.doc_id[scores < 0.5])
    assert list(steps[1].columns) == list(before.columns)


def test_lines(steps):
    before, after = steps[1], steps[2].set_index("doc_id")
    want = removed_lines(list(zip(before.doc_id, before.text)))
    for i, t in zip(before.doc_id, before.text):
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get(i, ()))
        if i in after.index:
            assert after.text[i] == left
        else:
            assert want.get(i) and not words(left)


def test_one_of_each_group(steps):
    before, after = steps[2], steps[3]
    want = near_components(list(zip(before.doc_id, before.text)), neardup.NearDupConfig().words)
    assert set(after.doc_id) == {i for i, c in want.items() if i == c}


def test_mix_and_ids(steps):
    mixed, ids = steps[4], steps[5]
    assert list(mixed.columns) == list(steps[3].columns)
    assert set(mixed.doc_id) <= set(steps[3].doc_id) and mixed.groupby("doc_id").size().max() <= 3
    assert sorted(mixed.doc_id) == sorted(ids.doc_id) and ids.round_trip.all()
