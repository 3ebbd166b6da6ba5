"""The pipeline against its operators' plain forms."""

import pytest

import corpus_pipeline as cp
from barloom.llm import secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in cp.STAGES[:-1]:
        docs = cp.common.stored(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def test_stages_have_the_columns_of_documents(kept):
    assert all(set(d.columns) == set(kept[0].columns) for d in kept)


def test_quality_rejects_mostly_bad_text(spark, kept):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in kept[1].select("doc_id").collect()}
    good, bad = [k for k, q in labels.items() if q == 1], [k for k, q in labels.items() if q == 0]
    assert sum(k in left for k in good) > 0.95 * len(good) and sum(k in left for k in bad) < 0.5 * len(bad)


def test_one_of_each_group(kept):
    from test_ngram_join import brute

    rows = [(r.doc_id, r.text) for r in kept[1].select("doc_id", "text").collect()]
    _, comp = brute(rows)
    assert {r.doc_id for r in kept[2].collect()} == {k for (k, _), c in zip(rows, comp, strict=True) if k == c}


def test_secrets_are_gone_and_all_documents_stay(kept):
    before = {r.doc_id: r.text for r in kept[2].collect()}
    for r in kept[3].collect():
        assert not secrets.base_spans(r.text) and r.n_chars == len(r.text)
        if not secrets.base_spans(before[r.doc_id]) and "[secret]" not in r.text:
            assert r.text == before.pop(r.doc_id)
        else:
            before.pop(r.doc_id)
    assert not before


def test_mixture_keeps_every_document(kept):
    a, b = kept[3].groupBy("doc_id").count(), kept[4].groupBy("doc_id").count()
    assert {r.doc_id for r in a.collect()} == {r.doc_id for r in b.collect()}
    assert max(r["count"] for r in b.collect()) <= 2


def test_packing_takes_all_copies(spark, kept):
    got = cp.STAGES[-1][1](spark, kept[4], SF).toPandas()
    assert (got.piece == 0).sum() == kept[4].count()
    assert got.groupby("sequence_id").length.sum().max() <= 2048


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = out if set(out.columns) == set(docs.columns) else docs
