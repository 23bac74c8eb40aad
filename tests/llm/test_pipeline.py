"""The pipeline against a plain version of its stages, and its edges."""

import pytest
from test_decontaminate import brute as brute_leaks
from test_jaccard import brute as brute_classes
from test_packing import check as check_packing
from test_secrets import brute as brute_secrets

import corpus_pipeline
from pagequarry.llm import secrets


def apply(spark, docs, folder, upto):
    for name, stage in corpus_pipeline.STAGES[:upto]:
        docs = corpus_pipeline.materialise(stage(spark, docs, folder), "test-stage")
    return docs


def test_stages_against_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = apply(spark, docs, folder, 1)
    assert first.columns == docs.columns
    kept = {r.doc_id: r.text for r in first.collect()}
    lettered = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert kept.keys() <= lettered and len(kept) >= 0.99 * len(lettered)

    second = corpus_pipeline.distinct_texts(spark, first, folder)
    ids = {r.doc_id for r in second.collect()}
    assert second.columns == docs.columns
    assert ids == {c for _, _, c in brute_classes(list(kept.items()))}

    third = corpus_pipeline.materialise(corpus_pipeline.decontaminated(spark, second, folder), "test-stage")
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    names = sorted(ids)
    leaked = {names[d] for d, _ in brute_leaks([kept[n] for n in names], items, max(64, *(len(i.split()) for i in items)))}
    clean = {r.doc_id: r.text for r in third.collect()}
    assert third.columns == docs.columns and clean.keys() == ids - leaked

    fourth = corpus_pipeline.materialise(corpus_pipeline.redacted(spark, third, folder), "test-stage")
    after = {r.doc_id: r for r in fourth.collect()}
    assert fourth.columns == docs.columns and after.keys() == clean.keys()
    for doc_id, row in after.items():
        assert not any(h.value not in ("[SECRET]",) for h in secrets.base_hits(row.text))
        assert row.n_chars == len(row.text)
        if not any(brute_secrets(clean[doc_id])[:3]):
            assert row.text == clean[doc_id]

    check_packing(corpus_pipeline.packed(spark, fourth, folder).collect(), [(d, r.text) for d, r in after.items()], 2048)


@pytest.mark.parametrize("upto", [5])
def test_tricky_documents(spark, tricky, folder, upto):
    columns = tricky.columns
    for k in range(1, upto):
        docs = apply(spark, tricky, folder, k)
        assert docs.columns == columns
    apply(spark, tricky, folder, upto).count()


def test_no_documents(spark, nothing, folder):
    assert apply(spark, nothing, folder, 5).count() == 0


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "packing"]
