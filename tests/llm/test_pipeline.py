"""The stages, each against brute force on what the stage before it kept."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reconlake.llm import decontaminate, quality
from reconlake.llm.tokens import VOCABULARY, Encoder

from .test_operators import brute_hits


@pytest.fixture(scope="module")
def folder(spark, odd_docs, odd_rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    odd_docs.write.parquet(f"{path}/documents.parquet")
    item = " ".join(odd_rows[3][1].split()[20:40])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, folder)
    enc = Encoder(open(VOCABULARY, "rb").read())
    want = [r.doc_id for r in docs.collect() if quality.signals(r.text, r.lang, enc, quality.BANDS)[-1]]
    assert len(want) > 20
    assert sorted(str(r.doc_id) for r in good.collect()) == sorted(map(str, want)) and good.columns == docs.columns
    unique = stages["SimHash near-dedup"](spark, docs, folder)
    kept = [r.doc_id for r in unique.collect()]
    assert 100 in kept and 101 not in kept and set(range(30)) <= set(kept) and unique.columns == docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = stages["benchmark decontamination"](spark, docs, folder)
    want = [r.doc_id for r in docs.collect() if brute_hits(items, r.text, decontaminate.WINDOW)[1] == 0]
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(map(str, want)) and 3 not in want
    mixed = stages["mixing to target weights"](spark, docs, folder)
    assert mixed.columns == docs.columns and 0 < mixed.count() < docs.count()
    ids = {i for r in stages["token output"](spark, docs, folder).collect() for i in r.doc_ids}
    assert ids == {r.doc_id for r in docs.where(F.length("text") > 0).collect()}


def test_stages_on_empty_tables_and_run(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
    assert corpus_pipeline.run(spark, folder).select(F.sum("n_sequences")).first()[0] > 0
