"""The registered queries and the pipeline on the small tables."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from folioflow.llm import decontaminate, queries, secrets, toxicity
from test_near_copies import near, shingles

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the small tables")


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage's kept rows, recomputed without the operators' candidate search."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    read = spark.read.parquet(f"{SF}/documents.parquet")
    state, stages = read, dict(corpus_pipeline.STAGES)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, state, SF).write.parquet(f"{tmp_path}/{k}")
        state = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(stages) - 1:
            assert state.columns == read.columns, name
    kept = [{r.doc_id for r in spark.read.parquet(f"{tmp_path}/{k}").select("doc_id").collect()} for k in range(5)]
    model = toxicity.train(read, labels)
    clean = {i for i, r in docs.items() if model.score(*toxicity.summary(model, [toxicity.tokens(r.text.encode())]))[0] < 0.3}
    assert kept[0] == clean
    # near copies: five-word shingle sets of similarity 0.8 or more
    sets = {i: shingles(docs[i].text) for i in clean}
    root = {i: i for i in clean}
    for _ in range(8):
        for i in clean:
            root[i] = min(root[j] for j in clean if i == j or near(sets[i], sets[j]))
    assert kept[1] == {i for i in clean if root[i] == i}
    items = decontaminate.Items([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert kept[2] == {i for i in kept[1] if not items.leaks(docs[i].text.encode())}
    assert kept[3] == kept[2] == kept[4]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    for i, t in texts.items():
        assert not secrets.base_spans(t.encode())
        assert (t == docs[i].text) == (not secrets.base_spans(docs[i].text.encode()) and not secrets.entropy_spans(docs[i].text.encode()))
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(kept[4])


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() >= 0
