import os
from collections import defaultdict

import pytest

from quillframe.llm import packing, pii, queries, simhash
from quillframe.llm.common import materialise

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture
def folder(spark, data, tmp_path):
    for name in ("documents", "labels"):
        os.symlink(f"{data}/{name}.parquet", tmp_path / f"{name}.parquet")
    return str(tmp_path)


def test_stages_keep_columns_and_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, folder), "test")
        assert docs.columns == columns, name
        counts.append(docs.count())
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= ids
        if name == "near_dedup":
            fps = [simhash.fingerprint(r.text) for r in docs.collect()]
            assert all(bin(a ^ b).count("1") > 2 for i, a in enumerate(fps) for b in fps[i + 1 :])
        if name == "pii":
            assert not any(pii.base_spans(r.text or "") for r in docs.collect())
    assert counts[0] > counts[1] == counts[2] > counts[3] == counts[4]


def test_run_is_the_stages_in_turn(spark, folder):
    rows = pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, folder), "test")
    texts = {r.doc_id: r.text for r in docs.collect()}
    encoder, held = packing.default_encoder(), defaultdict(int)
    for r in rows:
        held[r.doc_id] += r.length
    assert held == {i: len(encoder(t or "")) + 1 for i, t in texts.items()}


def test_every_operator_is_registered():
    numbers = {int(n[2:].split("_")[0]) for n in queries.QUERIES}
    assert numbers == set(range(1, 11)) and len(queries.QUERIES) == 10
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "pii", "packing"]
