import random

import numpy as np
import pytest

from quillframe.llm import toxicity
from quillframe.llm.boosting import BoostedTrees, Isotonic


def corpus(spark, n=600, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 3
        text = [r.choice(words) for _ in range(r.randint(20, 60))]
        if toxic:
            for _ in range(3):
                text.insert(r.randrange(len(text)), r.choice(["zorgel" + r.choice(["a", "it", "ung"]), "idiot"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    documents, labels = corpus(spark)
    model = toxicity.fit(toxicity.training_rows(documents, labels))
    rows = toxicity.score(documents, model).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 80 and sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    assert any(g.startswith("^zorg") for g in model.featuriser.lexicon)


def test_held_out_rows_are_never_learned_from(spark):
    documents, labels = corpus(spark, 200)
    import zlib

    ids = {r.doc_id for r in toxicity.training_rows(documents, labels).collect()}
    assert ids and all(zlib.crc32(str(i).encode()) % 5 for i in ids)
    assert {r.doc_id: r.held_out for r in toxicity.score(documents, toxicity.fit(toxicity.training_rows(documents, labels))).collect()} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)}


def test_bound_on_training_rows(spark):
    documents, labels = corpus(spark, 600)
    assert toxicity.training_rows(documents, labels, max_rows=100).count() < 180


def test_odd_input(spark, documents, odd_texts):
    _, labels = corpus(spark, 60)
    docs = documents(odd_texts)
    empty = docs.limit(0)
    for rows in (docs, empty):
        model = toxicity.fit(toxicity.training_rows(rows, labels.limit(0)))
        out = toxicity.score(rows, model)
        assert out.count() == rows.count() and all(r.score < 0.5 and r.predicted == 0 for r in out.collect())
    kept = toxicity.filter_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_obfuscated_and_addressed():
    f = toxicity.Featuriser({"=zorgel": 3.0})
    at = toxicity.NAMES.index
    assert f("you are an 1d10t")[at("obfuscated_hits")] == 1 and f("z0rgel here")[at("obfuscated_hits")] == 1 and f("i d i o t now")[at("obfuscated_hits")] == 1
    assert f("you idiot")[at("near_second_person")] > 0 and f("the idiot")[at("near_second_person")] == 0
    assert f("") == [0.0] * len(toxicity.NAMES) == f(None)


def test_boosted_trees_and_isotonic():
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = BoostedTrees(trees=40).fit(x[:1500], y[:1500])
    assert ((model.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    iso = Isotonic().fit(model.margin(x[:1500]), y[:1500])
    line = iso(np.linspace(-5, 5, 50))
    assert (np.diff(line) >= 0).all() and 0 < line[0] < line[-1] < 1
    assert BoostedTrees().fit(np.zeros((0, 3)), np.zeros(0)).probability(np.zeros((2, 3))) == pytest.approx(0.5)


def test_equal_texts_take_the_toxic_label_and_few_rows_calibrate(spark):
    docs = spark.createDataFrame([(i, ["you idiot", "nice day"][i % 2]) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, toxic int")
    rows = {r.text: r.toxic for r in toxicity.training_rows(docs, labels).collect()}
    assert rows == {"you idiot": 1, "nice day": 0}
    few = spark.createDataFrame([(i, f"you idiot number{i}" if i % 2 else f"a nice day number{i}", i % 2) for i in range(60)], "doc_id long, text string, toxic int")
    model = toxicity.fit(few)
    a, b = model.score(["you idiot", "a nice day"])
    assert a > b and len(model.calibration.x) > 1
