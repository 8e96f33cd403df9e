import pickle
import random

import numpy as np
import pyarrow as pa
import pytest

from quillframe.llm import sentencepieces


@pytest.fixture(scope="module")
def model():
    return sentencepieces.default_model().load()


def test_ids_and_texts_are_the_library_s(model, odd_texts):
    r = random.Random(2)
    texts = odd_texts + ["  a  b ", "\n\t x", "中文字符 😀😀", "a" * 3000, "ab" * 500 + " " * 300, "▁x▁▁y", "<s></s><0x0A>", "\0"]
    texts += ["".join(chr(r.choice([32, 97, 98, 101, 116, 0x2581, 0x4E2D, 0x1F600, 10, 0xE9, 0x3B1])) for _ in range(r.randint(0, 80))) for _ in range(800)]
    texts += ["".join(chr(r.randint(0x20, 0x2FFF)) for _ in range(300)) for _ in range(20)]  # more characters than a byte tells apart
    got = model.encode(texts)
    assert got == [model.sp.encode(t or "") for t in texts]
    assert [model.decode(i) for i in got] == [model.sp.decode(i) for i in got]


def test_few_and_many_words_at_once(model, monkeypatch):
    texts = [" ".join(f"word{i * j}" for j in range(50)) for i in range(60)]
    want = [model.sp.encode(t) for t in texts]
    for chars, kept in ((10, 5), (300_000, 200_000)):
        monkeypatch.setattr(sentencepieces, "INDEX_CHARS", chars)
        monkeypatch.setattr(sentencepieces, "REMEMBERED", kept)
        model.memory.clear()
        assert model.encode(texts) == want


def test_round_trip(spark, documents, odd_texts, model):
    docs = documents(odd_texts)
    rows = {r.doc_id: r for r in sentencepieces.encode_checked(docs, sentencepieces.default_model()).collect()}
    assert [rows[i].ids for i in range(len(odd_texts))] == [model.sp.encode(t or "") for t in odd_texts]
    assert all(rows[i].round_trip and rows[i].n_ids == len(rows[i].ids) for i in range(len(odd_texts)))
    back = sentencepieces.decode(sentencepieces.encode(docs, sentencepieces.default_model()), sentencepieces.default_model())
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(odd_texts)}
    assert sentencepieces.encode_checked(docs.limit(0), sentencepieces.default_model()).count() == 0


def test_tasks_of_a_process_share_what_is_remembered(model):
    first, second = (pickle.loads(pickle.dumps(model)) for _ in range(2))
    first.encode(["quite qzx words"])
    assert second.memory["▁qzx".encode()] and second.encode(["qzx"]) == [model.sp.encode("qzx")]


def test_long_words_do_not_fill_the_memory(model, monkeypatch):
    monkeypatch.setattr(sentencepieces, "REMEMBERED_BYTES", 20_000)
    own = pickle.loads(pickle.dumps(model)).load()
    for k in range(30):
        word = f"{k}x" * 1_000
        assert own.encode([word, "short"]) == [model.sp.encode(word), model.sp.encode("short")]
        assert sum(len(w) + len(i) for w, i in own.memory.items()) <= 20_000


def test_ids_in_one_array(model, odd_texts):
    texts = [t or "" for t in odd_texts] + ["", "▁x", "a▁", "▁", " ", "  ", "\ufffd 中", "😀", "x\ny z", "\0", ""]
    data = [t.encode() for t in texts]
    bounds, ids = model.encode_flat(data)
    want = [model.sp.encode(t) for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    assert model.gives_back(data, bounds, ids) == [model.sp.decode(i) == t for i, t in zip(want, texts)]
    assert model.gives_back([b"other"] * len(data), bounds, ids) == [False] * len(data)
    for none in ([], [b""], [b"", b""]):
        bounds, ids = model.encode_flat(none)
        assert bounds.tolist() == [0] * (len(none) + 1) and not len(ids)
        assert model.gives_back(none, bounds, ids) == [True] * len(none)


def test_order_of_suffixes_with_ties():
    r = random.Random(5)
    for n in (1, 2, 500):
        keys = [np.array([r.randint(0, 3) for _ in range(n)], np.uint64) for _ in range(4)]
        order = sentencepieces._sorted_by(keys).tolist()
        rows = list(zip(*(k.tolist() for k in keys)))
        assert sorted(order) == list(range(n)) and [rows[i] for i in order] == sorted(rows)


def test_slices_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(sentencepieces, "SLICE_ROWS", 3)
    monkeypatch.setattr(sentencepieces, "SLICE_BYTES", 10)
    texts = ["a" * 25, None, "", "é" * 5, "b", "c", "d", "e", "f" * 9, "g"]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(texts[:n], pa.string())], names=["doc_id", "text"]) for n in (10, 0, 1)]
    got = [(i.to_pylist(), t) for i, t in sentencepieces._slices(batches)]
    assert [i for i, _ in got] == [[0], [1, 2, 3], [4, 5, 6], [7, 8], [9], [0]]
    assert [x.decode() for _, t in got[:-1] for x in t] == [t or "" for t in texts]
