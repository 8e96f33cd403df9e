import random

import numpy as np
import pytest

from quillframe.llm import passages, repeats


def brute(texts):
    """1 where a window of 51 words also stands in a different text, or the text of 51 words or more comes twice."""
    words = [(t or "").encode().split() for t in texts]
    windows = [{tuple(w[i : i + 51]) for i in range(len(w) - 50)} for w in words]
    return [
        int(any(j != i and windows[i] & windows[j] and (texts[i] != texts[j] or len(words[i]) > 50) for j in range(len(texts))))
        for i in range(len(texts))
    ]


def texts_with_passages(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 6)))
    run = lambda n: [word() for _ in range(n)]
    pool = [run(n) for n in (20, 45, 50, 51, 52, 60, 75, 110, 300)]
    texts = []
    for _ in range(90):
        parts = []
        for _ in range(r.randint(1, 4)):
            passage = r.choice(pool)
            start = r.randint(0, 25)
            parts += [run(r.randint(0, 30)), passage[start:] if r.random() < 0.5 else passage]
        texts.append(r.choice([" ", "\n", " \t "]).join(" ".join(p) for p in parts))
    # Repeats within one text are no passage of two; periodic texts have ties everywhere.
    return [*texts, " ".join(["la"] * 400), " ".join(["la", "le"] * 300), " ".join(run(60) * 3), texts[0], texts[0], " ".join(pool[2]), " ".join(pool[2]), " ".join(pool[3]), " ".join(pool[3]), None, "", " "]


@pytest.mark.parametrize(("together", "part", "seed"), [(1 << 20, 1 << 19, 1), (500, 70, 2), (3_000, 60, 3)])
def test_marks_against_brute_force(spark, documents, together, part, seed, monkeypatch):
    monkeypatch.setattr(passages, "TOGETHER", together)
    monkeypatch.setattr(passages, "PART", part)
    texts = texts_with_passages(seed)
    got = {r.doc_id: r.shared_passage for r in repeats.remove_repeats(documents(texts).repartition(5)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_words_are_those_between_white_space():
    data = "ab  c\nde".encode() + "f \x0b".encode() + b"" + b"ab"
    words, text = passages.word_hashes(np.frombuffer(data, np.uint8), np.array([0, 8, 11, 11]))
    assert list(text) == [0, 0, 0, 1, 3] and words[0] == words[4] and len(set(words.tolist())) == 4
