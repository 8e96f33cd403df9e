import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quillframe.llm import repeats


def brute(texts):
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    out = []
    for t in texts:
        cover = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                cover[i] += 1
                cover[i + 400] -= 1
        cut = np.cumsum(cover)[: len(t)] > 0
        data = np.frombuffer(t, np.uint8)
        out.append((len(t), int(cut.sum()), int((np.diff(np.concatenate([[0], cut.astype(int)])) == 1).sum()), hashlib.sha256(data[~cut].tobytes()).hexdigest()))
    return out


def texts_with_repeats(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdef gh") for _ in range(r.randint(300, 3000))) for _ in range(10)]
    out = []
    for _ in range(120):
        parts = []
        for _ in range(r.randint(0, 5)):
            s = r.randint(0, 1500)
            parts += [r.choice(base)[s : s + r.randint(50, 1200)], "" if r.random() < 0.3 else "".join(r.choice("xyz") for _ in range(r.randint(0, 40)))]
        out.append("".join(parts))
    common = "".join(r.choice("klmn") for _ in range(450))
    out += [f"{''.join(r.choice('uvw') for _ in range(300))}{common[: r.choice([390, 399, 400, 401, 450])]}{''.join(r.choice('rst') for _ in range(300))}" for _ in range(20)]
    return [*out, "a" * 3000, None, "", "a" * 399, "ab" * 1000, out[3], "\0" * 900, "é" * 500]


@pytest.mark.parametrize(("large", "stride"), [(2_000, 1 << 18), (3, 1 << 18), (2_000, 700)])
def test_against_brute_force(spark, documents, large, stride, monkeypatch):
    monkeypatch.setattr(repeats, "LARGE_GROUP", large)
    monkeypatch.setattr(repeats, "STRIDE", stride)
    texts = texts_with_repeats(large + stride)
    rows = {r.doc_id: r for r in repeats.remove_repeats(documents(texts)).collect()}
    want = brute([(t or "").encode() for t in texts])
    got = [(rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) for i in range(len(texts))]
    assert got == want


def test_every_string_has_an_anchor_that_its_content_chooses():
    r = np.random.default_rng(1)
    common = r.integers(0, 4, 600, dtype=np.uint8)
    a, b = (np.concatenate([r.integers(0, 4, n, dtype=np.uint8), common, r.integers(0, 4, 300, dtype=np.uint8)]) for n in (10, 777))
    x, y = repeats.anchors(a), repeats.anchors(b)
    shared = {(int(h), int(p) - 10) for h, p in zip(x["anchor"], x["place"])} & {(int(h), int(p) - 777) for h, p in zip(y["anchor"], y["place"])}
    places = sorted(p for _, p in shared)
    # Every string inside the common part has an anchor in it that both texts have, at the same place.
    assert all(any(s <= p <= s + repeats.CONTEXT for p in places) for s in range(600 - repeats.LENGTH + 1))


def test_columns_against_brute_force():
    r = np.random.default_rng(2)
    columns = r.integers(0, 2, (60, 40)).astype(np.uint16)
    found = repeats.repeated_columns(columns, 3, 20, 8)
    for c in range(3, 21):
        seen = Counter(tuple(x) for x in columns[:, c : c + 8])
        assert list(found[:, c - 3]) == [seen[tuple(x)] > 1 for x in columns[:, c : c + 8]]


def test_empty_table(spark, documents):
    assert repeats.remove_repeats(documents(["x"]).limit(0)).count() == 0
