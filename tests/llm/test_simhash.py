import random
import re

import numpy as np
import pytest
import xxhash

from quillframe.llm import simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids):
    root = {f: f for f in set(fps)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = sorted(root)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if bin(a ^ b).count("1") <= 2:
                root[find(b)] = find(a)
    least = {}
    for f, i in zip(fps, ids):
        r = find(f)
        least[r] = min(i, least.get(r, i))
    return [least[find(f)] for f in fps]


def test_masks_cover_every_pair():
    for i in range(64):
        for j in range(64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in simhash.masks())


def test_fingerprints(odd_texts):
    r = random.Random(2)
    for t in [*odd_texts[:8], odd_texts[-1], *("".join(r.choice("Ab É\tc\x0b\x1c") for _ in range(r.randint(0, 40))) for _ in range(300))]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


@pytest.mark.parametrize("large", [2, 24])
def test_components(spark, large, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE_BUCKET", large)
    r = np.random.default_rng(3)
    fps = []
    for centre in r.integers(0, 1 << 63, 12):
        f = int(centre)
        for _ in range(int(r.integers(1, 25))):  # a walk of one or two bits at a time: long chains
            for b in r.choice(64, int(r.integers(1, 4)), replace=False):
                f ^= 1 << int(b)
            fps.append(f)
    hub = int(r.integers(0, 1 << 63))
    fps += [hub ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)] + fps[:5]
    rows = [(i * 3, simhash._signed(f)) for i, f in enumerate(fps)]
    got = {x.fp: x.component_id for x in simhash.classes(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    want = brute_components(fps, [i for i, _ in rows])
    assert [got[f] for _, f in rows] == want


def test_documents(spark, documents, odd_texts):
    base = "one two three four five six seven eight nine ten eleven twelve " * 20
    texts = [*odd_texts, base, base, base + "thirteen", "nothing like it at all, really and truly different words here"]
    out = {r.doc_id: r for r in simhash.components(documents(texts)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [out[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [out[i].component_id for i in range(len(texts))] == brute_components(fps, list(range(len(texts))))
    kept = simhash.keep_one(documents(texts))
    assert kept.columns == documents(texts).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_components(fps, list(range(len(texts))))))


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "x y z w"), (None, "x y z w")], "doc_id long, text string")
    assert simhash.components(df).count() == 5
    kept = simhash.keep_one(df).collect()
    assert sorted((r.text, r.doc_id) for r in kept) == [("a b c d", 1), ("x y z w", None)]
    assert simhash.components(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0
