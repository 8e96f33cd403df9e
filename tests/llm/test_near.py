import random

import numpy as np
import pytest

from quillframe.llm import near, simhash

pipeline = pytest.importorskip("corpus_pipeline")


def brute_kept(texts):
    def cut(t):
        words = (t or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, root = [cut(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [i for i in range(len(texts)) if find(i) == i]


def edited(r, words, n):
    words = list(words)
    for i in r.sample(range(len(words)), n):
        words[i] = f"new{r.random()}"
    return words


@pytest.mark.parametrize("small, pairs, part, edges", [(8, 100, 1024, 500_000), (1, 0, 2, 500_000), (2, 100, 3, 20)])
def test_components_are_those_of_all_pairs(spark, documents, small, pairs, part, edges, monkeypatch):
    for name, value in (("SMALL", small), ("PAIRS", pairs), ("PART", part), ("TASK_PAIRS", 5)):
        monkeypatch.setattr(near, name, value)
    monkeypatch.setattr(simhash, "LOCAL_EDGES", edges)
    r = random.Random(6)
    texts = [None, "", " \n", "one two", "One  TWO", "one two three"]
    for _ in range(12):
        words = [f"w{r.randint(0, 5000)}" for _ in range(r.randint(8, 300))]
        texts.append(" ".join(words))
        for _ in range(r.randint(0, 12)):  # a walk, and steps off it: chains and pairs on both sides of 0.8
            words = edited(r, words, r.randint(0, max(1, len(words) // 40)))
            texts.append(" ".join(words if r.random() < 0.5 else edited(r, words, len(words) // 25)))
    assert sorted(x.doc_id for x in near.keep_one(documents(texts)).collect()) == brute_kept(texts)


def test_stage_drops_near_copies_beyond_two_bits(spark, documents):
    r = random.Random(8)
    texts, pairs = [], 0
    for _ in range(20):
        words = [f"w{r.randint(0, 5000)}" for _ in range(200)]
        texts += [" ".join(words), " ".join(edited(r, words, 4))]
        pairs += bin(simhash.fingerprint(texts[-1]) ^ simhash.fingerprint(texts[-2])).count("1") > 2
    docs = documents(texts)
    out = pipeline.near_dedup_stage(spark, docs, "")
    assert pairs > 10 and out.columns == docs.columns
    assert sorted(x.doc_id for x in out.collect()) == brute_kept(texts) == list(range(0, 40, 2))


def test_repeats_null_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "x y z w"), (None, "x y z w")], "doc_id long, text string")
    assert sorted((r.text, r.doc_id) for r in near.keep_one(df).collect()) == [("a b c d", 1), ("x y z w", None)]
    assert near.keep_one(df.limit(0)).count() == 0


def test_stage_keeps_to_fingerprints_and_similarity(spark, documents):
    r = random.Random(9)
    again, one, two = ([f"w{r.randint(0, 5000)}" for _ in range(n)] for n in (61, 40, 40))
    a, b, c = again * 201 + one, again * 201 + two, again + two
    texts = [" ".join(x) for x in (a, b, c)]
    # By sets only b and c are near copies, by fingerprints only a and b.
    assert brute_kept(texts) == [0, 1]
    fps = [simhash.fingerprint(t) for t in texts]
    assert bin(fps[0] ^ fps[1]).count("1") <= 2 and min(bin(fps[i] ^ fps[2]).count("1") for i in (0, 1)) > 2
    assert [x.doc_id for x in pipeline.near_dedup_stage(spark, documents(texts), "").collect()] == [0]
    assert sorted(x.doc_id for x in pipeline.near_dedup_stage(spark, documents([texts[2], texts[0], "", texts[1], "other"]), "").collect()) == [0, 2, 4]


def test_sets_of_a_great_group_that_are_no_near_copies_do_not_meet(spark, documents, monkeypatch):
    r = random.Random(10)
    words = [f"w{r.randint(0, 5000)}" for _ in range(150)]
    texts = [" ".join(edited(r, words, r.choice([1, 3, 3, 3, 4]))) for _ in range(150)]
    counts, similar = [], near.similar

    def counted(pairs, sketches):
        counts.append(pairs.count())
        return similar(pairs, sketches)

    monkeypatch.setattr(near, "similar", counted)
    assert sorted(x.doc_id for x in near.keep_one(documents(texts)).collect()) == brute_kept(texts)
    assert sum(counts) < 5 * len(texts)


def test_no_more_parities_than_shingles_differ():
    r = np.random.default_rng(11)
    least = near.minima(np.array([], np.uint32))
    for n in (0, 1, 2, 30, 1000, 5000):
        a, b = (np.unique(r.integers(0, 3 * n + 1, n, np.uint32)) for _ in range(2))
        x, y = (np.unpackbits(near.sketch(least, s).view(np.uint8)) for s in (a, b))
        differ, most = int((x != y).sum()), len(np.setxor1d(a, b))
        assert differ <= most and differ % 2 == most % 2 and len(x) == near.PLANES * near.LONGS * 64 + near.PARITIES
