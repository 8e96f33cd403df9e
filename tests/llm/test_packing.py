import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillframe.llm import packing
from quillframe.llm.packing_plan import SHARES, Knapsack, best_fit, fractional, plan, rounded


def bound(counts, capacity):
    return -(-sum(s * n for s, n in counts.items()) // capacity)


def test_plans_hold_exactly_what_there_is():
    r = random.Random(3)
    for _ in range(80):
        counts = {r.randint(1, 64): r.randint(1, r.choice([1, 5, 500, 10**9])) for _ in range(r.randint(0, 40))}
        held = Counter()
        for config, many in plan(counts, 64):
            assert many > 0 and sum(s * n for s, n in config) <= 64
            for s, n in config:
                held[s] += n * many
        assert held == Counter(counts)


def test_plans_are_near_the_bound():
    r = random.Random(4)
    for n in (300, 5_000, 200_000):
        counts = Counter(min(1023, int(r.expovariate(1 / 350)) + 1) for _ in range(n))
        used = sum(m for _, m in plan(counts, 1024))
        assert used <= bound(counts, 1024) * 1.006 + 2


def test_lp_covers_and_most_sequences_come_from_it():
    counts = {s: 400 for s in range(100, 700, 7)}
    x = fractional(counts, 1024)
    covered = Counter()
    for config, w in x.items():
        for s, n in config:
            covered[s] += n * w
    assert all(covered[s] >= 0.8 * n for s, n in counts.items())
    assert sum(m for _, m in best_fit({3: 10, 5: 1}, 8)) == 6


def test_plans_need_no_more_than_best_fit_and_use_the_lp():
    r = random.Random(9)
    for n in (400, 2_000, 30_000):
        counts = Counter(min(1023, int(r.expovariate(1 / 350)) + 1) for _ in range(n))
        chosen, plain = plan(counts, 1024), best_fit(counts, 1024)
        assert sum(m for _, m in chosen) <= sum(m for _, m in plain)
        x = fractional(counts, 1024)
        assert x and all(sum(s * k for s, k in c) <= 1024 for c in x)
        for share in SHARES:
            placed, rest = rounded(x, counts, 1024, share)
            assert sum(m for _, m in placed) > 0 and all(sum(s * k for s, k in c) == 1024 for c, _ in placed)
            held = Counter(rest)
            for config, many in placed:
                for s, k in config:
                    held[s] += k * many
            assert held == counts


def test_knapsack_against_all_configurations():
    sizes, price = np.array([3, 4, 7, 9]), np.array([2.0, 3.1, 5.0, 7.3])
    best = max(a * 2.0 + b * 3.1 + c * 5.0 + d * 7.3 for a in range(8) for b in range(6) for c in range(4) for d in range(3) if 3 * a + 4 * b + 7 * c + 9 * d <= 23)
    k = Knapsack(sizes, price, 23)
    assert k.value.max() == pytest.approx(best)
    for first in range(4):
        used = k.using(first)
        assert used[first] >= 1 and sum(int(sizes[i]) * n for i, n in used.items()) <= 23
        assert sum(price[i] * n for i, n in used.items()) == pytest.approx(k.value[first])


def test_pieces_of_documents():
    assert packing.pieces_of(1, 4) == [(0, 1)] and packing.pieces_of(4, 4) == [(0, 4)] and packing.pieces_of(9, 4) == [(0, 1), (1, 4), (5, 4)] and packing.pieces_of(8, 4) == [(0, 4), (4, 4)]


def test_fast_ids_are_those_of_the_tokenizers_file():
    fast, slow = packing.default_encoder(), packing.Encoder(packing.tokenizer_path("byte_bpe_50k.json"))
    r = random.Random(5)
    texts = ["", "a<|endoftext|>b", "  \n\n x", "é中😀 it's 1234", " " * 5000, "x" * 3000] + ["".join(r.choice("ab 1'é\n.中😀ſ") for _ in range(r.randint(0, 60))) for _ in range(500)]
    assert [fast(t) for t in texts] == [slow(t) for t in texts]


def test_ids_of_all_documents_are_those_of_the_tokenizers_file(spark, data):
    fast, slow = packing.default_encoder(), packing.Encoder(packing.tokenizer_path("byte_bpe_50k.json"))
    for row in spark.read.parquet(f"{data}/documents.parquet").select("text").toLocalIterator():
        assert fast(row.text) == slow(row.text)


def check(rows, texts, capacity):
    encoder = packing.default_encoder()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*encoder(t or ""), 2], "<u4")
        mine = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in mine] == packing.pieces_of(len(ids), capacity) and [r.piece for r in mine] == list(range(len(mine)))
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing(spark, documents, odd_texts, capacity):
    r = random.Random(6)
    texts = odd_texts[:8] + odd_texts[-1:] + [" ".join(["word"] * r.choice([3, 3, 3, 17, r.randint(1, 40)])) for _ in range(400)]
    rows = packing.pack(documents(texts).repartition(7), capacity=capacity).collect()
    check(rows, texts, capacity)
    total = sum(x.length for x in rows)
    assert len({x.sequence_id for x in rows}) <= -(-total // capacity) * 1.03 + 1


def test_empty_table(spark, documents):
    assert packing.pack(documents(["x"]).limit(0)).count() == 0
