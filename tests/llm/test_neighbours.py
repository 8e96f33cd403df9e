import math

import numpy as np
import pytest

from quillframe.llm import neighbours


def frame(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], None if v is None else [None if x is None else float(x) for x in v], 7) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, row int")


def brute(vectors, q, k):
    d = np.sqrt(((vectors.astype(np.float32).astype(float) - vectors[q].astype(np.float32).astype(float)) ** 2).sum(axis=1))
    d[q] = np.inf
    order = np.lexsort((np.arange(len(d)), d))[:k]
    return [(int(i), float(d[i])) for i in order]


@pytest.mark.parametrize("block", [16_384, 300])
def test_recall_and_exact_scores(spark, block, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 3)
    monkeypatch.setattr(neighbours, "SAMPLE_ROWS", 200)
    r = np.random.default_rng(1)
    vectors = r.normal(size=(2000, 24)) + 3 * r.normal(size=(20, 24))[r.integers(0, 20, 2000)]
    rows = neighbours.nearest(frame(spark, vectors), lambda v: v % 100 == 0).collect()
    hits = 0
    for q in range(0, 2000, 100):
        got = sorted((x for x in rows if x.query_id == q), key=lambda x: x["rank"])
        assert [x["rank"] for x in got] == list(range(1, 11)) and [x.score for x in got] == sorted(x.score for x in got)
        want = dict(brute(vectors, q, 10))
        hits += len(set(want) & {x.vec_id for x in got})
        for x in got:
            if x.vec_id in want:
                assert math.isclose(x.score, want[x.vec_id], rel_tol=1e-12)
    assert hits >= 0.95 * 200


def test_ties_and_repeats_and_few_candidates(spark):
    vectors = [[1, 0], [1, 0], [0, 1], [1, 0]]
    rows = neighbours.nearest(frame(spark, vectors, [0, 5, 7, 5]), lambda v: v % 100 == 0).orderBy("rank").collect()
    assert [(x.vec_id, round(x.score, 6)) for x in rows] == [(5, 0.0), (5, 0.0), (7, 1.414214)]


def test_vectors_that_take_no_part(spark):
    vectors = [[1, 2], None, [0, 0], [float("nan"), 1], [1, None], [float("inf"), 0], [2, 2], [1, 2, 3]]
    rows = neighbours.nearest(frame(spark, vectors, [0, 100, 200, 300, 400, 500, 6, 7]), lambda v: v % 100 == 0).collect()
    assert [(x.query_id, x.vec_id, x.score) for x in rows] == [(0, 6, 1.0)]
    assert neighbours.nearest(frame(spark, [[1, 2]]).limit(0), lambda v: v % 100 == 0).count() == 0
    assert neighbours.nearest(frame(spark, [[1, 2]]), lambda v: v % 100 == 0).count() == 0


def test_common_vector_widths_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 30)
    r = np.random.default_rng(4)
    vectors = [[1, 2, 3]] * 150 + r.normal(size=(150, 3)).tolist() + [[5, 5], [5, 6], [0.0, 1, 0, 0]]
    ids = [*range(300), 1000, 1001, 2000]
    ids[299] = None
    rows = neighbours.nearest(frame(spark, vectors, ids), lambda v: v % 100 == 0).collect()
    by = {q: [(x.vec_id, x.score) for x in sorted(rows, key=lambda x: x["rank"]) if x.query_id == q] for q in {x.query_id for x in rows}}
    assert by[0] == [(i, 0.0) for i in range(1, 11)] and by[100] == [(i, 0.0) for i in range(10)]
    assert by[1000] == [(1001, 1.0)] and 2000 not in by and set(by) == {0, 100, 200, 1000}


def test_cells():
    r = np.random.default_rng(5)
    points = r.normal(size=(4000, neighbours.DIMENSIONS))
    points[:1500] = points[0]
    cells = neighbours.Cells(points[::2], 20)
    at = cells.route(points)
    assert 4 < len(cells.low) <= 20 and set(at) == set(range(len(cells.low)))
    for i in range(0, 4000, 97):
        low = cells.bounds(points[i])
        assert low[at[i]] == 0
        for c in set(at):
            assert low[c] <= ((points[at == c] - points[i]) ** 2).sum(axis=1).min() + 1e-12


def test_kd_tree_bounds():
    r = np.random.default_rng(3)
    points = r.normal(size=(1000, 5))
    tree = neighbours.KdTree(points, 16)
    assert sorted(np.concatenate(tree.order).tolist()) == list(range(1000))
    q = r.normal(size=5)
    for low, ids in zip(tree.bounds(q), tree.order):
        assert low <= ((points[ids] - q) ** 2).sum(axis=1).min() + 1e-12


def test_quantile():
    x = neighbours.chi_square_quantile(0.95, 12)
    assert abs(x - 21.0261) < 1e-3
