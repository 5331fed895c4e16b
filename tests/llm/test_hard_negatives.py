"""Hard negatives against a loop over all rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinshelf.llm import hard_negatives as hard

SCHEMA = "id long, label int, asked boolean, vector array<long>, row string, ordinal int"


def brute(rows, positives=5, negatives=10):
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[3] is not None]
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, (anchor, label, asked, vector) in enumerate(rows):
        if not asked:
            continue
        scored = [(-dot(vector, r[3]), r[0], r[1]) for j, r in enumerate(rows) if j != i]
        for s, positive, _ in sorted(r for r in scored if r[2] == label)[:positives]:
            fits = sorted(r for r in scored if r[2] != label and 30 * -s <= 100 * -r[0] <= 90 * -s)[:negatives]
            out += [(anchor, positive, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def mined(spark, rows, **how):
    return sorted(map(tuple, hard.mine_hard_negatives(frame(spark, rows), **how).collect()))


@pytest.mark.parametrize("width, scale, block_bytes", [(1, 5, 1 << 20), (6, 3, 1 << 20), (64, 50, 1 << 20), (17, 100_000, 3000), (5, 2**29, 1 << 20)])
def test_all_rows(spark, width, scale, block_bytes, monkeypatch):
    monkeypatch.setattr(hard, "SLICE", 7)
    monkeypatch.setattr(hard, "CHUNK", width * 40)
    rng = random.Random(width)
    rows = [
        (i, rng.choice([0, 0, 0, 1, 2]), i % 9 == 0, [rng.randint(-scale // 2, scale) for _ in range(width)])
        for i in rng.sample(range(1000), 300)
    ]
    want = brute(rows)
    assert want and mined(spark, rows, block_bytes=block_bytes) == want


def test_odd_rows(spark):
    rows = [
        (0, 1, True, [3, 4]), (0, 1, True, [3, 4]), (1, 1, False, [3, 4]), (2, 2, False, [3, 3]), (3, 2, False, [2]), (4, 2, None, []),
        (5, None, True, [1, 1]), (None, 2, True, [3, 4]), (6, 2, False, None), (7, 3, True, [0, 0]), (8, 3, False, [9, 9, 9]),
        (9, 4, True, [-1, -1]), (10, 4, False, [5, 5]), (100, 9, True, [1, 1]),
    ]
    full = [(i, label, asked, vector and (vector + [0] * 3)[:3] or ([0] * 3 if vector == [] else None)) for i, label, asked, vector in rows]
    want = brute(full)
    assert want and mined(spark, rows) == want
    assert mined(spark, []) == [] and mined(spark, [(1, 1, False, [1])]) == [] and mined(spark, [(1, 1, True, [])]) == []


def test_usable_vectors(spark):
    given = [[1.0], [None], None, [float("nan")], [float("inf")], [-float("inf"), 1.0], []]
    told = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "id int, v array<double>")
    assert [r.id for r in told.where(hard.usable(F.col("v"))).orderBy("id").collect()] == [0, 6]


def vectors(matrix):
    n = np.arange(len(matrix))
    return hard.Vectors(n, n, n, matrix.astype(np.int64))


def test_bounds_hold_and_skip_most_scores():
    """On vectors whose segments are level most pairs are never scored; none that fits is lost on any."""
    rng = np.random.default_rng(6)
    level = np.repeat(rng.normal(0, 80, (500, 16)), 4, axis=1) + rng.normal(0, 4, (500, 64))
    for matrix, most in ((level, 0.1), (rng.normal(0, 30, (500, 64)), 1.0), (rng.integers(-(2**28), 2**28, (500, 9)), 1.0)):
        rows = vectors(matrix)
        exact = rows.exact @ rows.exact.T
        low, high = np.sort(exact, axis=1)[:, 485], np.sort(exact, axis=1)[:, 495]
        a, b, scores, scored = hard.survivors(rows, rows, np.ones(exact.shape, bool), low, high)
        want = (exact >= low[:, None]) & (exact <= high[:, None])
        fits = want[a, b]  # limits with more digits than a float may let in a few more
        assert sorted(zip(a[fits], b[fits])) == sorted(zip(*np.nonzero(want))) and (scores == exact[a, b]).all()
        assert scored <= most * exact.size


def test_best_entries_of_each_key():
    rng = np.random.default_rng(8)
    best, all_ = hard.Best(6, 3), []
    for _ in range(30):
        key, score, ids = rng.integers(0, 6, 40), rng.integers(0, 9, 40), rng.integers(0, 10**6, 40)
        best.add(key, score, ids)
        all_ += zip(key.tolist(), score.tolist(), ids.tolist())
    want = {(k, s, i) for key in range(6) for k, s, i in sorted((x for x in all_ if x[0] == key), key=lambda x: (-x[1], x[2]))[:3]}
    assert set(zip(best.key.tolist(), best.score.tolist(), best.id.tolist())) == want


def test_chunks_come_back(spark):
    rows = [(i, i % 3, i % 5 == 0, [i, -i, i * i]) for i in range(50)]
    batches = hard.vector_store(frame(spark, rows)).toArrow().to_batches()
    found = [(v.ids[k], v.labels[k], bool(asked[k]), v.exact[k].tolist()) for v, asked in hard._chunks(batches) for k in range(len(v))]
    assert sorted(found) == rows
    assert pa.Table.from_batches(hard._asked(batches)).num_rows == 10
