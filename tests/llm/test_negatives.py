import math

import numpy as np

from riskloom.llm import negatives
from riskloom.llm.negatives import Codebooks, hard_negatives, mined_rows, op12_hard_negatives, survivors

LABEL = "if(vec_id % 7 = 0, (label + 1) % 10, label)"


def brute(rows, positives=5, k=5):
    kept = {}
    for i, label, x in rows:
        if i is not None and label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            row = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(c))) for c in x])
            kept[i] = min(kept.get(i, row), row)
    score = lambda a, b: sum(x * y for x, y in zip(kept[a][1], kept[b][1], strict=False))
    out = []
    for a in (i for i in kept if i % 100 == 0):
        ranked = sorted((-score(a, i), i) for i in kept if i != a)
        for p, i in [(-s, i) for s, i in ranked if kept[i][0] == kept[a][0]][:positives]:
            inside = [(-s, j) for s, j in ranked if kept[j][0] != kept[a][0] and 80 * p <= -100 * s <= 100 * p]
            out += [(a, i, n + 1, j, p, s) for n, (s, j) in enumerate(inside[:k])]
    return sorted(out)


def rows(n, seed, width=16, step=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, width))
    return [(i * step, int(rng.integers(0, 10)), (centres[i % 7] + 0.3 * rng.normal(size=width)).astype(np.float32).tolist()) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame([(*r, "x", 5) for r in data], "vec_id long, label int, embedding array<float>, block string, q int")


def test_matches_brute_force_with_odd_rows(spark, tmp_path):
    data = rows(900, 1) + [(2000 + i, i % 3, [0.5] * 16) for i in range(60)]  # ties
    data += [data[3], data[100], (100, 9, [0.1] * 16), (200, 3, [0.0] * 16)]  # repeated rows and ids
    data += [(3000, None, [1.0] * 16), (3100, 1, None), (3200, 1, [None] + [1.0] * 15), (3300, 1, [float("nan")] * 16), (3400, 1, [float("inf")] * 16), (None, 1, [1.0] * 16)]
    data += [(3500, 2, []), (3600, 2, [0.5] * 3), (3700, 77, [1.0] * 16), (3800, 4, [0.0] * 16), (-100, 4, [0.4] * 20), (3900, 5, [-9.0] * 16)]
    frame(spark, data).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(tuple(r) for r in op12_hard_negatives(spark, str(tmp_path)).collect()) == brute(data)


def test_many_chunks_and_one_hot_label(spark, monkeypatch):
    monkeypatch.setattr(negatives, "CHUNK", 64)
    monkeypatch.setattr(negatives, "GROUP", 4)
    monkeypatch.setattr(negatives, "SLOT", 2)
    data = [(i, 0 if i % 3 else label, x) for i, label, x in rows(1500, 2, step=10)]
    got = hard_negatives(mined_rows(frame(spark, data).repartition(5), LABEL))
    assert sorted(tuple(r) for r in got.collect()) == brute(data)


def test_no_rows(spark):
    assert hard_negatives(mined_rows(frame(spark, []), LABEL)).collect() == []
    assert hard_negatives(mined_rows(frame(spark, [(100, 1, [1.0])]), LABEL)).collect() == []


def test_bounds_hold_and_rule_out_most_rows():
    rng = np.random.default_rng(3)
    centres = rng.integers(-300, 300, (30, 24))
    points = centres[rng.integers(0, 30, 4000)] + rng.integers(-4, 5, (4000, 24))
    books = Codebooks(points[:1000])
    codes, rests = books.encoded(points)
    anchors = np.concatenate((points[:50], rng.integers(-500, 500, (10, 24))))
    low, high = books.estimates(anchors, codes, rests)
    scores = anchors @ points.T
    assert (low <= scores).all() and (scores <= high).all()
    ends = np.full(len(anchors), np.inf)
    alive = survivors(low, high, np.ones_like(low, bool), -ends, ends, 5)
    best = np.argsort(-scores, axis=1, kind="stable")[:, :5]
    assert np.take_along_axis(alive, best, 1).all()
    assert alive.mean() < 0.1
    longer = np.pad(anchors, ((0, 0), (0, 3)), constant_values=7)  # more components than the codebooks know
    wide = np.pad(points, ((0, 0), (0, 3)), constant_values=-9)
    low, high = books.estimates(longer, *books.encoded(wide))
    assert (low <= longer @ wide.T).all() and (longer @ wide.T <= high).all()
