import math

import numpy as np

from riskloom.llm.topk import Best, op7_exact_top_k, search, top_k


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * float(np.float32(c))) for c in x]) for i, x in rows if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for q, x in ok:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in ok if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def rows(n, seed, width=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width))
    return [(int(i), [float(c) for c in (centres[i % 5] + 0.2 * rng.normal(size=width)).astype(np.float32)]) for i in rng.permutation(n)]


def test_matches_brute_force(spark, tmp_path):
    data = rows(3000, 1)
    data += [(3000, None), (3001, [1.0] * 7 + [None]), (3050, [float("nan")] * 8), (3002, [float("inf")] * 8), (None, [1.0] * 8), (3100, []), (3101, [0.5] * 3), (3150, [0.0] * 8)]
    data += [(4000 + i, [0.25] * 8) for i in range(300)]
    vectors = spark.createDataFrame([(i, x, 1, "c") for i, x in data], "vec_id long, embedding array<float>, label int, chunk string")
    vectors.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in op7_exact_top_k(spark, str(tmp_path)).collect())
    assert got == brute(data)


def test_few_rows_and_none(spark):
    vectors = spark.createDataFrame([(0, [1.0]), (50, [2.0]), (3, [-1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in top_k(vectors, "id % 50 = 0").collect()) == brute([(0, [1.0]), (50, [2.0]), (3, [-1.0])])
    assert top_k(vectors.limit(0), "id % 50 = 0").collect() == []


def test_pruning_skips_blocks():
    rng = np.random.default_rng(2)
    weights = np.repeat(np.eye(16, dtype=np.int64) * 1000, 64, axis=0) + rng.integers(0, 9, (1024, 16))
    best = Best(1, 5)
    assert search(best, weights[:1], np.array([0]), weights, np.arange(1024)) < 4
    want = sorted((-int(weights[0] @ w), i) for i, w in enumerate(weights) if i)[:5]
    assert [(-s, i) for s, i in zip(best.score[0].tolist(), best.id[0].tolist())] == want
