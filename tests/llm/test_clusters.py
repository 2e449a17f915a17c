import hashlib
import math

import numpy as np

from riskloom.llm.clusters import centroid_clusters, kept_points, nearest, op11_centroid_clustering


def brute(rows, k=8, rounds=10, width=64):
    """(vec_id, cluster, distance, cluster_inertia, inertia, sha) of each kept row, in plain loops."""
    kept = [(i, [math.floor(1024 * float(np.float32(c))) for c in x]) for i, x in rows if x is not None and len(x) == width and all(c is not None and math.isfinite(c) for c in x)]
    turn = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [w for _, w in sorted(kept, key=turn)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(w, c, strict=True)), n) for n, c in enumerate(centroids)) for _, w in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centroids)):
            own = [w for (_, w), (_, c) in zip(kept, found, strict=True) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    inertia = {n: sum(d for d, c in found if c == n) for n in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for (i, _), (d, c) in zip(kept, found, strict=True)), key=str)


def rows(n, seed, width=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width)) * rng.uniform(0.05, 1, size=(6, 1))
    return [(int(i), (centres[i % 6] + 0.05 * rng.normal(size=width)).astype(np.float32).tolist()) for i in range(n)]


def written(spark, path, data, extra=True):
    names = "vec_id long, embedding array<float>" + (", label int, cluster string, w string, home string" if extra else "")
    spark.createDataFrame([(*r, 1, "c", "w", "h") if extra else r for r in data], names).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_matches_brute_force_with_odd_rows(spark, tmp_path):
    data = rows(300, 1)
    data += [data[5], data[5], (7, [0.5] * 64), (900, [0.0] * 64), (901, [0.0] * 64)]  # repeated rows, a repeated id, ties
    data += [(910, None), (911, [1.0] * 63), (912, [1.0] * 65), (913, [None] + [1.0] * 63), (914, [float("nan")] * 64), (915, [float("-inf")] * 64), (916, [])]
    data += [(None, [0.25] * 64), (-3, [-1.5] * 64), (920, [1e5] * 64)]
    got = op11_centroid_clustering(spark, written(spark, tmp_path, data))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(data)


def test_fewer_points_than_clusters_and_none(spark, tmp_path):
    data = rows(3, 2) + [(50, None)]
    got = op11_centroid_clustering(spark, written(spark, tmp_path / "few", data, extra=False))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(data)
    none = op11_centroid_clustering(spark, written(spark, tmp_path / "none", [(50, None)], extra=False))
    assert none.collect() == [] and none.columns == got.columns


def test_same_from_any_partitioning(spark):
    vectors = spark.createDataFrame(rows(400, 3), "vec_id long, embedding array<float>")
    few, many = (centroid_clusters(kept_points(vectors.repartition(n)), k=5, rounds=4) for n in (1, 9))
    assert (few[1] == many[1]).all()
    assert sorted(map(tuple, few[0].collect())) == sorted(map(tuple, many[0].collect()))


def test_annulus_skips_centroids_and_keeps_ties():
    rng = np.random.default_rng(4)
    centroids = rng.integers(-3, 4, (40, 8)) + np.arange(40)[:, None] * 20
    points = centroids[rng.integers(0, 40, 500)] + rng.integers(-2, 3, (500, 8))
    points = np.concatenate((points, (centroids[:-1] + centroids[1:]) // 2, centroids))
    squares = ((points[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    for homes in (np.full(len(points), -1), rng.integers(0, 40, len(points)), squares.argmin(axis=1)):
        who, best, taken = nearest(points, centroids, homes)
        assert (who == squares.argmin(axis=1)).all() and (best == squares.min(axis=1)).all()
    assert taken < len(points) * 10  # of 40
    # two centroids on the edge of the annulus, at the same distance as the home: the smaller number wins
    who, best, _ = nearest(np.array([[0, 5]]), np.array([[0, 10], [0, 0], [5, 5], [-5, 5]]), np.array([3]))
    assert (who[0], best[0]) == (0, 25)
