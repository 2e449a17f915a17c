"""Exact k-means over integer vectors, with annulus search for the nearest centroid."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import dropped, saved
from riskloom.llm.topk import _products

#: Components are cut at this size, so that squared distances of up to 64 of them fit a long.
LARGEST = 1 << 27
#: Homes are written anew once more than this share of the vectors has moved away from them.
MOVED = 0.2
START = "sha2(concat('3:', cast(id as string)), 256)"


def kept_points(vectors: DataFrame, width: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, w``: the vectors of exactly ``width`` finite components, each as floor(scale * x)."""
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    limit = F.lit(float(LARGEST))
    ints = F.transform("x", lambda c: F.floor(F.greatest(-limit, F.least(limit, c * scale))).cast("int"))
    return given.where((F.size("x") == width) & finite).select("id", ints.alias("w"))


def nearest(points: np.ndarray, centroids: np.ndarray, homes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each point (ties: the smaller number), its squared distance, and how many distances were taken.

    ``homes`` names a centroid for each point, -1 for none (then the one whose norm is nearest serves). The
    distance to it is an upper bound u, and by the triangle inequality only centroids with norms within
    [|x| - u, |x| + u] can be as near; these are found by binary search in the sorted norms and compared in
    whole numbers. The annulus is widened by more than its rounding errors, so ties on its edge are inside.
    """
    squares = np.einsum("ij,ij->i", centroids, centroids)
    order = np.argsort(squares, kind="stable")
    norms = np.sqrt(squares[order].astype(float))
    own = np.einsum("ij,ij->i", points, points)
    length = np.sqrt(own.astype(float))
    middle = np.clip(np.searchsorted(norms, length), 1, max(1, len(norms) - 1))
    low, high = middle - 1, np.minimum(middle, len(norms) - 1)
    who = np.where(homes >= 0, homes, order[np.where(length - norms[low] <= norms[high] - length, low, high)])
    best = own + squares[who]
    for c in np.unique(who):
        rows = np.flatnonzero(who == c)
        best[rows] -= 2 * _products(points[rows], centroids[c : c + 1])[:, 0]
    guess, taken = who.copy(), len(points)
    reach = np.sqrt(best.astype(float))
    reach += 1e-9 * (length + reach + 1)
    first, last = np.searchsorted(norms, length - reach, "left"), np.searchsorted(norms, length + reach, "right")
    for place in range(int(first.min(initial=len(norms))), int(last.max(initial=0))):
        c = order[place]
        rows = np.flatnonzero((first <= place) & (place < last) & (guess != c))
        far = own[rows] + squares[c] - 2 * _products(points[rows], centroids[c : c + 1])[:, 0]
        nearer = (far < best[rows]) | ((far == best[rows]) & (c < who[rows]))
        best[rows[nearer]], who[rows[nearer]] = far[nearer], c
        taken += len(rows)
    return who, best, taken


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("w").flatten().to_numpy().reshape(-1, width).astype(np.int64)


def _homes(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("home").to_numpy().astype(np.int64)


def _rehomed(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The points with the cluster that they have under these centroids as their home."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who = nearest(_matrix(batch, width), centroids, _homes(batch))[0]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("w"), pa.array(who, pa.int32())], names=["id", "w", "home"])

    return points.mapInArrow(run, points.schema)


def _moved_centroids(points: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, float]:
    """The centroids after one round, and which share of the points is away from home."""
    count, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes, away = np.zeros((count, width), np.int64), np.zeros(count, np.int64), np.zeros(count, np.int64)
        for batch in batches:
            rows, homes = _matrix(batch, width), _homes(batch)
            who = nearest(rows, centroids, homes)[0]
            sizes += np.bincount(who, minlength=count)
            away += np.bincount(who, who != homes, minlength=count).astype(np.int64)
            for c in np.unique(who):
                sums[c] += rows[who == c].sum(axis=0)
        some = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sizes[some]), pa.array(away[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "away", "sums"])

    parts = points.mapInArrow(run, "cluster int, n long, away long, sums array<long>")
    # A task gives a row a cluster; what comes to the driver is a number a cluster and component.
    cells = parts.select("cluster", "n", "away", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("away").alias("away"), F.sum(F.col("col").cast("decimal(38,0)")).alias("total"))
    moved, total, away = centroids.copy(), 0, 0
    for row in cells.collect():
        moved[row["cluster"], row["pos"]] = int(row["total"]) // row["n"]
        if row["pos"] == 0:
            total, away = total + row["n"], away + row["away"]
    return moved, away / max(total, 1)


def centroid_clusters(points: DataFrame, k: int = 8, rounds: int = 10, start: str = START) -> tuple[DataFrame, np.ndarray]:
    """The clusters ``id, cluster, distance`` of points ``id, w`` (from :func:`kept_points`) and the final centroids.

    Centroids start as the ``k`` points that come first by the SQL expression ``start`` over ``id`` (null
    last, then by components). Each round assigns every point to the nearest centroid (squared Euclidean
    distance, ties to the smaller number) and moves each non-empty centroid to the exact floor of its
    points' mean; then points are assigned once more. Everything is in whole numbers.

    Points stay in a written table with a home each: the cluster of the round in which they were last
    written. It gives the upper bound of the annulus (:func:`nearest`), and the table is written anew only
    when more than a fifth of the points are away from home, so most rounds just read it. A round
    shuffles one row a task, cluster and component, whatever the number of points; centroids (k rows)
    travel with the tasks. Hot clusters cost nothing, for no point is shuffled.

    Every row counts, also where ids repeat or are null (a null id starts no cluster unless there are too few
    others). Fewer points than ``k`` give that many centroids, no points none. Components beyond +-2^27
    after scaling are cut there. Other columns are ignored.
    """
    table = saved(points.withColumn("home", F.lit(-1)))
    first = table.selectExpr("id", "w", f"{start} AS turn").orderBy(F.col("turn").asc_nulls_last(), "w").limit(k).collect()
    centroids = np.array([r["w"] for r in first], np.int64)
    if not first:
        return table.select("id", F.col("home").alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids.reshape(0, 0)
    for _ in range(rounds):
        moved, away = _moved_centroids(table, centroids)
        if away > MOVED:
            former, table = table, saved(_rehomed(table, centroids))
            dropped(former)
        centroids = moved
    width = centroids.shape[1]

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, far, _ = nearest(_matrix(batch, width), centroids, _homes(batch))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(who, pa.int32()), pa.array(far)], names=["id", "cluster", "distance"])

    assigned = saved(table.mapInArrow(final, "id long, cluster int, distance long"))
    dropped(table)
    return assigned, centroids


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    """Eight clusters of all vectors after ten rounds, as :func:`centroid_clusters` gives them, with inertias and the centroids' hashes."""
    assigned, centroids = centroid_clusters(kept_points(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    hashes = [(number, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for number, c in enumerate(centroids.tolist())]
    per_cluster = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    named = spark.createDataFrame(hashes, "cluster int, centroid_sha256 string").join(per_cluster, "cluster")  # a row a centroid
    named = named.crossJoin(per_cluster.agg(F.sum("cluster_inertia").alias("inertia")))  # with the one row of the total
    return assigned.join(F.broadcast(named), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
