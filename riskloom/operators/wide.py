"""Correlation of thousands of columns: a Gram matrix in strips of columns across tasks, and the filter over streamed pairs."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.core.checks import as_names, col, require_columns, require_numeric
from riskloom.operators.selection import SelectionResult

#: Numbers of the matrix that one task holds (128 MB); wider tables are cut into more strips.
HELD = 1 << 24


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """The rows of each batch as a matrix; null becomes NaN."""
    for batch in batches:
        flat = batch.column(0).flatten()
        yield flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def _rows(df: DataFrame, features: Sequence[str], tasks: int) -> DataFrame:
    """One array a row, in few enough partitions that what they emit stays small beside the rows; no shuffle."""
    return df.coalesce(tasks).select(F.array(*[col(f).cast("double") for f in features]).alias("x"))


def spreads(df: DataFrame, features: Sequence[str], tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and range of each feature, in one pass; a feature with a null, NaN or infinite value raises ValueError."""
    width = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, bad = 0, np.zeros(width), np.zeros(width, np.int64)
        low, high = np.full(width, np.inf), np.full(width, -np.inf)
        for x in _matrices(batches, width):
            if len(x):
                n += len(x)
                bad += (~np.isfinite(x)).sum(axis=0)
                total += x.sum(axis=0)
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        if n:
            columns = [np.arange(width, dtype=np.int32), np.full(width, n), total, bad, low, high]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["at", "n", "total", "bad", "low", "high"])

    parts = _rows(df, features, tasks).mapInArrow(run, "at int, n long, total double, bad long, low double, high double")
    found = parts.groupBy("at").agg(F.sum("n"), F.sum("total"), F.sum("bad"), F.min("low"), F.max("high")).orderBy("at").collect()
    if bad := [features[r[0]] for r in found if r[3]]:
        raise ValueError(f"features must be finite and without nulls: {', '.join(bad)}")
    if not found:
        return np.full(width, np.nan), np.zeros(width)
    _, n, total, _, low, high = (np.array(x, dtype=float) for x in zip(*found, strict=True))
    return total / n, high - low


def gram(df: DataFrame, features: Sequence[str], *, held: int = HELD, tasks: int | None = None) -> DataFrame:
    """Rows ``at, products``: for feature number ``at`` its product sums with itself and each later one.

    Values are centred and divided by their range first. The matrix is cut into strips of so many
    columns that a task holds at most about ``held`` numbers; a strip reads its own and later columns
    only, and all strips are tasks of one job. Each task sends one row a column, and these are added up
    as vectors in the JVM, so rows of ``df`` are never shuffled. ``tasks`` bounds the partitions a strip
    is read in (default: twice the cluster's parallelism).
    """
    tasks = tasks or 2 * df.sparkSession.sparkContext.defaultParallelism
    centre, span = spreads(df, features, tasks)
    scale = np.where(span > 0, span, 1.0)
    shift = np.where(span > 0, centre, 0.0)
    step = max(1, held // len(features))

    def strip(start: int) -> DataFrame:
        width, own = len(features) - start, min(step, len(features) - start)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((own, width))
            some = False
            for x in _matrices(batches, width):
                for at in range(0, len(x), 4096):
                    z = (x[at : at + 4096] - shift[start:]) / scale[start:]
                    z[:, span[start:] == 0] = 0.0
                    sums += z[:, :own].T @ z
                    some = True
            for k in range(own) if some else ():
                row = pa.array([sums[k, k:]], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([start + k], pa.int32()), row], names=["at", "x"])

        return _rows(df, features[start:], tasks).mapInArrow(run, "at int, x array<double>")

    parts = functools.reduce(DataFrame.union, [strip(s) for s in range(0, len(features), step)])
    summed = parts.select("at", array_to_vector("x").alias("x")).groupBy("at").agg(Summarizer.sum(F.col("x")).alias("x"))
    return summed.select("at", vector_to_array("x").alias("products"))


def correlation_table(sums: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows ``i, j, left, right, correlation`` (i < j) of all pairs, from :func:`gram`; to 12 places, NaN where a feature is constant."""
    own = sums.select("at", F.col("products")[0]).collect()
    names = df_of_names(sums, features, {r[0]: r[1] for r in own})
    each = sums.select(F.col("at").alias("i"), F.posexplode("products").alias("k", "product")).where("k > 0")
    left = names.select(F.col("at").alias("i"), F.col("name").alias("left"), F.col("size").alias("si"))
    right = names.select(F.col("at").alias("j"), F.col("name").alias("right"), F.col("size").alias("sj"))
    pairs = each.withColumn("j", F.col("i") + F.col("k")).join(F.broadcast(left), "i").join(F.broadcast(right), "j")
    both = F.sqrt("si") * F.sqrt("sj")
    value = F.when(both > 0, F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("product") / both)), 12)).otherwise(F.lit(float("nan")))
    return pairs.select("i", "j", "left", "right", value.alias("correlation"))


def df_of_names(like: DataFrame, features: Sequence[str], sizes: dict[int, float]) -> DataFrame:
    """``at, name, size``: a row a feature, so its size is the number of columns of the table."""
    rows = [(k, f, float(sizes.get(k, 0.0))) for k, f in enumerate(features)]
    return like.sparkSession.createDataFrame(rows, "at int, name string, size double")


def wide_correlation_filter(df: DataFrame, feature_cols: Sequence[str], *, threshold: float = 0.9, held: int = HELD, tasks: int | None = None) -> SelectionResult:
    """The rule of :func:`selection.correlation_filter` (Pearson) for any number of features.

    A feature is rejected if one kept before it correlates at least ``threshold`` in size. The matrix
    stays distributed; of its pairs only those at or over the threshold come to the driver, one after
    another in the order of the features, and the driver keeps a flag a feature. ``grouped_table`` is
    the lazy table of all pairs. The data are read once for the spreads and, a strip, once more for the
    strip's columns.

    Nulls, NaN and infinite values raise ValueError; constant features correlate with nothing; of no
    rows at all every feature is kept. Correlations are rounded to 12 places, so that equal columns are
    exactly 1 whatever the order of addition.
    """
    features = as_names(feature_cols, "feature_cols", True)
    require_columns(df, features)
    require_numeric(df, features)
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must lie between 0 and 1")
    sums = gram(df, features, held=held, tasks=tasks).persist()
    try:
        pairs = correlation_table(sums, features)
        near = pairs.where(~F.isnan("correlation") & (F.abs("correlation") >= threshold)).orderBy("j", "i")
        clash: dict[int, int] = {}
        for r in near.select("i", "j").toLocalIterator():
            if r["i"] not in clash:
                clash.setdefault(r["j"], r["i"])
    finally:
        sums.unpersist()
    rows = [{"feature": f, "correlated_with": features[clash[k]] if k in clash else None, "selected": k not in clash} for k, f in enumerate(features)]
    return SelectionResult(rows, "correlation", {"threshold": threshold, "correlation_method": "pearson"}, grouped_table=pairs)
