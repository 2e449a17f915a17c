"""Bootstrap samples as weights: the same from every partitioning, and one frame for all rounds."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.core.checks import col


def collapsed(df: DataFrame, columns: Sequence[str], piece: int = 1024) -> DataFrame:
    """Rows that are alike as one row with their number ``__n``, and ``__key``, a hash of its values.

    More than ``piece`` alike rows become several rows of different keys, so that a value that makes up much of
    the table is spread over the cluster. The order of rows depends on the values alone, as do then models that
    read rows in order.
    """
    values = [col(c) for c in columns]
    counted = df.groupBy(*values).agg(F.count("*").alias("__all"))
    parts = counted.withColumn("__part", F.explode(F.sequence(F.lit(0), F.floor((F.col("__all") - 1) / piece))))
    sized = parts.select(*values, F.least(F.lit(piece), F.col("__all") - F.col("__part") * piece).alias("__n"), F.xxhash64(*values, "__part").alias("__key"))
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sized.repartition(count, "__key").sortWithinPartitions("__key")


def poisson_limits(mean: float) -> list[int]:
    """Signed 64-bit limits: a uniform whole number reaches k of them with the chance that a Poisson variable is k."""
    limits, term, below = [], math.exp(-mean), 0.0
    for k in range(1, 200):
        below += term
        if (limit := int(below * 2.0**64) - 2**63) >= 2**63 - 1 or limits and limit == limits[-1]:
            break
        limits.append(limit)
        term *= mean / k
    return limits


def drawn_count(mean: float, seed: int) -> Column:
    """How often the rows of a :func:`collapsed` row are drawn in all: a Poisson number of ``mean`` for each of them."""
    rolls = F.transform(F.sequence(F.lit(1), F.col("__n").cast("int")), lambda j: F.xxhash64(F.col("__key"), F.lit(seed), j))
    reached = lambda roll: sum(((roll >= F.lit(x)).cast("int") for x in poisson_limits(mean)), F.lit(0))
    return F.aggregate(rolls, F.lit(0), lambda total, roll: total + reached(roll))


def resampled(rows: DataFrame, mean: float, seed: int, weight: str = "__weight") -> DataFrame:
    """A sample with replacement of :func:`collapsed` rows: those drawn, with ``weight``, how often."""
    return rows.withColumn(weight, drawn_count(mean, seed).cast("double")).where(F.col(weight) > 0)
