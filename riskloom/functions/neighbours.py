"""Mutual information of numbers and classes by distances to nearest neighbours (B. C. Ross, PLoS ONE 9(2), 2014)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.ranking import running

#: Sorted values are searched in blocks of so many, each with as many of either neighbour as are asked for.
BLOCK = 1 << 16


def digamma(n: Column) -> Column:
    """The logarithmic derivative of the gamma function for whole n >= 1: eight steps up, then five terms of its series (to 1e-11)."""
    z = n.cast("double") + 8
    series = F.log(z) - 1 / (2 * z) - 1 / (12 * z * z) + 1 / (120 * F.pow(z, F.lit(4))) - 1 / (252 * F.pow(z, F.lit(6)))
    return series - sum((1 / (n.cast("double") + i) for i in range(1, 8)), start=1 / n.cast("double"))


def neighbour_distances(counts: DataFrame, k: int, features: int, block: int = BLOCK) -> DataFrame:
    """``counts`` (rows ``f, y, value, n``: a feature's number, a class, n equal values) with ``of_class``, ``asked`` and ``d``.

    ``d`` is the distance to the ``asked``-th neighbour of the same class: the ``k``-th, or the last one in
    a smaller class. Classes of one row are left out. Values are numbered in order and cut into equal
    blocks, which get ``k`` rows of the blocks before and after; no class is sorted by one task. Of equal
    values no more than k + 1 are written out, and one of them is searched for.
    """
    some = counts.withColumn("copies", F.least("n", F.lit(k + 1)))
    ran = running(some, ["f", "y"], "value", ["copies", "n"], descending=False, kind=F.col("f"), kinds=features)
    each = ran.where("n_all > 1").select("f", "y", "value", "n", F.col("n_all").alias("of_class"), (F.col("copies_run") - F.col("copies")).alias("p"), F.explode(F.sequence(F.col("copies_run") - F.col("copies"), F.col("copies_run") - 1)).alias("at"))
    home, place = F.floor(F.col("at") / block), F.col("at") % block
    near = F.filter(F.array(home, F.when(place < k, home - 1), F.when(place >= block - k, home + 1)), lambda b: b.isNotNull())
    spread = each.withColumn("home", home).withColumn("block", F.explode(near))
    order = Window.partitionBy("f", "y", "block").orderBy("at")
    far = F.lit(float("inf"))
    left = [F.lit(0.0), *[F.coalesce(F.col("value") - F.lag("value", j).over(order), far) for j in range(1, k + 1)]]
    right = [F.lit(0.0), *[F.coalesce(F.lead("value", j).over(order) - F.col("value"), far) for j in range(1, k + 1)]]
    wide = spread.withColumns({f"l{j}": v for j, v in enumerate(left)} | {f"r{j}": v for j, v in enumerate(right)})
    asked = F.least(F.lit(k).cast("long"), F.col("of_class") - 1)
    distance = F.lit(None).cast("double")
    for few in range(1, k + 1):
        distance = F.when(asked == few, F.least(*[F.greatest(f"l{j}", f"r{few - j}") for j in range(few + 1)])).otherwise(distance)
    one = wide.where((F.col("at") == F.col("p")) & (F.col("block") == F.col("home")))
    return one.select("f", "y", "value", "n", "of_class", asked.alias("asked"), distance.alias("d"))


def neighbour_information(values: DataFrame, k: int, features: int, block: int = BLOCK, held: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Rows ``f, mutual_information`` in nats, of rows ``f, y, value`` (a feature's number, a class, a finite number).

    For each row the distance d to its k-th neighbour of the same class is found, and the number m of rows
    of all classes nearer than d (itself included; of those equal to it if d is 0). The estimate is
    psi(rows) + mean psi(k) - mean psi(size of the class) - mean psi(m), and 0 at least. m is a difference
    of two ranks: the ends of the intervals are sorted among the values in ranges, and running sums tell
    how many values lie before each. Values are taken as they are, without scaling or random noise.

    Both rankings read their input three times (for the ranges, the sums of these, the rows). ``held`` may cache
    the two tables that they read, a row for each different value of a feature and class: what it
    returns is used in place of what it is given.
    """
    counts = values.groupBy("f", "y", (F.col("value") + F.lit(0.0)).alias("value")).agg(F.count("*").alias("n"))
    found = held(neighbour_distances(held(counts), k, features, block))
    flat = F.col("d") == 0
    # An end sorts before the values equal to it (0) or after them (2), which are in between (1).
    ends = F.array(
        F.struct((F.col("value") - F.col("d")).alias("x"), F.when(flat, 0).otherwise(2).alias("side"), F.lit(-1).alias("sign"), F.lit(0).cast("long").alias("w")),
        F.struct((F.col("value") + F.col("d")).alias("x"), F.when(flat, 2).otherwise(0).alias("side"), F.lit(1).alias("sign"), F.lit(0).cast("long").alias("w")),
        F.struct(F.col("value").alias("x"), F.lit(1).alias("side"), F.lit(0).alias("sign"), F.col("n").alias("w")),
    )
    placed = running(found.withColumn("__e", F.explode(ends)).select("f", "y", "value", "n", "of_class", "asked", "__e.*"), ["f"], "x", ["w"], descending=False, ties=[F.col("side")], kind=F.col("f"), kinds=features)
    around = placed.where("sign <> 0").groupBy("f", "y", "value").agg(F.sum(F.col("sign") * F.col("w_run")).alias("m"), *[F.max(c).alias(c) for c in ("n", "of_class", "asked")])
    rows = F.sum("n")
    mean = lambda c: F.sum(F.col("n") * digamma(F.col(c))) / rows
    total = digamma(rows) + mean("asked") - mean("of_class") - mean("m")
    return around.groupBy("f").agg(F.greatest(total, F.lit(0.0)).alias("mutual_information"))
