"""Ranks and running totals over whole tables, without a window that one task would have to hold."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.core.checks import col


#: A row's range is found in steps of at most so many comparisons and one: what a row runs through stays short enough to be compiled, for any number of ranges.
RADIX = 8


def _steps(df: DataFrame) -> tuple[int, int]:
    """Ranges are told apart by so many digits (the second) of so many values each: four ranges a shuffle partition, 64 at least."""
    least, digits = max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 1
    while RADIX**digits < least:
        digits += 1
    return next(r for r in range(2, RADIX + 1) if r**digits >= least), digits


def ranged(df: DataFrame, lead: str, kind: Column | None = None, kinds: int = 1, split: Column | None = None, descending: bool = False, cuts: DataFrame | None = None) -> DataFrame:
    """``df`` with ``__range``: the number of the range of ``lead`` that a row lies in (approximate quantiles part the ranges).

    The quantiles are a subquery of the plan: nothing runs before the result is used. With ``kind`` (0 up
    to ``kinds``) each kind of rows has ranges of its own. Equal values share a range, and NaN lies above
    all numbers, as in Spark's order, so the ranges are ordered as the rows are.

    With ``split``, a number that orders rows of equal ``lead`` (rising, even if ``descending``), rows that equal the
    upper end of their range, as all values with more than a few ranges' share of the rows do, are parted once
    more by the ranges of that number. ``cuts`` may be a smaller table whose values lie as those of ``df`` do.
    """
    radix, digits = _steps(df)
    count = radix**digits
    shares = [i / count for i in range(1, count)]
    number = F.when(~F.isnan(lead), F.col(lead))
    per = [F.percentile_approx(number if kind is None else F.when(kind == i, number), shares, 10_000) for i in range(kinds)]
    inner = [] if split is None else [F.percentile_approx(split.cast("double"), shares, 10_000)]
    every = (df if cuts is None else cuts).agg(F.array(*per, *inner).alias("c")).scalar()

    def among(df: DataFrame, value: Column, cuts: str, to: str) -> DataFrame:
        """Adds the number of cuts below the value, a digit after the other."""
        place, size = F.lit(0), count
        for digit in range(digits):
            size //= radix
            above = [F.coalesce((value > F.get(cuts, place + (i * size - 1))).cast("int"), F.lit(0)) for i in range(1, radix)]
            df = df.withColumn(to, place + size * sum(above[1:], start=above[0]))
            place = F.col(to)
        return df

    # The subquery stands in the plan once, as a column: a copy in each comparison would be planned as often.
    places = F.lit(0) if kind is None else kind
    if split is None:
        return among(df.withColumn("__cuts", F.get(every, places)), F.col(lead), "__cuts", "__range").drop("__cuts")
    df = df.withColumn("__every", every).withColumns({"__cuts": F.get("__every", places), "__inner": F.get("__every", F.lit(kinds))})
    df = among(among(df, F.col(lead), "__cuts", "__range"), split.cast("double"), "__inner", "__part")
    part = 1 + (count - 1 - F.col("__part") if descending else F.col("__part"))
    at_end = F.coalesce(F.col(lead) == F.get("__cuts", F.col("__range")), F.lit(False))
    return df.withColumn("__range", F.col("__range") * (count + 1) + F.when(at_end, part).otherwise(0)).drop("__part", "__every", "__cuts", "__inner")


def running(df: DataFrame, groups: Sequence[str], lead: str, values: Sequence[str], descending: bool = True, ties: Sequence[Column] = (), kind: Column | None = None, kinds: int = 1, split: Column | None = None, cuts: DataFrame | None = None, summed: bool = False) -> DataFrame:
    """``df`` with ``<value>_run`` and ``<value>_all``: sums of its group from the highest ``lead`` down to and with the row (lowest up, if not ``descending``), and of the whole group.

    Rows are summed within (group, range), which are spread over the cluster, and moved up by the sums of
    the ranges before, a table of at most groups x ranges rows. ``split``, a number that rises with ``ties``,
    parts rows of equal ``lead`` too, and ``cuts`` may be a smaller table to cut ranges by (:func:`ranged`). A group is one column, a struct (in
    which null equals null), so that the sums within ranges and the join with those of the ranges before ask for the same
    shuffle. ``summed``: rows of one group and ``lead`` are added up first, in that same shuffle; only these columns are returned.
    """
    kept = [*groups, lead, *values] if summed else df.columns
    parts = ranged(df, lead, kind, kinds, split, descending, cuts)
    parts = parts.withColumn("__key", F.struct(*map(col, groups))) if groups else parts
    group = ["__key"] if groups else []
    on = [*group, "__range"]
    if summed:
        parts = parts.repartition(*on).groupBy(*on, lead).agg(*[F.sum(v).alias(v) for v in values])
    direction = F.desc if descending else F.asc
    ahead = Window.partitionBy(*group).orderBy(direction("__range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    sums = parts.groupBy(*on).agg(*[F.sum(v).alias(f"__s_{v}") for v in values])
    sums = sums.select(*on, *[F.coalesce(F.sum(f"__s_{v}").over(ahead), F.lit(0)).alias(f"__a_{v}") for v in values], *[F.sum(f"__s_{v}").over(whole).alias(f"{v}_all") for v in values])
    inner = Window.partitionBy(*on).orderBy(direction(lead), *ties).rowsBetween(Window.unboundedPreceding, 0)
    own = parts.withColumns({f"__o_{v}": F.sum(v).over(inner) for v in values})
    back = [F.col("__key").getField(c).alias(c) if c in groups else col(c) for c in kept]
    return own.join(sums, on).select(*back, *[(F.col(f"__o_{v}") + F.col(f"__a_{v}")).alias(f"{v}_run") for v in values], *[f"{v}_all" for v in values])


def numbered(df: DataFrame, groups: Sequence[str], lead: str, descending: bool = True, ties: Sequence[Column] = ()) -> DataFrame:
    """``df`` with ``__row`` (from 1, by ``lead`` within each group) and ``__rows`` (the size of the group)."""
    counted = running(df.withColumn("__one", F.lit(1)), groups, lead, ["__one"], descending, ties)
    return counted.select(*[col(c) for c in df.columns], F.col("__one_run").alias("__row"), F.col("__one_all").alias("__rows"))


#: Rows that are alike are written out in blocks of so many.
ALIKE = 4096


def magnitude(df: DataFrame, name: str) -> Column:
    """A number that never falls where the column rises: numbers and times themselves, of texts the first six bytes."""
    kind, value = df.schema[name].dataType, col(name)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return value.cast("double")
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(value, "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.lit(0.0)


def placed(df: DataFrame, groups: Sequence[str], lead: str, ties: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``__row`` (from 1, by rising ``lead``, then ``ties``, then a hash of the row) and ``__rows`` (the size of the group).

    Nothing has to stay together but what a few ranges hold: rows that are alike are counted first and written
    out again in blocks, rows of equal ``lead`` are parted by the first of the ties, or by the hash. The
    numbers follow from the rows' values alone, so they are the same under any partitioning (rows that are
    alike may change places, which nothing shows).
    """
    every = [col(c) for c in df.columns]
    hashed = df.groupBy(*every).agg(F.count("*").alias("__n")).withColumn("__h", F.xxhash64(*every))
    split = magnitude(df, ties[0]) if ties else F.col("__h").cast("double")
    ran = running(hashed.withColumn("__split", split), groups, lead, ["__n"], False, [*map(col, ties), F.col("__h"), *every], split=F.col("__split"))
    each = ran.withColumn("__before", F.col("__n_run") - F.col("__n"))
    blocks = each.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(ALIKE).cast("long")))).repartition("__h", "__b")
    whole = blocks.withColumn("__i", F.explode(F.sequence(F.col("__b") + 1, F.least(F.col("__b") + ALIKE, F.col("__n")))))
    return whole.select(*every, (F.col("__before") + F.col("__i")).alias("__row"), F.col("__n_all").alias("__rows"))


def dealt(df: DataFrame, groups: Sequence[str], key: Column, name: str, ties: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``name``, the rows' numbers from 1 within each group, in the order of the hashes ``key`` (equal ones follow ``ties``); groups must not be null.

    Hashes fall into ranges evenly, so no quantiles are needed: the input is read twice, once for the sizes of the ranges.
    """
    radix, digits = _steps(df)
    parts = df.withColumn("__key", key).withColumn("__range", F.pmod("__key", F.lit(radix**digits)))
    ahead = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy(*groups, "__range").agg(F.count("*").alias("__n"))
    sizes = sizes.select(*groups, "__range", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))
    inner = Window.partitionBy(*groups, "__range").orderBy("__key", *map(col, ties))
    each = parts.withColumn("__in", F.row_number().over(inner))
    return each.join(sizes, [*groups, "__range"]).select(*[col(c) for c in df.columns], (F.col("__ahead") + F.col("__in")).alias(name))


def observed_quantiles(df: DataFrame, values: Sequence[Column], parts: int, interpolated: bool = False) -> list[list[float]]:
    """For each of the values the quantiles 1/parts .. (parts - 1)/parts: observed ones, or between the two next ones if ``interpolated``.

    Nulls and NaN are left out; a column without values has no quantiles. Equal values are counted first,
    their ranks run distributed, and only the rows that hold a wanted rank reach the driver.
    """
    each = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("f"), v.cast("double").alias("v")) for i, v in enumerate(values)])).alias("x")).select("x.*")
    counts = each.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("f", "v").agg(F.count("*").alias("n"))
    ran = running(counts, ["f"], "v", ["n"], False, kind=F.col("f"), kinds=len(values))
    whole = F.col("n_all")
    if interpolated:
        places = [((whole - 1) * i, i) for i in range(1, parts)]
        ranks = [x for p, i in places for x in ((F.lit(i), F.expr("'low'"), F.floor(p / parts) + 1), (F.lit(i), F.expr("'high'"), F.ceil(p / parts) + 1))]
    else:
        ranks = [(F.lit(i), F.expr("'low'"), F.ceil(whole * i / parts)) for i in range(1, parts)]
    wanted = F.array(*[F.struct(i.alias("i"), side.alias("side"), rank.cast("long").alias("rank")) for i, side, rank in ranks])
    hits = ran.select("f", "v", "n_all", "n_run", "n", F.explode(wanted).alias("w")).where((F.col("w.rank") <= F.col("n_run")) & (F.col("w.rank") > F.col("n_run") - F.col("n")))
    found = {(r["f"], r["i"], r["side"]): (r["v"], r["n_all"]) for r in hits.select("f", "v", "n_all", "w.*").collect()}
    out: list[list[float]] = [[] for _ in values]
    for f in range(len(values)):
        for i in range(1, parts):
            if (f, i, "low") in found:
                (low, n), (high, _) = found[f, i, "low"], found.get((f, i, "high"), (0.0, 0))
                place = (n - 1) * i / parts
                out[f].append(low + (high - low) * (place - math.floor(place)) if interpolated else low)
    return out


def tile_of(row: Column, rows: Column, tiles: int) -> Column:
    """The tile of a row number: sizes differ by one at most, the first tiles are the larger ones."""
    size, larger = F.floor(rows / tiles), rows % tiles
    edge = larger * (size + 1)
    late = larger + F.ceil((row - edge) / F.greatest(size, F.lit(1)))
    return F.when(row <= edge, F.ceil(row / (size + 1))).otherwise(late).cast("int")


def tile_end(tile: Column, rows: Column, tiles: int) -> Column:
    """The number of the last row of a tile (0 for tile 0)."""
    return tile * F.floor(rows / tiles) + F.least(tile, rows % tiles)


def tiled(counts: DataFrame, groups: Sequence[str], lead: str, tiles: int, descending: bool = True, ties: Sequence[Column] = (), kind: Column | None = None, kinds: int = 1, cuts: DataFrame | None = None) -> DataFrame:
    """``groups.., lead, tile, n, e``: rows of counts (n rows alike, e of them events) in equal shares of each group's rows.

    The highest values (or lowest) are in tile 1. A row of counts that a tile's end cuts is parted there;
    of rows that are alike in ``lead`` and ``ties`` the events come last, so the result is definite.
    """
    ran = running(counts.where("n > 0"), groups, lead, ["n"], descending, ties, kind, kinds, cuts=cuts)
    before = F.col("n_run") - F.col("n")
    spans = ran.withColumns({"__before": before, "__tiles": F.sequence(tile_of(before + 1, F.col("n_all"), tiles), tile_of(F.col("n_run"), F.col("n_all"), tiles))})
    each = spans.withColumn("tile", F.explode("__tiles"))
    low = F.greatest("__before", tile_end(F.col("tile") - 1, F.col("n_all"), tiles))
    high = F.least("n_run", tile_end(F.col("tile"), F.col("n_all"), tiles))
    others = F.col("__before") + F.col("n") - F.col("e")
    return each.select(*groups, lead, "tile", (high - low).alias("n"), F.greatest(F.lit(0), high - F.greatest(low, others)).alias("e"))
