"""Ranking metrics of binary scores: KS, AUC, Gini, ROC points and risk tables; by tiles or exact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.core.checks import as_names, binary_fault, col, present, reject, require_columns, require_tiles
from riskloom.functions.ranking import running, tiled

NAN = float("nan")
RISK_COLUMNS = ["n_tile", "minimum_range", "maximum_range", "total_volume", "total_events", "total_non_events", "event_rate"]


def _narrow(df: DataFrame, groups: Sequence[str], score: str, target: str, ties: Sequence[str] = ()) -> DataFrame:
    """Neutral names: g0.., s (double), y (double), t0..; nothing else is read."""
    picked = [col(g).alias(f"g{i}") for i, g in enumerate(groups)] + [col(score).cast("double").alias("s"), col(target).cast("double").alias("y")]
    return df.select(*picked, *[col(t).alias(f"t{i}") for i, t in enumerate(ties)])


def _keys(groups: Sequence[str]) -> list[str]:
    return [f"g{i}" for i in range(len(groups))]


def _ties(ties: Sequence[str]) -> list[str]:
    return [f"t{i}" for i in range(len(ties))]


def _named(groups: Sequence[str]) -> list[Column]:
    return [F.col(f"g{i}").alias(g) for i, g in enumerate(groups)]


def _down(keys: Sequence[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def collapsed(rows: DataFrame, keys: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """Rows that are alike as one: how many (n), and how many of them events (e). A common score becomes one row before it is shuffled."""
    return rows.groupBy(*keys, "s", *ties).agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("e"))


def tile_counts(counts: DataFrame, keys: Sequence[str], n_tiles: int, ties: Sequence[str] = (), descending: bool = True, kind: Column | None = None, kinds: int = 1, cuts: DataFrame | None = None) -> DataFrame:
    """Per group and tile: lowest and highest score, rows, events. A table of groups x tiles."""
    parts = tiled(counts, keys, "s", n_tiles, descending, [F.col(t) for t in ties], kind, kinds, cuts)
    return parts.groupBy(*keys, "tile").agg(F.min("s").alias("low"), F.max("s").alias("high"), F.sum("n").alias("n"), F.sum("e").alias("e"))


def _ks(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """KS per group from rows with running events and others (er, nr) and all of them (e_all, n_all)."""
    both = (F.col("e_all") > 0) & (F.col("n_all") > 0)
    gap = F.abs(F.col("er") / F.when(both, F.col("e_all")) - F.col("nr") / F.when(both, F.col("n_all")))
    return points.groupBy(*keys).agg(F.coalesce(F.max(gap), F.lit(NAN)).alias("KS"))


def _area(points: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """AUC and Gini per group: trapezoids between successive ROC points."""
    both = (F.col("e_all") > 0) & (F.col("n_all") > 0)
    tpr, fpr = F.col("er") / F.when(both, F.col("e_all")), F.col("nr") / F.when(both, F.col("n_all"))
    # A trapezoid reaches back by the row's own events and others, so no row needs the one before.
    back_t, back_f = F.col("e") / F.when(both, F.col("e_all")), (F.col("n") - F.col("e")) / F.when(both, F.col("n_all"))
    area = F.sum(back_f * (2 * tpr - back_t) / 2)
    found = points.groupBy(*keys).agg(F.coalesce(area, F.lit(NAN)).alias("auc"))
    return found.withColumn("gini", 2 * F.col("auc") - 1)


def tile_points(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    whole = Window.partitionBy(*keys)
    down = _down(keys, "tile")
    return counts.withColumns({"er": F.sum("e").over(down), "nr": F.sum(F.col("n") - F.col("e")).over(down), "e_all": F.sum("e").over(whole), "n_all": F.sum(F.col("n") - F.col("e")).over(whole)})


def exact_points(counts: DataFrame, keys: Sequence[str], kind: Column | None = None, kinds: int = 1, cuts: DataFrame | None = None) -> DataFrame:
    """A point for each distinct score, from rows of counts; the sums run down distributed."""
    rows = counts.where("n > 0").withColumn("o", F.col("n") - F.col("e"))
    ran = running(rows, keys, "s", ["e", "o"], kind=kind, kinds=kinds, cuts=cuts, summed=True)
    return ran.withColumn("n", F.col("e") + F.col("o")).withColumnsRenamed({"e_run": "er", "o_run": "nr", "o_all": "n_all"})


def _empty_overall(found: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Without groups there is one row, also for an empty input."""
    return found if keys else found.agg(*[F.coalesce(F.max(c), F.lit(NAN)).alias(c) for c in columns])


def ks_ntile(score_column: str = "score", dataframe: DataFrame | None = None, group_columns: str | Sequence[str] | None = None, target: str = "target", n_tiles: int = 10, *, tie_breaker: str | Sequence[str] | None = None) -> DataFrame:
    """``groups.., KS``: the largest gap between the shares of events and others, over score tiles.

    Rows with a null score or a target other than 0 and 1 are left out; a NaN score counts as the highest.
    KS is NaN where a class is absent. ``tie_breaker`` columns make the order of equal scores, and so the
    result, definite.
    """
    if dataframe is None:
        raise ValueError("dataframe is required")
    require_tiles(n_tiles)
    groups, ties = as_names(group_columns, "group_columns"), as_names(tie_breaker, "tie_breaker")
    require_columns(dataframe, [score_column, target, *groups, *ties])
    rows = _narrow(dataframe, groups, score_column, target, ties).where(F.col("s").isNotNull() & F.col("y").isin(0.0, 1.0))
    keys = _keys(groups)
    found = _ks(tile_points(tile_counts(collapsed(rows, keys, _ties(ties)), keys, n_tiles, _ties(ties)), keys), keys)
    return _empty_overall(found, keys, ["KS"]).select(*_named(groups), "KS")


def _valid(rows: DataFrame) -> DataFrame:
    return rows.where(present(F.col("s")) & present(F.col("y")))


def _all_groups(df: DataFrame, found: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Adds groups without any valid pair, with NaN."""
    if not groups:
        return found
    every = df.select(*[col(g).alias(f"g{i}") for i, g in enumerate(groups)]).distinct()
    right = found.withColumnsRenamed({f"g{i}": f"r{i}" for i in range(len(groups))})
    on = F.lit(True)
    for i in range(len(groups)):
        on &= every[f"g{i}"].eqNullSafe(right[f"r{i}"])
    return every.join(right, on, "left").select(*_keys(groups), *[F.coalesce(c, F.lit(NAN)).alias(c) for c in columns])


def auc_gini(score_column: str = "score", df: DataFrame | None = None, group_by: str | Sequence[str] | None = None, target_column: str = "target", n_tiles: int = 10, *, exact: bool = False, tie_breaker: str | Sequence[str] | None = None) -> DataFrame:
    """``groups.., auc, gini`` by tiles, or ``exact`` over all distinct scores (ties count half).

    Pairs with a null or NaN side are left out; a target other than 0 and 1 raises. All groups, null keys
    too, come from one plan; without both classes the values are NaN.
    """
    require_tiles(n_tiles)
    groups, ties = as_names(group_by, "group_by"), as_names(tie_breaker, "tie_breaker")
    if set(groups) & {"auc", "gini"}:
        raise ValueError("group columns must not be named auc or gini")
    require_columns(df, [score_column, target_column, *groups, *ties])
    reject(df, binary_fault(target_column))
    keys = _keys(groups)
    rows = _valid(_narrow(df, groups, score_column, target_column, ties))
    points = exact_points(collapsed(rows, keys), keys) if exact else tile_points(tile_counts(collapsed(rows, keys, _ties(ties)), keys, n_tiles, _ties(ties)), keys)
    found = _all_groups(df, _area(points, keys, "s"), groups, ["auc", "gini"])
    return _empty_overall(found, keys, ["auc", "gini"]).select(*_named(groups), "auc", "gini")


roc_auc_gini = auc_gini


def ks_exact(score_column: str, df: DataFrame, group_by: str | Sequence[str] | None = None, target_column: str = "target") -> DataFrame:
    """``groups.., KS`` over all distinct scores."""
    groups = as_names(group_by, "group_by")
    require_columns(df, [score_column, target_column, *groups])
    reject(df, binary_fault(target_column))
    keys = _keys(groups)
    found = _ks(exact_points(collapsed(_valid(_narrow(df, groups, score_column, target_column)), keys), keys), keys)
    return _empty_overall(_all_groups(df, found, groups, ["KS"]), keys, ["KS"]).select(*_named(groups), "KS")


def curve_roc(score_column: str = "score", df: DataFrame | None = None, target_column: str = "target", n_tiles: int = 10, *, exact: bool = False, tie_breaker: str | Sequence[str] | None = None) -> DataFrame:
    """ROC points: ``tile, fpr, tpr`` from the origin (tile 0) on, or, ``exact``, ``fpr, tpr, threshold`` for each distinct score.

    No points where a class is absent.
    """
    require_tiles(n_tiles)
    ties = as_names(tie_breaker, "tie_breaker")
    require_columns(df, [score_column, target_column, *ties])
    reject(df, binary_fault(target_column))
    rows = _valid(_narrow(df, [], score_column, target_column, ties))
    points = exact_points(collapsed(rows, []), []) if exact else tile_points(tile_counts(collapsed(rows, [], _ties(ties)), [], n_tiles, _ties(ties)), [])
    both = points.where("e_all > 0 and n_all > 0")
    fpr, tpr = F.col("nr") / F.col("n_all"), F.col("er") / F.col("e_all")
    label = F.col("s").alias("threshold") if exact else F.col("tile").alias("tile")
    lines = both.select(label, fpr.alias("fpr"), tpr.alias("tpr"))
    start = F.lit(float("inf")).alias("threshold") if exact else F.lit(0).alias("tile")
    origin = both.agg(F.count("*").alias("k")).where("k > 0").select(start, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    out = lines.unionByName(origin)
    return out.select("fpr", "tpr", "threshold").orderBy("fpr", "tpr") if exact else out.orderBy("tile")


def risk_table(score_column: str = "score", df: DataFrame | None = None, target_column: str = "target", n_tiles: int = 10, *, ascending: bool = False, tie_breaker: str | Sequence[str] | None = None) -> DataFrame:
    """A row for each occupied tile: score range, volume, events, others, event rate. Infinite scores raise."""
    require_tiles(n_tiles, 1)
    ties = as_names(tie_breaker, "tie_breaker")
    require_columns(df, [score_column, target_column, *ties])
    reject(df, binary_fault(target_column) | {f"scores in {score_column!r} must be finite": F.abs(col(score_column).cast("double")) == float("inf")})
    rows = _valid(_narrow(df, [], score_column, target_column, ties))
    counts = tile_counts(collapsed(rows, [], _ties(ties)), [], n_tiles, _ties(ties), not ascending)
    return risk_columns(counts).orderBy("n_tile")


def risk_columns(counts: DataFrame, *kept: str) -> DataFrame:
    return counts.select(*kept, F.col("tile").alias("n_tile"), F.col("low").alias("minimum_range"), F.col("high").alias("maximum_range"), F.col("n").alias("total_volume"), F.col("e").alias("total_events"), (F.col("n") - F.col("e")).alias("total_non_events"), (F.col("e") / F.col("n")).alias("event_rate"))
