"""Metric cubes: every subset of the grouping columns, for each score."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.core.checks import as_names, binary_fault, col, present, reject, require_columns, require_tiles
from riskloom.operators import metrics

#: What an omitted grouping column holds (fixed value).
OVERALL = "Geral"
RESERVED = {"KS", "AUC", "Gini", "score", "auc", "gini"}


def _subsets(df: DataFrame, groups: list[str], scores: list[str], target: str) -> list[tuple[str, ...]]:
    if set(groups) & (RESERVED | set(metrics.RISK_COLUMNS)):
        raise ValueError("grouping columns clash with output columns")
    if len(set(df.columns)) != len(df.columns):
        raise ValueError("the input has duplicate column names")
    require_columns(df, [*groups, *scores, target])
    return [s for size in range(len(groups) + 1) for s in combinations(groups, size)]


def _counts(df: DataFrame, groups: list[str], subsets: list[tuple[str, ...]], scores: list[str], target: str, ties: list[str]) -> tuple[DataFrame, DataFrame]:
    """``part, k0.., score, s, t0.., n, e``: counts of rows that are alike, once for each subset of the groups.

    The table is read once, for all scores; rows that are alike collapse before they are repeated for the
    subsets. A row without a valid pair counts 0, so that its group is not lost. The second table has the rows that count
    before they are repeated: their scores lie as those of the first do.
    """
    y = col(target).cast("double")
    sides = []
    for i, name in enumerate(scores):
        value = col(name).cast("double")
        valid = present(value) & present(y)
        sides.append(F.struct(F.lit(i).alias("score"), F.when(valid, value).alias("s"), F.when(valid, y).alias("y")))
    keys, order = [f"g{i}" for i in range(len(groups))], [f"t{i}" for i in range(len(ties))]
    rows = df.select(*[col(g).cast("string").alias(k) for g, k in zip(groups, keys, strict=True)], *[col(t).alias(k) for t, k in zip(ties, order, strict=True)], F.explode(F.array(*sides)).alias("x"))
    order_or_null = [F.when(F.col("x.s").isNotNull(), F.col(k)).alias(k) for k in order]
    alike = rows.select(*keys, *order_or_null, "x.*").groupBy(*keys, "score", "s", *order).agg(F.count("y").alias("n"), F.coalesce(F.sum("y").cast("long"), F.lit(0)).alias("e"))
    parts = [F.struct(F.lit(p).alias("part"), *[(F.col(f"g{i}") if g in subset else F.lit(None).cast("string")).alias(f"k{i}") for i, g in enumerate(groups)]) for p, subset in enumerate(subsets)]
    return alike.select(F.explode(F.array(*parts)).alias("p"), "score", "s", *order, "n", "e").select("p.*", "score", "s", *order, "n", "e"), alike.where("n > 0")


def _labels(groups: list[str], subsets: list[tuple[str, ...]], scores: list[str]) -> tuple[list, Column]:
    """The grouping columns as they are returned, and the score's name."""
    held = [F.when(F.col("part").isin([p for p, s in enumerate(subsets) if g in s]), F.col(f"k{i}")).otherwise(OVERALL).alias(g) for i, g in enumerate(groups)]
    return held, F.element_at(F.array(*[F.lit(s) for s in scores]), F.col("score") + 1).alias("score")


def calculate_metrics(df: DataFrame, group_columns: str | Sequence[str] | None = None, score_columns: str | Sequence[str] = ("score",), target_column: str = "target", n_tiles: int = 10, *, exact: bool = False, tie_breaker: str | Sequence[str] | None = None) -> DataFrame:
    """``groups.., KS, AUC, Gini, score`` for every subset of the groups and every score, rounded to 5 places.

    Omitted columns hold ``Geral``; keys become strings and null keys stay a group. KS and AUC come from one
    table of tile counts (or of distinct scores, if ``exact``) of all subsets and scores: one scan, one
    ranking. Both use the pairs without null or NaN. One job checks the targets; nothing else runs before
    the result is used. Groups without a valid pair are kept with NaN.
    """
    require_tiles(n_tiles)
    groups, scores, ties = as_names(group_columns, "group_columns"), as_names(score_columns, "score_columns", True), as_names(tie_breaker, "tie_breaker")
    subsets = _subsets(df, groups, scores, target_column)
    reject(df, binary_fault(target_column))
    keys = ["part", *[f"k{i}" for i in range(len(groups))], "score"]
    counts, cuts = _counts(df, groups, subsets, scores, target_column, [] if exact else ties)
    points = metrics.exact_points(counts, keys, F.col("score"), len(scores), cuts) if exact else metrics.tile_points(metrics.tile_counts(counts, keys, n_tiles, [f"t{i}" for i in range(len(ties))], True, F.col("score"), len(scores), cuts), keys)
    both = (F.col("e_all") > 0) & (F.col("n_all") > 0)
    tpr, fpr = F.col("er") / F.when(both, F.col("e_all")), F.col("nr") / F.when(both, F.col("n_all"))
    back_t, back_f = F.col("e") / F.when(both, F.col("e_all")), (F.col("n") - F.col("e")) / F.when(both, F.col("n_all"))
    found = points.groupBy(*keys).agg(F.max(F.abs(tpr - fpr)).alias("KS"), F.sum(back_f * (2 * tpr - back_t) / 2).alias("AUC"))
    # Groups without a valid pair, and the overall rows of an empty table, have no points: they come in as rows without values.
    overall = df.sparkSession.range(len(scores)).select(F.lit(0).alias("part"), *[F.lit(None).cast("string").alias(k) for k in keys[1:-1]], F.col("id").cast("int").alias("score"))
    every = counts.select(*keys).union(overall).select("*", F.lit(None).cast("double").alias("KS"), F.lit(None).cast("double").alias("AUC"))
    found = found.unionByName(every).groupBy(*keys).agg(*[F.coalesce(F.max(c), F.lit(metrics.NAN)).alias(c) for c in ("KS", "AUC")])
    held, name = _labels(groups, subsets, scores)
    return found.select(*held, F.round("KS", 5).alias("KS"), F.round("AUC", 5).alias("AUC"), F.round(2 * F.col("AUC") - 1, 5).alias("Gini"), name)


def calculate_ntile(df: DataFrame, group_columns: str | Sequence[str] | None = None, score_columns: str | Sequence[str] = ("score",), target_column: str = "target", n_tiles: int = 10, *, ascending: bool = False, tie_breaker: str | Sequence[str] | None = None) -> DataFrame:
    """``groups.., tile columns.., score``: the risk table of every subset and score; tiles are made within each group."""
    require_tiles(n_tiles, 1)
    groups, scores, ties = as_names(group_columns, "group_columns"), as_names(score_columns, "score_columns", True), as_names(tie_breaker, "tie_breaker")
    subsets = _subsets(df, groups, scores, target_column)
    reject(df, binary_fault(target_column) | {f"scores in {s!r} must be finite": F.abs(col(s).cast("double")) == float("inf") for s in scores})
    keys = ["part", *[f"k{i}" for i in range(len(groups))], "score"]
    counts, cuts = _counts(df, groups, subsets, scores, target_column, ties)
    tiles = metrics.tile_counts(counts, keys, n_tiles, [f"t{i}" for i in range(len(ties))], not ascending, F.col("score"), len(scores), cuts)
    held, name = _labels(groups, subsets, scores)
    return metrics.risk_columns(tiles, *keys).select(*held, *metrics.RISK_COLUMNS, name)
