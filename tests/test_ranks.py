"""Ranks that part equal values and equal rows, and what is built on them."""

import datetime as dt
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import ranking
from riskloom.functions.ranking import magnitude, placed, ranged
from riskloom.operators import modelling, search, selection


def largest_share(df, lead, split):
    """The largest range against an even share of the 64 ranges, and how many are used."""
    sizes = [r["count"] for r in ranged(df, lead, split=split).groupBy("__range").count().collect()]
    return max(sizes) / (sum(sizes) / 64), len(sizes)


@pytest.mark.parametrize("value", ["7D", "cast(id % 6 as double)", "cast(id as double)"])
def test_no_range_holds_much_more_than_the_mean(spark, value):
    df = spark.range(200_000).select(F.expr(value).alias("v"), F.xxhash64("id").cast("double").alias("h"))
    share, parts = largest_share(df, "v", F.col("h"))
    assert share < 2 and parts >= 60


def test_numbers_follow_value_then_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), float(v), int(t), f"n{t % 9}") for g, v, t in zip(rng.integers(0, 2, 3000), rng.choice([1, 2, 2, 2, 5, 9], 3000), rng.permutation(3000), strict=True)]
    df = spark.createDataFrame(rows, "g int, v double, t int, name string")
    for ties, key in ((["t"], lambda r: (r["v"], r["t"])), (["name", "t"], lambda r: (r["v"], r["name"], r["t"]))):
        got = placed(df.repartition(7), ["g"], "v", ties).collect()
        for g in (0, 1):
            part = sorted((r for r in got if r["g"] == g), key=lambda r: r["__row"])
            assert [r["__row"] for r in part] == list(range(1, len(part) + 1)) and {r["__rows"] for r in part} == {len(part)}
            assert part == sorted(part, key=key)


def test_rows_that_are_alike_are_written_out_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ALIKE", 100)
    df = spark.createDataFrame([(1.0, "a")] * 950 + [(None, "b")] * 30 + [(2.0, "a")] * 3 + [(float("nan"), "c")], "v double, `odd.name` string")
    got = placed(df, [], "v").collect()
    assert sorted(r["__row"] for r in got) == list(range(1, 985))
    order = [r["v"] for r in sorted(got, key=lambda r: r["__row"])]
    assert order[:30] == [None] * 30 and order[30:980] == [1.0] * 950 and order[980:983] == [2.0] * 3
    assert Counter(r["odd.name"] for r in got) == {"a": 953, "b": 30, "c": 1}
    assert placed(df.limit(0), [], "v").collect() == []


def test_magnitudes_rise_with_the_column(spark):
    df = spark.createDataFrame([("", dt.date(2020, 1, 1)), ("a", dt.date(2020, 1, 2)), ("ab", dt.date(1960, 5, 5)), ("é", dt.date(2030, 1, 1)), ("b", None)], "s string, d date")
    for name in ("s", "d"):
        found = df.orderBy(name).select(magnitude(df, name).alias("m")).collect()
        values = [r["m"] for r in found if r["m"] is not None]
        assert values == sorted(values)


@pytest.mark.parametrize("strategy,options", [("stratified", {}), ("kfold", {}), ("time_series", {"date_col": "d"}), ("time_series", {"date_col": "d", "order_cols": ["k"]})])
def test_folds_are_even_and_the_same_from_any_partitions(spark, strategy, options):
    df = spark.range(4000).selectExpr("cast(id % 3 = 0 as int) as target", "id % 500 as k", "date_add(date'2024-01-01', cast(id % 5 as int)) as d")
    few, many = (Counter(map(tuple, modelling.with_folds(df.repartition(n), "target", 4, strategy, **options).collect())) for n in (2, 16))
    assert few == many
    sizes = Counter()
    for row, n in few.items():
        sizes[row[-1]] += n
    assert set(sizes) == {0, 1, 2, 3} and max(sizes.values()) - min(sizes.values()) <= 2
    if strategy == "time_series":
        days = {f: sorted({r[2] for r in few if r[3] == f}) for f in range(4)}
        assert all(days[f][-1] <= days[f + 1][0] for f in range(3))


def several(spark, n=1500):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, n)
    rows = [("abc"[c], int(c), float(2 * c + rng.normal()), float(rng.normal() - (c == 1)), float(rng.normal())) for c in y]
    return rows, spark.createDataFrame(rows, "text string, number int, strong double, middle double, none double")


def test_anova_of_several_classes(spark):
    rows, df = several(spark)
    features = ["none", "middle", "strong"]
    values = np.array([[r[4], r[3], r[2]] for r in rows])
    groups = [values[[r[1] == c for r in rows]] for c in range(3)]
    between = sum(len(g) * (g.mean(0) - values.mean(0)) ** 2 for g in groups) / 2
    within = sum(((g - g.mean(0)) ** 2).sum(0) for g in groups) / (len(values) - 3)
    for target in ("text", "number"):
        found = selection.anova(df, target, features)
        assert [r["f_statistic"] for r in found.feature_table] == pytest.approx((between / within).tolist())
        assert found.ranking == {"strong": 1, "middle": 2, "none": 3} and found.selected_features == ["middle", "strong"]
    assert selection.mutual_information(df, "text", features, top_k=1).selected_features == ["strong"]
    with pytest.raises(ValueError, match="two classes"):
        selection.anova(df.where("number = 1"), "text", features)
    with pytest.raises(ValueError, match="0 and 1"):
        search.rfecv(df, "number", features)


@pytest.mark.parametrize("model", ["random_forest", "logistic_regression"])
def test_importances_of_several_classes(spark, model):
    _, df = several(spark, 600)
    for target in ("text", "number"):
        found = search.feature_importance_selection(df, target, ["none", "middle", "strong"], model=model, top_k=1)
        assert found.selected_features == ["strong"] and found.ranking["none"] == 3


def test_nested_elimination_does_not_leak(spark):
    """Noise only: chosen by all labels, a few features seem to tell the classes apart in held-out rows; chosen anew in each fold they don't."""
    rng = np.random.default_rng(8)
    names = [f"x{i}" for i in range(20)]
    rows = [(i % 2, (i // 2) % 3, *map(float, rng.normal(size=20))) for i in range(60)]
    df = spark.createDataFrame(rows, "target int, fold int, " + ", ".join(f"{x} double" for x in names)).coalesce(1)
    how = {"cv": 3, "fold_col": "fold", "step": 16, "min_features_to_select": 4, "n_tiles": 10, "model_params": {"maxIter": 10}}
    plain, nested = (search.rfecv(df, "target", names, nested=n, **how) for n in (False, True))
    assert [h["n_features"] for h in nested.history] == [20, 4]
    assert plain.history[0]["mean_auc"] == pytest.approx(nested.history[0]["mean_auc"])
    assert plain.history[-1]["mean_auc"] > 0.65 and nested.history[-1]["mean_auc"] < plain.history[-1]["mean_auc"] - 0.1
    assert len(nested.history[-1]["fold_features"]) == 3 and len(nested.history[-1]["fold_auc"]) == 3


def test_ranks_of_eliminated_features_follow_each_other(spark, monkeypatch):
    monkeypatch.setattr(modelling, "evaluate", lambda *_: {"auc": 0.7})  # equal sizes: the smallest is kept
    rng = np.random.default_rng(9)
    rows = [(y := int(rng.integers(0, 2)), float(3 * y + 0.1 * rng.normal()), float(y + rng.normal()), float(rng.normal())) for _ in range(300)]
    df = spark.createDataFrame(rows, "target int, strong double, middle double, none double")
    found = search.rfecv(df, "target", ["none", "middle", "strong"], cv=2, model_params={"maxIter": 5})
    assert found.selected_features == ["strong"] and found.ranking == {"strong": 1, "middle": 2, "none": 3}
