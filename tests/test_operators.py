"""Hand-computed values and edge rows of the operators."""

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from riskloom.functions.distributions import binomial_tails, chi2_tail, f_tail
from riskloom.functions.ranking import observed_quantiles
from riskloom.operators import cube, metrics, provider, search, selection, temporal

NAN = float("nan")


def scored(spark, rows):
    return spark.createDataFrame(rows, "score double, target int")


@pytest.mark.parametrize("targets,tiles,auc", [([1, 1, 0, 0], 4, 1.0), ([0, 0, 1, 1], 4, 0.0), ([1, 0, 0, 1], 4, 0.5), ([1, 0, 1, 0], 2, 0.5), ([1, 0, 1, 0], 4, 0.75)])
def test_tile_auc(spark, targets, tiles, auc):
    df = scored(spark, list(zip([0.9, 0.8, 0.2, 0.1], targets)))
    assert metrics.auc_gini("score", df, n_tiles=tiles).first().asDict() == {"auc": auc, "gini": 2 * auc - 1}


def test_exact_auc_with_ties_and_missing(spark):
    df = scored(spark, [(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0), (None, 1), (NAN, 0), (0.3, None)])
    assert metrics.auc_gini("score", df, exact=True).first()["auc"] == pytest.approx(0.875)
    assert metrics.ks_exact("score", df).first()["KS"] == pytest.approx(0.5)


def test_empty_single_class_and_null_groups(spark):
    df = spark.createDataFrame([(None, 0.5, 1), (None, 0.4, 0), ("a", 0.2, 1), ("b", None, 1)], "g string, score double, target int")
    got = {r["g"]: r["auc"] for r in metrics.auc_gini("score", df, "g").collect()}
    assert set(got) == {None, "a", "b"} and got[None] == 1.0 and math.isnan(got["a"]) and math.isnan(got["b"])
    assert math.isnan(metrics.auc_gini("score", df.limit(0)).first()["auc"]) and math.isnan(metrics.ks_ntile("score", df.limit(0)).first()["KS"])
    assert metrics.curve_roc("score", df.where("g = 'a'")).count() == 0
    with pytest.raises(ValueError):
        metrics.auc_gini("score", scored(spark, [(0.1, 2)]))


def test_risk_table_sizes(spark):
    got = metrics.risk_table("score", scored(spark, [(float(i), i % 2) for i in range(10)]), n_tiles=3).collect()
    assert [(r["n_tile"], r["total_volume"], r["maximum_range"]) for r in got] == [(1, 4, 9.0), (2, 3, 5.0), (3, 3, 2.0)]
    assert [r["n_tile"] for r in metrics.risk_table("score", scored(spark, [(1.0, 1)]), n_tiles=5).collect()] == [1]
    with pytest.raises(ValueError):
        metrics.risk_table("score", scored(spark, [(math.inf, 1)]))


def test_cube_labels(spark):
    df = spark.createDataFrame([(0.9, 1, "a"), (0.1, 0, "a"), (0.5, 1, None), (None, 0, "c")], "score double, target int, seg string")
    got = {(r["seg"]): r for r in cube.calculate_metrics(df, "seg").collect()}
    assert set(got) == {"Geral", "a", None, "c"} and got["a"]["AUC"] == 1.0 and math.isnan(got["c"]["KS"])
    assert {r["seg"] for r in cube.calculate_ntile(df, "seg").collect()} == {"Geral", "a", None}


def test_temporal_boundaries(spark):
    base = spark.createDataFrame([("01", "2024-02-29", 1.0), ("01", "2024-03-01", 2.0), ("01", "2024-03-31", None), ("01", "2024-04-05", 9.0)], "id string, observation_date string, v double")
    spine = spark.createDataFrame([("01", "2024-03-31", "p"), ("01", "2024-03-31", "p"), ("02", "2024-03-31", "q")], "id string, dt_ref string, payload string")
    got = temporal.build_features(base, spine, key_cols="id", value_cols="v", windows=(1,), lags=(1,)).orderBy("id").collect()
    assert len(got) == 3 and got[0] == got[1]
    r = got[0]
    assert (r["v_current"], r["v_current_date_diff_days"], r["v_lag_1_months"], r["v_lag_1_months_date_diff_days"]) == (2.0, 30, 1.0, 31)
    assert (r["v_count_1_months"], r["v_mean_1_months"], r["v_std_1_months"]) == (1, 2.0, None)
    assert got[2]["v_current"] is None and got[2]["v_count_1_months"] == 0
    stale = temporal.temporal_features(spine, base, "id", "v", windows=(), lags=(1,), max_staleness_days=0).orderBy("id").first()
    assert stale["v__current"] is None and stale["v__lag_1_months"] == 1.0 and stale["v__lag_1_months_date"] == date(2024, 2, 29)


@pytest.mark.parametrize("change", [{"windows": (0,)}, {"aggregations": ("mode",)}, {"period_unit": "years"}, {"create_cols": {"x": {"op": "sum", "args": []}}, "value_cols": ["v", "x"]}, {"max_staleness_days": -1}])
def test_temporal_options(spark, change):
    base = spark.createDataFrame([("1", "2024-01-01", 1.0)], "id string, observation_date string, v double")
    spine = spark.createDataFrame([("1", "2024-01-01")], "id string, dt_ref string")
    with pytest.raises(ValueError):
        temporal.build_features(base, spine, **{"key_cols": "id", "value_cols": "v", **change})


def test_temporal_rejects_repeats(spark):
    base = spark.createDataFrame([("1", "2024-01-01", 1.0)] * 2, "id string, observation_date string, v double")
    with pytest.raises(ValueError):
        temporal.build_features(base, base.select("id", F.col("observation_date").alias("dt_ref")), key_cols="id", value_cols="v")


def test_provider_report(spark):
    sent = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-01"), (None, "2024-01-01"), ("c", "2024-01-01")], "id string, dt string")
    rows = [("a", "2024-01-01", 10.0), ("a", "2024-01-01", 20.0), ("b", "2024-02-01", None), ("z", "bad", -1.0), ("y", None, 1100.0), ("x", "2024-02-03", NAN), ("w", "2024-02-03", math.inf)]
    report = provider.validate_external_dataframe(sent, spark.createDataFrame(rows, "id string, dt string, score double"), "id", "dt", "score")
    assert report["matching"]["matched_distinct_keys"] == 2 and report["matching"]["unexpected_received_keys"] == 4 and report["matching"]["received"]["duplicate_key_rows"] == 1
    assert {k: report["scores"][k] for k in ("missing", "invalid", "below_range", "above_range", "valid_in_range")} == {"missing": 2, "invalid": 1, "below_range": 1, "above_range": 2, "valid_in_range": 2}
    assert report["dates"] == {"missing_dates": 1, "invalid_dates": 1} and report["baseline"] == "202401" and len(report["cutoffs"]) == 9
    assert all(sum(b["percentage"] for b in report["monthly_bands"] if b["cohort"] == m["cohort"]) == pytest.approx(100) for m in report["monthly_volume"])
    assert sum(h["density"] * 100 for h in report["histogram"]) == pytest.approx(1)
    assert provider.validate_external_dataframe(sent, spark.createDataFrame([], "id string, dt string, score double"), "id", "dt", "score")["stability_status"].startswith("No valid")


def test_selectors(spark):
    rows = [(float(i % 2), float(i % 2) + 0.01 * (i % 5), 3.0, i % 2, None if i % 4 else 1.0, "u" if i % 2 else "v") for i in range(40)]
    df = spark.createDataFrame(rows, "x double, near double, flat double, target int, gap double, kind string")
    assert selection.completeness(df, ["x", "gap"]).selected_features == ["x"]
    assert selection.variance_filter(df, ["x", "flat"]).selected_features == ["x"]
    assert selection.cardinality(df, ["x", "flat", "kind"]).selected_features == ["x", "kind"]
    assert selection.correlation_filter(df, ["x", "near"]).rejected_features == ["near"]
    mi = selection.mutual_information(df, "target", ["x", "flat"], discrete_features=True)
    assert [round(r["mutual_information"], 9) for r in mi.feature_table] == [round(math.log(2), 9), 0.0]
    anova = selection.anova(df, "target", ["x", "flat", "near"])
    assert math.isinf(anova.feature_table[0]["f_statistic"]) and math.isnan(anova.feature_table[1]["f_statistic"]) and anova.selected_features == ["x", "near"]
    assert selection.chi_square(df.withColumn("code", F.col("x").cast("int")), "target", ["code", "flat"]).selected_features == ["code"]
    iv = selection.information_value(df, "target", ["gap", "kind"])
    assert iv.feature_table[1]["iv"] > 3 and iv.bin_details.where("is_missing").count() == 1
    assert sum(r["distribution_event"] for r in iv.bin_details.where("feature = 'gap'").collect()) == pytest.approx(1)
    with pytest.raises(ValueError):
        selection.anova(df, "flat", ["x"])


def test_tails():
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05) and chi2_tail(18.307038053275146, 10) == pytest.approx(0.05)
    assert f_tail(4.964602743730711, 1, 10) == pytest.approx(0.05) and f_tail(math.inf, 1, 5) == 0
    assert binomial_tails(3, 3) == (0.125, 1.0)


def test_cube_runs_one_check_before_it_is_used(spark, monkeypatch):
    rows = spark.createDataFrame([("a" if i % 3 else None, i % 2, float(i % 10), -float(i), i % 2) for i in range(60)], "seg string, part int, score double, other double, target int")
    ran = []
    kind = type(rows)
    for name in ("first", "collect", "count", "toPandas", "head", "take"):
        whole = getattr(kind, name)
        monkeypatch.setattr(kind, name, lambda self, *a, _f=whole, _n=name, **k: ran.append(_n) or _f(self, *a, **k))
    one = cube.calculate_metrics(rows, ["seg", "part"], ["score", "other"])
    two = cube.calculate_ntile(rows, ["seg", "part"], ["score", "other"], n_tiles=3)
    assert ran.count("first") == 2 and set(ran) <= {"first", "head", "take", "collect"}  # first() itself takes and collects
    monkeypatch.undo()
    assert one.count() == 2 * (1 + 2 + 2 + 4) and two.count() == 3 * one.count()
    empty = cube.calculate_metrics(rows.limit(0), ["seg"], "score").collect()
    assert [(r["seg"], math.isnan(r["KS"])) for r in empty] == [("Geral", True)]


def test_a_common_score_is_parted_at_tile_ends(spark):
    rows = spark.createDataFrame([(0.5, i % 2) for i in range(1000)] + [(0.9, 1)] * 10 + [(0.1, 0)] * 10, "score double, target int")
    found = metrics.risk_table("score", rows, n_tiles=4).collect()
    assert [r["total_volume"] for r in found] == [255] * 4 and sum(r["total_events"] for r in found) == 510
    assert [r["total_events"] for r in found] == [10, 0, 255, 245]  # of rows that are alike the events come last


def test_observed_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    values = [float(x) for x in rng.normal(size=501)] + [0.25] * 300
    rows = spark.createDataFrame([(v, None if i % 5 else float(i), float("nan")) for i, v in enumerate(values)], "a double, b double, c double")
    seen = [values, [float(i) for i in range(0, len(values), 5)]]
    for interpolated, how in ((False, "inverted_cdf"), (True, "linear")):
        found = observed_quantiles(rows, [F.col("a"), F.col("b"), F.col("c")], 4, interpolated)
        for got, want in zip(found, seen):
            assert got == pytest.approx([float(np.quantile(want, q, method=how)) for q in (0.25, 0.5, 0.75)])
        assert found[2] == []


def test_shuffled_is_the_same_from_any_partitions(spark):
    rows = spark.createDataFrame([(i, float(i % 4), "x" * (i % 3)) for i in range(80)] + [(1, 1.0, "x")] * 5, "k int, a double, b string")
    one, two = (sorted(map(tuple, search.shuffled(x, ["a", "b"], 3, ["a", "s"]).collect()), key=str) for x in (rows, rows.repartition(7)))
    assert one == two and sorted(r[1] for r in one) == sorted(r["a"] for r in rows.collect())
    assert [r[1] for r in one] != [float(r[0] % 4) for r in one]
