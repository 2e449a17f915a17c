"""Training, folds, search and simulators on small separable data."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskloom.core.doctor import LEAST, doctor, judged, version_state
from riskloom.operators import modelling, search
from riskloom.sources.synthetic import simulate_bureau_history, simulate_credit_data


@pytest.fixture(scope="module")
def data(spark):
    rows = [(i, float(i % 2) + 0.02 * (i % 7), 1.0, float(i * 37 % 11), i % 2, i % 4 // 2, f"2024-0{1 + i // 12}-01") for i in range(48)]
    return spark.createDataFrame(rows, "id long, signal double, flat double, noise double, target int, fold int, day string").withColumn("day", F.to_date("day")).cache()


def test_train_store_and_load(data, tmp_path):
    result = modelling.train_model("a run!", "target", ["signal", "noise"], data, data, output_dir=tmp_path, n_tiles=6, analysis_cube={"n_tiles": 6})
    assert result.metrics["auc"] == 1.0 and result.metrics["ks"] == 1.0 and result.analysis_cube.count() == 1
    assert {p.name for p in result.output_dir.iterdir() if not p.name.startswith(".")} == {"model", "model_info.json", "metrics.json", "metadata.json", "feature_importance.csv"}
    again = modelling.scored(modelling.load_model(result.model_uri), data)
    assert [r["score"] for r in again.orderBy("id").collect()] == [r["score"] for r in result.oot_predictions.orderBy("id").collect()]
    with pytest.raises(ValueError):
        modelling.train_model("x", "target", ["score"], data.withColumn("score", F.lit(1.0)), data)
    with pytest.raises(ImportError):
        modelling.train_model("x", "target", ["signal"], data, data, "lightgbm")


def test_folds(data):
    sizes = lambda **k: Counter((r["fold"], r["target"]) for r in modelling.with_folds(data, "target", 4, **k).collect())
    assert set(sizes().values()) == {6}
    even = Counter()
    for (fold, _), n in sizes(strategy="kfold").items():
        even[fold] += n
    assert set(even.values()) == {12}
    timed = modelling.with_folds(data, "target", 4, "time_series", date_col="day", order_cols=["id"]).groupBy("fold").agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("fold").collect()
    assert [(r["a"], r["b"]) for r in timed] == [(0, 11), (12, 23), (24, 35), (36, 47)]
    one = {r["id"]: r["fold"] for r in modelling.with_folds(data, "target", 3).collect()}
    assert one == {r["id"]: r["fold"] for r in modelling.with_folds(data.repartition(5), "target", 3).collect()}
    with pytest.raises(ValueError):
        modelling.with_folds(data, "target", 2, fold_col="id")


def test_cross_validation(data):
    found = modelling.cross_validate(data, "target", ["signal"], cv=2, fold_col="fold", n_tiles=2, return_train_metrics=True)
    assert found.mean("AUC") == 1.0 and len(found.fold_metrics) == 2 and "train_KS" in found.fold_metrics[0]
    assert len(modelling.cross_validate(data, "target", ["signal"], cv=3, strategy="expanding", date_col="day", n_tiles=2).fold_metrics) == 2


def test_optimize_and_choice(data):
    found = modelling.optimize(data, data, "target", ["signal", "noise"], "logistic_regression", {"regParam": {"type": "float", "low": 0.01, "high": 0.1, "log": True}}, n_trials=2, cv=2, n_tiles=4, target_metric="oot_auc", target_limit=0.5, target_operator=">=")
    assert found.constraint_satisfied and 0.01 <= found.best_params["regParam"] <= 0.1
    trials = [modelling.Trial(0, {}, 0.9, residual=0.2), modelling.Trial(1, {}, 0.5), modelling.Trial(2, {}, 0.6), modelling.Trial(3, {}, 0.6)]
    assert modelling.chosen(trials, "maximize", True).number == 2 and modelling.chosen(trials, "minimize", True).number == 1
    with pytest.warns(RuntimeWarning):
        assert modelling.chosen(trials[:1], "maximize", True).number == 0
    assert modelling.derived({"ks": 0.5}, {"ks": 0.4}, {"ks": 0.3})["train_oot_ks_abs_shift"] == pytest.approx(0.2)


def test_model_selectors(data):
    features = ["signal", "flat", "noise"]
    assert search.feature_importance_selection(data, "target", features, top_k=1, model_params={"numTrees": 5}).selected_features == ["signal"]
    assert search.l1_selection(data, "target", features, reg_param=0.2, oot_df=data, n_tiles=4).selected_features == ["signal"]
    assert search.rfe("r", "target", data, data, features, n_tiles=4).selected_features == ["signal"]
    assert search.rfecv(data, "target", ["signal", "flat"], cv=2, fold_col="fold", n_tiles=4).selected_features == ["signal"]
    assert search.sequential_selection(data, "target", ["flat", "signal"], cv=2, fold_col="fold", n_tiles=4).selected_features == ["signal"]
    assert search.stability_selection(data, "target", features, n_iterations=2, selector_kwargs={"top_k": 1, "model_params": {"numTrees": 3}}).selected_features == ["signal"]
    assert search.boruta(data, "target", ["signal", "flat"], n_estimators=5, max_iter=8, two_step=False, alpha=0.3).feature_table[0]["status"] == "confirmed"


def test_permutation(data):
    mixed = search.shuffled(data, ["noise"], 3)
    assert Counter(r["noise"] for r in mixed.collect()) == Counter(r["noise"] for r in data.collect()) and mixed.columns == data.columns
    model = modelling.fitted(data, "target", ["signal", "noise"], "logistic_regression")
    found = search.permutation_importance_selection(model, data, "target", ["signal", "noise"], n_repeats=2, top_k=1)
    assert found.selected_features == ["signal"]


def test_boruta_states():
    states = search.boruta_states({"a": 10, "b": 0, "c": 5}, dict.fromkeys("abc", "tentative"), 10, 0.05, True, 3)
    assert states == {"a": "confirmed", "b": "rejected", "c": "tentative"}


def test_simulators(spark):
    df, names = simulate_credit_data(spark, row_count=500, feature_count=6, seed=3)
    rows = df.collect()
    assert len(names) == 6 and len(rows) == 500 and all(len(r["company_id"]) == 14 for r in rows) and {r["default_flag"] for r in rows} == {0, 1}
    again, _ = simulate_credit_data(spark, row_count=500, feature_count=6, seed=3)
    assert again.collect() == rows
    gaps = [abs(r["m1"] - r["m0"]) for r in [df.agg(*[F.avg(F.when(F.col("default_flag") == 1, F.col(n))).alias("m1") for n in names[:1]], *[F.avg(F.when(F.col("default_flag") == 0, F.col(n))).alias("m0") for n in names[:1]]).first()]]
    assert all(math.isfinite(g) for g in gaps)
    people = spark.range(200).select(F.format_string("%03d", "id").alias("k"))
    paths = simulate_bureau_history(people, "k", "2023-01-15", "2023-12-31", seed=5)
    found = paths.collect()
    assert {r["observation_date"].day for r in found} >= {28, 30, 31} and all(0 <= r["score"] <= 1000 for r in found)
    sizes = Counter(r["k"] for r in found)
    assert len(sizes) == 200 and max(sizes.values()) == 12 and min(sizes.values()) < 12
    assert sorted(map(str, found)) == sorted(map(str, simulate_bureau_history(people.repartition(7).union(people), "k", "2023-01-15", "2023-12-31", seed=5).collect()))


MIXED = {"x": {"type": "float", "low": -10, "high": 10}, "n": {"type": "int", "low": 1, "high": 100}, "lr": {"type": "float", "low": 1e-5, "high": 1.0, "log": True}, "kind": {"type": "categorical", "choices": ["a", "b", "c"]}}


def nested(suggest):
    """The parameters depend on the kind; both kinds have a ``depth`` with another best place."""
    kind = suggest.suggest_categorical("kind", ["tree", "line"])
    if kind == "tree":
        return {"kind": kind, "depth": suggest.suggest_int("depth", 1, 40), "share": suggest.suggest_float("share", 0, 1)}
    return {"kind": kind, "rate": suggest.suggest_float("rate", 1e-6, 1, log=True), "power": suggest.suggest_float("power", 0, 4)}


SIDES = {f"x{k}": {"type": "float", "low": -5, "high": 5} for k in range(3)}
FUNCTIONS = {
    "mixed": (MIXED, lambda p: (p["x"] - 3) ** 2 + (p["n"] - 70) ** 2 / 100 + math.log10(p["lr"] / 1e-2) ** 2 + (p["kind"] != "b") * 5),
    "nested": (nested, lambda p: abs(p["depth"] - 17) / 4 + 4 * (p["share"] - 0.8) ** 2 if p["kind"] == "tree" else 1 + math.log10(p["rate"] / 1e-3) ** 2 + (p["power"] - 1) ** 2),
    "waves": (SIDES, lambda p: sum((v - 1) ** 2 + 4 * (1 - math.cos(math.pi * (v - 1))) for v in p.values())),
}


def best_found(space, loss, sampler, seed, trials=60):
    rng, done = random.Random(seed), []
    for number in range(trials):
        params = modelling.proposed(space, rng, done, "minimize", sampler=sampler)
        done.append(modelling.Trial(number, params, loss(params)))
    return min(t.value for t in done), done


@pytest.mark.parametrize("name", FUNCTIONS)
def test_density_search_beats_the_others(name):
    space, loss = FUNCTIONS[name]
    mean = {s: sum(best_found(space, loss, s, seed)[0] for seed in range(20)) / 20 for s in modelling.SAMPLERS}
    assert mean["density"] < mean["adaptive"] and mean["density"] < 0.6 * mean["random"], mean


def test_samplers_stay_in_their_space():
    for sampler in modelling.SAMPLERS:
        for t in best_found(*FUNCTIONS["mixed"], sampler, 1)[1]:
            p = t.params
            assert -10 <= p["x"] <= 10 and 1 <= p["n"] <= 100 and type(p["n"]) is int and 1e-5 <= p["lr"] <= 1.0 and p["kind"] in "abc"
        assert best_found(*FUNCTIONS["nested"], sampler, 1)[1] == best_found(*FUNCTIONS["nested"], sampler, 1)[1]
    assert modelling.drawn({"n": {"type": "int", "low": 2, "high": 9, "step": 3}}, random.Random(1))["n"] in (2, 5, 8)
    assert modelling.RatioSuggest(random.Random(1), [{"x": 1.0}], []).suggest_float("x", 1.0, 1.0) == 1.0
    with pytest.raises(ValueError):
        modelling.proposed({}, random.Random(1), [], sampler="grid")


def test_densities():
    d = modelling.Density([1.0, 1.1, 4.0], 0.0, 5.0)
    width = 0.001
    assert sum(d.at(i * width) for i in range(5000)) * width == pytest.approx(1.0, abs=1e-3)
    assert d.at(1.05) > d.at(2.5) and modelling.Density([], 0.0, 2.0).at(1.0) == 0.5
    rng = random.Random(5)
    drawn = [d.draw(rng) for _ in range(4000)]
    assert min(drawn) >= 0 and max(drawn) <= 5
    for low, high in ((0, 1), (1, 2), (3.5, 4.5)):
        assert sum(low <= v < high for v in drawn) / 4000 == pytest.approx(sum(d.at(low + i * width) for i in range(int((high - low) / width))) * width, abs=0.03)


def test_doctor(capsys):
    report = doctor()
    assert report["capabilities"]["spark"] == "READY" and "READY" in capsys.readouterr().out and report["result"] == "READY"
    wanted = doctor(backend="spark", model="lightgbm", save_model_to="mlflow", verbose=False)
    assert set(wanted["blocking"]) == {"lightgbm models", "mlflow storage"} and wanted["result"] == "NOT AVAILABLE" and capsys.readouterr().out == ""
    for bad in ({"model": "random_forest"}, {"backend": "dask"}, {"backend": "spark", "model": "x"}):
        with pytest.raises(ValueError):
            doctor(**bad)
    assert [version_state(v, (3, 5)) for v in ("3.5.0", "3.10", "3.4.9", "4", "4.0.0+abc", "4.0rc1", None)] == ["READY", "READY", "INCOMPATIBLE", "READY", "READY", "PARTIAL", "NOT AVAILABLE"]
    parts = {n: {"version": "99.0", "error": None} for n in (*LEAST, "java")} | {"numpy": {"version": None, "error": "OSError"}}
    off = {"running": False, "version": None, "jvm": None, "error": None}
    assert judged(parts, off)[1]["spark"] == "PARTIAL"
    parts["numpy"] = {"version": "99.0", "error": None}
    assert judged(parts, off)[1]["spark"] == "READY" and judged(parts, off | {"running": True, "version": "98.0", "jvm": True})[1]["spark"] == "PARTIAL"


def test_frames_to_be_scored_are_checked(data):
    for bad in (data.withColumn("signal", F.lit(float("inf"))), data.withColumn("signal", F.lit(None).cast("double")), data.withColumn("target", F.lit(2))):
        with pytest.raises(ValueError):
            modelling.train_model("x", "target", ["signal"], data, bad, save_model_to="none")
