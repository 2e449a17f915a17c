"""Classifier training, scoring, cross-validation, hyper-parameter search and model storage with Spark ML."""

from __future__ import annotations

import json
import math
import random
import re
import uuid
import warnings
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import partial
from pathlib import Path
from statistics import NormalDist
from typing import Any

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from riskloom.core.checks import col, present, reject, require_columns, require_numeric
from riskloom.core.jobs import side_by_side
from riskloom.functions.ranking import placed
from riskloom.operators import cube
from riskloom.operators.selection import supervised

RESERVED = {"score", "features", "rawPrediction", "probability", "prediction"}
CLASSIFIERS = {"logistic_regression": LogisticRegression, "decision_tree": DecisionTreeClassifier, "random_forest": RandomForestClassifier, "gradient_boosting": GBTClassifier}
STRATEGIES = ("stratified", "kfold", "group", "time_series", "expanding")


@contextmanager
def cached(df: DataFrame):
    """The frame persisted for a block of work, and released after it."""
    df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def classifier(model: str | Estimator, target: str, params: dict | None = None, random_state: int = 42) -> Estimator:
    """A Spark ML classifier by name, or a copy of one that was given, set to the columns used here."""
    if isinstance(model, str):
        if model in ("lightgbm", "lgbm"):
            raise ImportError("the lightgbm model needs a LightGBM package for Spark, which is not installed")
        if model not in CLASSIFIERS:
            raise ValueError(f"model must be one of {', '.join(CLASSIFIERS)} or an estimator")
        made = CLASSIFIERS[model]()
        if made.hasParam("seed"):
            made.set(made.getParam("seed"), random_state)
    else:
        made = model.copy()
        if lacking := [p for p in ("featuresCol", "labelCol", "predictionCol", "probabilityCol", "rawPredictionCol") if not made.hasParam(p)]:
            raise ValueError(f"the estimator lacks {', '.join(lacking)}")
    fixed = {"featuresCol": "features", "labelCol": target, "predictionCol": "prediction", "probabilityCol": "probability", "rawPredictionCol": "rawPrediction"}
    for name, value in {**(params or {}), **fixed}.items():
        if not made.hasParam(name):
            raise ValueError(f"the model has no parameter {name!r}")
        made.set(made.getParam(name), value)
    return made


def fitted(train: DataFrame, target: str, features: Sequence[str], model: str | Estimator, params: dict | None = None, random_state: int = 42, weight_col: str | None = None) -> PipelineModel:
    params = {**(params or {}), "weightCol": weight_col} if weight_col else params
    stages = [VectorAssembler(inputCols=list(features), outputCol="features"), classifier(model, target, params, random_state)]
    return Pipeline(stages=stages).fit(train.withColumn(target, col(target).cast("double")))


def coded(df: DataFrame, target: str) -> DataFrame:
    """``df`` with the target as a number: texts by their place in alphabetical order (the classes, a few, reach the driver)."""
    if not isinstance(df.schema[target].dataType, StringType):
        return df
    indexer = StringIndexer(inputCol=target, outputCol="__class", stringOrderType="alphabetAsc").fit(df)
    return indexer.transform(df).drop(target).withColumnRenamed("__class", target)


def scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The frame with the model's columns and ``score``, the probability of class 1."""
    return model.transform(df).withColumn("score", vector_to_array("probability")[1])


def importances(model: PipelineModel, features: Sequence[str]) -> list[dict[str, Any]]:
    """``feature, importance`` (or coefficient; of several classes the mean size), the largest in size first."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    elif hasattr(last, "coefficientMatrix") and last.numClasses > 2:
        values = abs(last.coefficientMatrix.toArray()).mean(axis=0)
    else:
        values = last.coefficients.toArray() if hasattr(last, "coefficients") else []
    rows = [{"feature": f, "importance": float(v)} for f, v in zip(features, values, strict=bool(len(values)))] if len(values) else []
    return sorted(rows, key=lambda r: -abs(r["importance"]))


def evaluate(df: DataFrame, target: str, n_tiles: int) -> dict[str, float]:
    """KS, AUC and Gini of a scored frame by tiles."""
    row = cube.calculate_metrics(df.select("score", target), None, "score", target, n_tiles).first()
    return {"ks": row["KS"], "auc": row["AUC"], "gini": row["Gini"]}


@dataclass
class TrainingResult:
    model: PipelineModel
    oot_predictions: DataFrame
    scoring_predictions: DataFrame | None
    metrics: dict[str, float]
    feature_importance: list[dict]
    output_dir: Path | str | None = None
    run_id: str | None = None
    save_model_to: str = "folder"
    model_uri: str | None = None
    model_format: str | None = None
    analysis_cube: DataFrame | None = None


def _checked(df: DataFrame, target: str, features: Sequence[str]) -> list[str]:
    if len(set(features)) != len(list(features)) or not features or target in features:
        raise ValueError("features must be different, at least one, and exclude the target")
    if set([target, *features]) & RESERVED:
        raise ValueError(f"column names are reserved: {', '.join(sorted(RESERVED))}")
    return supervised(df, target, features)


def _evaluation_frame(df: DataFrame, target: str | None, features: Sequence[str]) -> None:
    """Checks, in one job, that a frame to be scored has numeric, finite features and, with a target, only 0 and 1 in it."""
    require_columns(df, [*features, *([target] if target else [])])
    require_numeric(df, features)
    values = [col(f).cast("double") for f in features]
    faults = {f"feature {f!r} must be finite and without nulls in rows to be scored": ~present(v) | (F.abs(v) == math.inf) for f, v in zip(features, values, strict=True)}
    if target:
        y = col(target).cast("double")
        faults |= {"out-of-time targets must be 0 or 1 and not null": ~present(y) | ~y.isin(0.0, 1.0)}
    reject(df, faults)


def train_model(run_name: str, target_col: str, feature_cols: Sequence[str], train_df: DataFrame, oot_df: DataFrame, model: str | Estimator = "logistic_regression", *, model_params: dict | None = None, random_state: int = 42, df_scoring: DataFrame | None = None, output_dir: str | Path = "models", save_model_to: str = "folder", n_tiles: int = 10, overwrite: bool = False, analysis_cube: dict | None = None) -> TrainingResult:
    """Fits on the training rows, scores the out-of-time rows, measures, and stores model and reports in a run folder.

    ``save_model_to``: ``folder``, ``none``, or ``mlflow`` (which needs that package). ``analysis_cube``:
    options of :func:`riskloom.operators.cube.calculate_metrics` over the out-of-time rows, kept lazy.
    """
    if save_model_to not in ("folder", "none", "mlflow"):
        raise ValueError("save_model_to must be folder, none or mlflow")
    if save_model_to == "mlflow":
        try:
            import mlflow  # noqa: F401
        except ImportError as error:
            raise ImportError("save_model_to='mlflow' needs the mlflow package") from error
    features = _checked(train_df, target_col, list(feature_cols))
    _evaluation_frame(oot_df, target_col, features)
    if df_scoring is not None:
        _evaluation_frame(df_scoring, None, features)
    made = fitted(train_df, target_col, features, model, model_params, random_state)
    oot = scored(made, oot_df)
    result = TrainingResult(made, oot, scored(made, df_scoring) if df_scoring is not None else None, evaluate(oot, target_col, n_tiles), importances(made, features), save_model_to=save_model_to)
    if analysis_cube is not None:
        result.analysis_cube = cube.calculate_metrics(oot, target_column=target_col, **analysis_cube)
    if save_model_to == "folder":
        _store(train_df.sparkSession, result, run_name, features, target_col, model, model_params, output_dir, overwrite)
    return result


def written(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small report through Spark's file system, where the model goes too."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _store(spark: SparkSession, result: TrainingResult, run_name: str, features: Sequence[str], target: str, model: str | Estimator, params: dict | None, folder: str | Path, overwrite: bool) -> None:
    """Model and reports in a run folder of their own; ``folder`` may be a path or an address of any store that Spark writes to."""
    result.run_id = uuid.uuid4().hex
    name = f"{re.sub(r'[^A-Za-z0-9_-]+', '_', run_name).strip('_') or 'run'}_{result.run_id}"
    root = f"{str(folder).rstrip('/')}/{name}"
    result.output_dir = root if "://" in root else Path(root)
    path = f"{root}/model"
    save_model(result.model, path, overwrite=overwrite)
    result.model_uri, result.model_format = str(path), "spark"
    info = {"run_name": run_name, "run_id": result.run_id, "backend": "pyspark", "target": target, "features": list(features), "model": model if isinstance(model, str) else type(model).__name__, "params": {k: str(v) for k, v in (params or {}).items()}}
    for name, content in (("model_info.json", info), ("metrics.json", result.metrics), ("metadata.json", {"model_format": "spark", "run_id": result.run_id})):
        written(spark, f"{root}/{name}", json.dumps(content, indent=2))
    lines = ["feature,importance", *(f"{r['feature']},{r['importance']!r}" for r in result.feature_importance)]
    written(spark, f"{root}/feature_importance.csv", "\n".join(lines) + "\n")


def save_model(model: PipelineModel, path: str | Path, format: str = "spark", *, overwrite: bool = False) -> None:
    if format != "spark":
        raise ValueError(f"a Spark model can't be stored as {format!r}")
    writer = model.write()
    (writer.overwrite() if overwrite else writer).save(str(path))


def load_model(path: str | Path, format: str = "spark", *, model_class: type | None = None) -> Any:
    if format != "spark":
        raise ValueError(f"can't load the format {format!r}")
    return (model_class or PipelineModel).load(str(path))


# Folds.


def with_folds(df: DataFrame, target: str, cv: int = 5, strategy: str = "stratified", *, group_col: str | None = None, date_col: str | None = None, fold_col: str | None = None, random_state: int = 42, order_cols: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``fold`` in [0, cv): a given column, whole groups by hash, time blocks of equal size, or an even deal in hash order.

    Hashes are of the rows' own values (or ``order_cols``), so folds stay the same however rows are dealt.
    Ranks are made without a window over the whole table, or over the rows of one day, or over rows that are
    alike (:func:`riskloom.functions.ranking.placed`); equal rows may change places, not counts.
    """
    if type(cv) is not int or cv < 2:
        raise ValueError("cv must be an integer of at least 2")
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
    if fold_col:
        value = col(fold_col)
        if df.agg(F.max((value.isNull() | ~value.cast("double").isin(*map(float, range(cv)))).cast("int"))).first()[0]:
            raise ValueError("fold_col must hold whole numbers in [0, cv)")
        return df.withColumn("fold", value.cast("int"))
    if strategy == "group" or group_col:
        if not group_col:
            raise ValueError("the group strategy needs group_col")
        return df.withColumn("fold", F.pmod(F.xxhash64(col(group_col), F.lit(random_state)), F.lit(cv)).cast("int"))
    names = list(order_cols) or df.columns
    if strategy in ("time_series", "expanding"):
        if not date_col:
            raise ValueError("time folds need date_col")
        timed = df.withColumn("__when", F.unix_micros(col(date_col).cast("timestamp")).cast("double"))
        ranked = placed(timed, [], "__when", order_cols)
        return ranked.withColumn("fold", F.floor((F.col("__row") - 1) * cv / F.col("__rows")).cast("int")).drop("__row", "__rows", "__when")
    dealt = df.withColumn("__deal", F.xxhash64(F.lit(random_state), *[col(c) for c in names]).cast("double"))
    ranked = placed(dealt, [target] if strategy == "stratified" else [], "__deal")
    return ranked.withColumn("fold", F.pmod(F.col("__row") - 1, F.lit(cv)).cast("int")).drop("__row", "__rows", "__deal")


def _part(fold: int, strategy: str) -> tuple[Column, Column]:
    """Which rows train in the round of a fold, and which are measured."""
    return F.col("fold") < fold if strategy == "expanding" else F.col("fold") != fold, F.col("fold") == fold


def _folds(cv: int, strategy: str) -> range:
    return range(1 if strategy == "expanding" else 0, cv)


def rounds(folded: DataFrame, cv: int, strategy: str = "stratified") -> list[tuple[int, DataFrame, DataFrame]]:
    """(fold, training rows, rows to measure) of each round: all other folds train, or, ``expanding``, the earlier ones (cv - 1 rounds).

    Each frame holds the whole plan of ``folded``, which is to be cached first.
    """
    return [(k, *(folded.where(x) for x in _part(k, strategy))) for k in _folds(cv, strategy)]


def in_rounds(folded: DataFrame, cv: int, strategy: str = "stratified") -> DataFrame:
    """The rows of all :func:`rounds` in one frame: ``folded`` with ``round`` and ``side`` (train or held), a row for each round that it is in."""
    told = [F.when(x, F.struct(F.lit(k).alias("round"), F.lit(side).alias("side"))) for k in _folds(cv, strategy) for side, x in zip(("train", "held"), _part(k, strategy), strict=True)]
    return folded.withColumn("__in", F.explode(F.array_compact(F.array(*told)))).select("*", "__in.*").drop("__in")


@dataclass
class CrossValidationResult:
    fold_metrics: list[dict]
    summary: list[dict]
    models: list[PipelineModel] | None = None

    def mean(self, metric: str) -> float:
        return next(r["mean"] for r in self.summary if r["metric"] == metric)


def _summary(records: list[dict], names: Sequence[str]) -> list[dict]:
    out = []
    for name in names:
        values = [r[name] for r in records if math.isfinite(r[name])]
        mean = sum(values) / len(values) if values else math.nan
        spread = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values)) if values else math.nan
        out.append({"metric": name, "mean": mean, "std": spread, "min": min(values, default=math.nan), "max": max(values, default=math.nan)})
    return out


def cross_validate(df: DataFrame, target_col: str, feature_cols: Sequence[str], model: str | Estimator = "logistic_regression", model_params: dict | None = None, cv: int = 5, strategy: str = "stratified", group_col: str | None = None, date_col: str | None = None, fold_col: str | None = None, metrics: Sequence[str] = ("ks", "auc", "gini"), return_train_metrics: bool = False, random_state: int = 42, n_tiles: int = 10, return_models: bool = False, parallelism: int = 1) -> CrossValidationResult:
    """Fits and measures each fold; folds are assigned once and cached while the loop runs.

    ``expanding`` trains on earlier time blocks only (cv - 1 rounds); all other strategies on all other folds. Up to
    ``parallelism`` folds run at a time.
    """
    if not metrics or set(metrics) - {"ks", "auc", "gini"}:
        raise ValueError("metrics must be some of ks, auc, gini")
    features = _checked(df, target_col, list(feature_cols))
    wanted = [m.upper() for m in metrics]
    folded = with_folds(df, target_col, cv, strategy, group_col=group_col, date_col=date_col, fold_col=fold_col, random_state=random_state).select(target_col, *features, "fold")

    def one(fold: int, train: DataFrame, held: DataFrame) -> tuple[dict, PipelineModel]:
        made = fitted(train, target_col, features, model, model_params, random_state)
        parts = {"": held} | ({"train_": train} if return_train_metrics else {})
        found = {f"{p}{k.upper()}": v for p, rows in parts.items() for k, v in evaluate(scored(made, rows), target_col, n_tiles).items() if k in metrics}
        return {"fold": fold + 1, **found}, made

    with cached(folded):
        done = side_by_side(df.sparkSession, [partial(one, *x) for x in rounds(folded, cv, strategy)], parallelism)
    records, models = [r for r, _ in done], [m for _, m in done]
    names = wanted + [f"train_{m}" for m in wanted] * return_train_metrics
    return CrossValidationResult(records, _summary(records, names), models if return_models else None)


# Search.


@dataclass
class Trial:
    number: int
    params: dict[str, Any]
    value: float = math.nan
    values: dict[str, float] = field(default_factory=dict)
    residual: float = 0.0

    @property
    def violation(self) -> float:
        return max(0.0, self.residual)

    @property
    def feasible(self) -> bool:
        return self.residual <= 0


@dataclass
class OptimizationResult:
    best_params: dict[str, Any]
    best_trial: Trial
    trials: list[Trial]
    training_result: TrainingResult
    constraint_satisfied: bool | None


class Suggest:
    """Draws parameters of a trial; the methods that search spaces given as functions call.

    With ``good`` parameters of earlier trials, most draws are taken near one of these, the nearer the more
    trials there were (``width``, as a share of the range); the others, and all of the first trials, are
    drawn from the whole range.
    """

    def __init__(self, rng: random.Random, good: Sequence[dict[str, Any]] = (), width: float = 1.0):
        self.rng, self.good, self.width, self.params = rng, list(good), width, {}

    def _near(self, name: str) -> Any:
        """A good earlier value to stay near, or None for a draw from the whole range."""
        known = [g[name] for g in self.good if name in g]
        return self.rng.choice(known) if known and self.rng.random() < 0.8 else None

    def _number(self, name: str, low: float, high: float, log: bool) -> float:
        into, back = (math.log, math.exp) if log else (float, float)
        a, b, near = into(low), into(high), self._near(name)
        value = self.rng.uniform(a, b) if near is None else self.rng.gauss(into(near), self.width * (b - a))
        return back(min(b, max(a, value)))

    def suggest_float(self, name: str, low: float, high: float, *, step: float | None = None, log: bool = False) -> float:
        value = self._number(name, low, high, log)
        if step:
            value = low + round((value - low) / step) * step
        return self.params.setdefault(name, min(high, max(low, value)))

    def suggest_int(self, name: str, low: int, high: int, *, step: int = 1, log: bool = False) -> int:
        value = self._number(name, low, high, log) if log else self._number(name, low - step / 2, high + step / 2, False)
        return self.params.setdefault(name, int(min(low + (high - low) // step * step, max(low, low + round((value - low) / step) * step))))

    def suggest_categorical(self, name: str, choices: Sequence[Any]) -> Any:
        near = self._near(name)
        return self.params.setdefault(name, near if near in list(choices) else self.rng.choice(list(choices)))


@dataclass
class Density:
    """A kernel density over [low, high]: a truncated normal curve at each value, and one flat share of the same weight.

    A curve is as wide as the larger gap to its neighbours, within bounds that close in as values gather.
    """

    values: Sequence[float]
    low: float
    high: float

    def __post_init__(self) -> None:
        span, known = self.high - self.low, sorted(self.values)
        edged = [self.low, *known, self.high]
        gaps = [max(x - before, after - x) for before, x, after in zip(edged, edged[1:], edged[2:], strict=False)]
        self.curves = [NormalDist(x, min(span, max(gap, span / min(100, 2 * (len(known) + 1))))) for x, gap in zip(known, gaps, strict=True)]
        self.ends = [(c.cdf(self.low), c.cdf(self.high)) for c in self.curves]

    def draw(self, rng: random.Random) -> float:
        at = rng.randrange(len(self.curves) + 1)
        if at == len(self.curves):
            return rng.uniform(self.low, self.high)
        share = rng.uniform(*self.ends[at])
        return self.curves[at].inv_cdf(share) if 0 < share < 1 else rng.uniform(self.low, self.high)

    def at(self, value: float) -> float:
        heights = [c.pdf(value) / (above - under) for c, (under, above) in zip(self.curves, self.ends, strict=True)]
        return (sum(heights) + 1 / (self.high - self.low)) / (len(heights) + 1)


class RatioSuggest(Suggest):
    """Draws where good trials are dense and the others are not.

    For each parameter two densities are made, of its values in ``good`` and in ``other`` trials (only of trials
    that have it, so that parts of nested spaces don't disturb one another); of ``draws`` values from the first
    the one with the largest ratio of both is taken. Categories have smoothed shares for densities.
    """

    def __init__(self, rng: random.Random, good: Sequence[dict[str, Any]], other: Sequence[dict[str, Any]], draws: int = 24):
        super().__init__(rng, good)
        self.other, self.draws = list(other), draws

    def _known(self, name: str) -> tuple[list[Any], list[Any]]:
        return tuple([p[name] for p in side if name in p] for side in (self.good, self.other))

    def _number(self, name: str, low: float, high: float, log: bool) -> float:
        into, back = (math.log, math.exp) if log else (float, float)
        if low == high:
            return low
        good, other = (Density([min(into(high), max(into(low), into(v))) for v in values], into(low), into(high)) for values in self._known(name))
        tried = [good.draw(self.rng) for _ in range(self.draws)]
        return back(max(tried, key=lambda v: good.at(v) / other.at(v)))

    def suggest_categorical(self, name: str, choices: Sequence[Any]) -> Any:
        places = range(len(choices))
        good, other = ([(sum(v == choices[i] for v in values) + 1) / (len(values) + len(choices)) for i in places] for values in self._known(name))
        tried = self.rng.choices(places, good, k=max(1, self.draws // 8))
        return self.params.setdefault(name, choices[max(tried, key=lambda i: good[i] / other[i])])


def drawn(space: dict | Callable, suggest: Suggest | random.Random) -> dict[str, Any]:
    """The parameters that a space, a table or a function, takes from the draws; from a generator alone: from whole ranges."""
    suggest = Suggest(suggest) if isinstance(suggest, random.Random) else suggest
    if callable(space):
        return dict(space(suggest))
    for name, spec in space.items():
        if spec.get("type") == "categorical":
            suggest.suggest_categorical(name, spec["choices"])
        elif spec.get("type") in ("float", "int"):
            options = {k: spec[k] for k in ("step", "log") if spec.get(k)}
            getattr(suggest, f"suggest_{spec['type']}")(name, spec["low"], spec["high"], **options)
        else:
            raise ValueError(f"parameter {name!r} must be of type float, int or categorical")
    return suggest.params


SAMPLERS = ("density", "adaptive", "random")


def proposed(space: dict | Callable, rng: random.Random, trials: Sequence[Trial], direction: str = "maximize", startup: int = 8, sampler: str = "density") -> dict[str, Any]:
    """Parameters of the next trial: random ones at first, then by the trials so far (feasible ones first, then by value).

    ``density``: by the ratio of the densities of the best trials and the others (:class:`RatioSuggest`);
    ``adaptive``: mostly near one of the best quarter; ``random``: always random. A space given as a function
    must return its draws under the names that it drew them by, for those to be learned from.
    """
    if sampler not in SAMPLERS:
        raise ValueError(f"sampler must be one of {', '.join(SAMPLERS)}")
    done = [t for t in trials if math.isfinite(t.value)]
    if sampler == "random" or len(done) < startup:
        return drawn(space, rng)
    best = [t.params for t in sorted(done, key=lambda t: (not t.feasible, t.violation, t.value if direction == "minimize" else -t.value, t.number))]
    if sampler == "adaptive":
        return drawn(space, Suggest(rng, best[: max(2, len(done) // 4)], 0.5 / math.sqrt(len(done))))
    first = min(25, math.ceil(len(best) * 0.1))
    return drawn(space, RatioSuggest(rng, best[:first], best[first:]))


def derived(train: dict[str, float], cv: dict[str, float], oot: dict[str, float]) -> dict[str, float]:
    """train_, cv_ and oot_ values, and how far oot lies from the others, signed and absolute."""
    if not train or not set(train) == set(cv) == set(oot):
        raise ValueError("train, cv and oot must have the same metrics")
    out = {}
    for m in cv:
        sides = {"train": train[m], "cv": cv[m], "oot": oot[m]}
        if not all(isinstance(v, (int, float)) and math.isfinite(v) for v in sides.values()):
            raise ValueError(f"metric {m} is missing or not finite")
        out |= {f"{s}_{m}": float(v) for s, v in sides.items()} | {m: float(cv[m]), f"{m}_shift": oot[m] - cv[m]}
        for s in ("train", "cv"):
            out |= {f"{s}_oot_{m}_shift": oot[m] - sides[s], f"{s}_oot_{m}_abs_shift": abs(oot[m] - sides[s])}
    return out


def chosen(trials: Sequence[Trial], direction: str, constrained: bool) -> Trial:
    """The best feasible trial, else the one that violates least; ties go to the earlier one."""
    done = [t for t in trials if math.isfinite(t.value)]
    if not done:
        raise ValueError("no trial has finite metrics")
    best = min(done, key=lambda t: (not t.feasible, t.violation, t.value if direction == "minimize" else -t.value, t.number))
    if constrained and not best.feasible:
        warnings.warn(f"no feasible trial; trial {best.number} violates least ({best.violation:.6g})", RuntimeWarning, stacklevel=2)
    return best


def optimize(train_df: DataFrame, oot_df: DataFrame, target_col: str, feature_cols: Sequence[str], model: str | Estimator, search_space: dict | Callable, objective_metric: str = "ks", direction: str = "maximize", n_trials: int = 50, cv: int = 5, metrics: Sequence[str] = ("ks", "auc", "gini"), *, save_as: str = "none", save_path: str | Path = "models", study_name: str = "study", random_state: int = 42, n_tiles: int = 10, target_metric: str | None = None, target_limit: float | None = None, target_operator: str = "<=", sampler: str = "density", parallelism: int = 1) -> OptimizationResult:
    """Search from a seed: each trial is cross-validated and fitted whole; the chosen parameters are fitted and stored at last.

    ``sampler``: see :func:`proposed`. Trials follow one another; up to ``parallelism`` folds of one run at a time.

    ``target_metric`` (one of the values of :func:`derived`) with ``target_limit`` bounds what may be chosen.
    """
    if sampler not in SAMPLERS:
        raise ValueError(f"sampler must be one of {', '.join(SAMPLERS)}")
    if direction not in ("maximize", "minimize") or target_operator not in ("<=", ">=") or type(n_trials) is not int or n_trials < 1:
        raise ValueError("direction must be maximize or minimize, the operator <= or >=, n_trials at least 1")
    if (target_metric is None) != (target_limit is None):
        raise ValueError("target_metric and target_limit belong together")
    rng, trials = random.Random(random_state), []
    for number in range(n_trials):
        params = proposed(search_space, rng, trials, direction, sampler=sampler)
        validated = cross_validate(train_df, target_col, feature_cols, model, params, cv, metrics=metrics, random_state=random_state, n_tiles=n_tiles, parallelism=parallelism)
        made = fitted(train_df, target_col, list(feature_cols), model, params, random_state)
        whole, late = ({m: evaluate(scored(made, x), target_col, n_tiles)[m] for m in metrics} for x in (train_df, oot_df))
        values = derived(whole, {m: validated.mean(m.upper()) for m in metrics}, late)
        if objective_metric not in values or target_metric is not None and target_metric not in values:
            raise ValueError(f"metrics must be some of {', '.join(values)}")
        residual = 0.0 if target_metric is None else (values[target_metric] - target_limit) * (1 if target_operator == "<=" else -1)
        trials.append(Trial(number, params, values[objective_metric], values, residual))
    best = chosen(trials, direction, target_metric is not None)
    result = train_model(study_name, target_col, feature_cols, train_df, oot_df, model, model_params=best.params, random_state=random_state, output_dir=save_path, save_model_to=save_as, n_tiles=n_tiles)
    return OptimizationResult(best.params, best, trials, result, best.feasible if target_metric is not None else None)
