"""Jobs side by side, and bootstrap samples as weights."""

import math
import threading
import time
from collections import Counter
from functools import partial

import pytest
from pyspark.sql import functions as F

from riskloom.core.jobs import side_by_side
from riskloom.functions.resampling import collapsed, poisson_limits, resampled
from riskloom.operators import modelling, search


def test_results_in_order_and_a_bound(spark):
    going, most, lock = [0], [0], threading.Lock()

    def task(k):
        with lock:
            going[0] += 1
            most[0] = max(most[0], going[0])
        count = spark.range(k).count()
        time.sleep(0.05)
        with lock:
            going[0] -= 1
        return count

    assert side_by_side(spark, [partial(task, k) for k in range(9)], 3) == list(range(9)) and 1 < most[0] <= 3
    assert side_by_side(spark, [], 4) == [] and side_by_side(spark, [partial(task, 5)], 4) == [5]
    with pytest.raises(ValueError):
        side_by_side(spark, [], 0)


def test_threads_take_over_local_properties(spark):
    context = spark.sparkContext
    context.setLocalProperty("spark.job.description", "search")
    try:
        seen = side_by_side(spark, [lambda: (context.getLocalProperty("spark.job.description"), context.getLocalProperty("spark.scheduler.pool"))] * 3, 2, pool="fits")
    finally:
        context.setLocalProperty("spark.job.description", None)
    assert seen == [("search", "fits")] * 3 and context.getLocalProperty("spark.scheduler.pool") is None and not context.getJobTags()


def test_a_failure_stops_the_others(spark):
    slow = F.udf(lambda x: time.sleep(0.05) or x, "long")
    started = []

    def failing():
        time.sleep(1)
        raise KeyError("planned")

    def long_job():
        return spark.range(0, 2000, 1, 2).select(slow("id").alias("x")).agg(F.sum("x")).first()

    began = time.time()
    with pytest.raises(KeyError):
        side_by_side(spark, [long_job, failing, long_job, lambda: started.append(1)], 2)
    assert time.time() - began < 30 and not started
    assert not [t for t in threading.enumerate() if t.name.startswith("ThreadPoolExecutor")]


@pytest.fixture(scope="module")
def rows(spark):
    parts = [(float(i % 2) + 0.02 * (i % 7), float(i * 37 % 11), i % 2, "ab"[i // 24 % 2]) for i in range(96)]
    return spark.createDataFrame(parts, "signal double, noise double, target int, part string").cache()


def test_poisson_weights(spark):
    for mean in (0.1, 0.8, 1.0):
        limits = poisson_limits(mean)
        assert limits == sorted(set(limits)) and (limits[0] + 2**63) / 2**64 == pytest.approx(math.exp(-mean))
    many = spark.range(40_000).select((F.col("id") % 20_000).alias("x"), F.lit(None).cast("string").alias("g"))
    pieces = collapsed(many.unionByName(many.limit(0)), ["x", "g"])
    assert pieces.count() == 20_000 and pieces.agg(F.sum("__n")).first()[0] == 40_000
    drawn = resampled(pieces, 0.8, 7).select("__weight").collect()
    # Two alike rows: a Poisson number of mean 1.6.
    shares, n = Counter(int(r[0]) for r in drawn), 20_000
    shares[0] = n - len(drawn)
    for k in range(6):
        assert shares[k] / n == pytest.approx(math.exp(-1.6) * 1.6**k / math.factorial(k), abs=0.012)
    other = {r["x"]: r["__weight"] for r in resampled(pieces, 0.8, 8).collect()}
    assert other != {r["x"]: r["__weight"] for r in resampled(pieces, 0.8, 7).collect()}


def test_one_value_is_spread(spark):
    same = spark.range(100_000).select(F.lit(1).alias("x"))
    pieces = collapsed(same, ["x"], piece=1000)
    per_task = [r["n"] for r in pieces.groupBy(F.spark_partition_id()).agg(F.sum("__n").alias("n")).collect()]
    assert len(per_task) == 4 and sum(per_task) == 100_000 and max(per_task) <= 50_000
    assert resampled(pieces, 1.0, 3).agg(F.sum("__weight")).first()[0] == pytest.approx(100_000, abs=1500)
    assert collapsed(same.limit(0), ["x"]).count() == 0


@pytest.mark.parametrize("method,options", [("l1", {"reg_param": 0.15}), ("feature_importance", {"top_k": 1, "model_params": {"numTrees": 3, "maxDepth": 2}})])
def test_stability_does_not_depend_on_partitions(rows, method, options):
    found = [search.stability_selection(df, "target", ["signal", "noise"], method=method, n_iterations=3, group_by="part", selector_kwargs=options, parallelism=p).feature_table for df, p in ((rows.repartition(2), 1), (rows.repartition(16), 3))]
    assert found[0] == found[1] and found[0][0]["frequency"] == 1.0
    with pytest.raises(ValueError):
        search.stability_selection(rows, "target", ["signal"], method=method, selector_kwargs={"weight_col": "noise"})


def test_searches_give_the_same_side_by_side(rows):
    folded = rows.withColumn("fold", (F.col("noise") % 2).cast("int"))
    both, few = ["signal", "noise"], {"model_params": {"maxIter": 2}}
    for run in (
        lambda p: search.sequential_selection(folded, "target", both, cv=2, fold_col="fold", n_tiles=4, parallelism=p, **few).history,
        lambda p: search.rfecv(folded, "target", both, cv=2, fold_col="fold", n_tiles=4, nested=True, parallelism=p, **few).history,
        lambda p: modelling.cross_validate(folded, "target", both, cv=2, fold_col="fold", n_tiles=4, parallelism=p, **few).fold_metrics,
    ):
        assert run(1) == run(2)


def test_what_a_result_says_of_its_last_model(rows):
    plain = search.l1_selection(rows, "target", ["signal", "noise"], reg_param=0.1, max_iter=5)
    assert plain.metadata["evaluation_status"] == "not_requested" and plain.metadata["input_features"] == ["signal", "noise"] and plain.model is None
    late = search.l1_selection(rows, "target", ["signal", "noise"], reg_param=0.1, max_iter=5, oot_df=rows, n_tiles=4)
    assert late.metadata["evaluation_status"] == "evaluated" and late.metadata["model_feature_cols"] == ["signal"] and late.model is late.training_result.model
    none = search.l1_selection(rows, "target", ["noise"], reg_param=9.0, oot_df=rows, n_tiles=4)
    assert none.metadata["evaluation_status"] == "no_selected_features" and none.training_result is None
    with pytest.raises(ValueError):
        search.l1_selection(rows, "target", ["signal"], df_scoring=rows)
