"""How large plans are, and what they broadcast: they are planned, described and kept by the driver."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskloom.functions.neighbours import neighbour_information
from riskloom.functions.ranking import placed, running, tiled
from riskloom.operators import cube, modelling, search
from riskloom.plans import registry


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("partitions", ["4", "2000"])
def test_quantiles_stand_in_the_plan_once_for_each_read(spark, partitions):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"), (F.col("id") % 7).alias("t"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert planned(placed(df, [], "v", ["t"])).count("scalar-subquery") <= 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("strategy,lines", [("expanding", 6), ("time_series", 8)])
def test_rounds_in_one_frame_are_the_rounds(spark, strategy, lines):
    folded = spark.range(100).withColumn("fold", (F.col("id") % 4).cast("int"))
    together = modelling.in_rounds(folded, 4, strategy)
    got = {(k, side): sorted(r["id"] for r in together.where((F.col("round") == k) & (F.col("side") == side)).collect()) for k, side in together.select("round", "side").distinct().collect()}
    want = {(k, side): sorted(r["id"] for r in x.collect()) for k, *both in modelling.rounds(folded, 4, strategy) for side, x in zip(("train", "held"), both, strict=True)}
    assert got == want and len(got) == lines and Counter(together.columns) == Counter(["id", "fold", "round", "side"])
    assert planned(together).count("Range (") == 1


@pytest.mark.parametrize("name", ["tf_custom_cols", "tf_median_std", "tf_relations", "tf_windows", "tf_zero_fill"])
def test_references_times_months_are_not_broadcast(spark, name):
    lines = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    under = [b for a, b in zip(lines, lines[1:], strict=False) if "BroadcastExchange" in a]
    assert any("Generate explode(sequence(" in x for x in lines) and under and not any("Generate explode(sequence(" in x for x in under)


def test_shuffles_of_many_columns_read_no_more_than_of_one(spark):
    df = spark.range(1000).select("id", *[(F.col("id") * k).cast("double").alias(f"c{k}") for k in range(6)])
    reads = [planned(search.shuffled(df, names, 1, [f"s_{n}" for n in names])).count("Range (") for names in (["c1"], [f"c{k}" for k in range(6)])]
    assert reads[0] == reads[1] < 16


def test_columns_of_several_types_are_dealt_anew(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 5 != 0, F.col("id").cast("double")).alias("v"), F.concat(F.lit("n"), "id").alias("s"), F.array("id").alias("a"))
    got = search.shuffled(df, ["v", "s", "a", "v"], 4, ["v", "s2", "a", "v2"]).collect()
    assert list(got[0].asDict()) == ["id", "v", "s", "a", "s2", "v2"] and [r["s"] for r in got] == [f"n{r['id']}" for r in got]
    for name, want in (("id", range(500)), ("v", [float(i) if i % 5 else None for i in range(500)]), ("v2", [float(i) if i % 5 else None for i in range(500)]), ("s2", [f"n{i}" for i in range(500)]), ("a", [[i] for i in range(500)])):
        assert sorted((str(r[name]) for r in got)) == sorted(map(str, want))
    for pair in (lambda r: (r["v"], float(r["id"])), lambda r: (r["v2"], r["v"]), lambda r: (r["s2"], r["s"]), lambda r: (r["a"], [r["id"]])):
        assert sum(a == b for a, b in map(pair, got)) < 60


def test_running_sums_shuffle_their_rows_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(2000).select(F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("odd.g"), (F.col("id") % 700).cast("double").alias("v"), F.lit(1).alias("n"))
        once, summed = running(df, ["odd.g"], "v", ["n"]), running(df, ["odd.g"], "v", ["n"], summed=True)
        dealt_out = [x for x in once._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
        assert len(dealt_out) == 4 and not any("coalesce" in x for x in dealt_out)
        values = Counter((i % 5 or None, float(i % 700)) for i in range(2000))
        want = sorted(((g, v, n, sum(m for (h, w), m in values.items() if h == g and w >= v), 400) for (g, v), n in values.items()), key=str)
        assert sorted(map(tuple, summed.collect()), key=str) == want and summed.columns == ["odd.g", "v", "n", "n_run", "n_all"]
        assert sorted((r["odd.g"], r["v"], r["n_all"]) for r in once.where("v = 3").collect() if r["odd.g"]) == [(3, 3.0, 400)] * 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_cubes_cut_ranges_by_rows_before_they_are_repeated(spark):
    df = spark.range(300).select((F.col("id") % 3).cast("string").alias("a"), (F.col("id") % 2).alias("b"), (F.col("id") % 4 > 0).cast("int").alias("target"), F.col("id").cast("double").alias("score"))
    counts, cuts = cube._counts(df, ["a", "b"], cube._subsets(df, ["a", "b"], ["score"], "target"), ["score"], "target", [])
    assert (counts.count(), cuts.count()) == (1200, 300)
    assert [r["n"] for r in tiled(counts, ["part"], "s", 3, kind=F.col("score"), cuts=cuts).groupBy("part", "tile").agg(F.sum("n").alias("n")).collect()] == [100] * 12


def test_neighbour_information_plans_its_quantiles_a_few_times(spark):
    values = spark.range(100).select(F.lit(0).alias("f"), (F.col("id") % 2).alias("y"), F.col("id").cast("double").alias("value"))
    assert planned(neighbour_information(values, 3, 1)).count("scalar-subquery") <= 12


def test_a_shuffle_of_rows_in_places_ranks_no_values(spark):
    rows = spark.range(1, 40).select((F.col("id") % 4).cast("double").alias("c"), F.col("id").alias("__at"))
    moved = search.exchanged(rows, ["c"], 7)
    assert "scalar-subquery" not in planned(moved) and Counter(r["c"] for r in moved.collect()) == Counter(float(i % 4) for i in range(1, 40))
