import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import sketches
from riskloom.operators.sketches import SketchStore


def scores(spark, months, rows=6000):
    month = F.element_at(F.array(*[F.lit(m) for m in months]), (F.col("id") % len(months) + 1).cast("int"))
    value = F.pmod(F.xxhash64("id", F.lit(months[0])), F.lit(100_000)) / 100.0
    return spark.range(rows * len(months)).select(F.to_date(month, "yyyyMM").alias("day"), value.alias("score"), (F.col("id") % 37).cast("string").alias("kind"))


def test_new_months_join_old_ones_without_their_rows(spark, tmp_path):
    store = SketchStore(spark, str(tmp_path / "store"), k=400)
    old, new = scores(spark, ["202401", "202402"]), scores(spark, ["202403"])
    store.add(old, "day", ["score", "kind"])
    before = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(store.path) for f in fs if "cohort=" in d}
    store.add(new, "day", ["score", "kind"])
    after = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(store.path) for f in fs if "cohort=" in d}
    assert before.items() <= after.items()  # what was there is neither read for this nor written anew
    values = np.sort([r[0] for r in old.union(new).select("score").collect()])
    cuts = store.cutoffs("score")
    bound = sketches.rank_error(400)
    for share, cut in zip(np.arange(1, 10) / 10, cuts, strict=True):
        low, high = (np.searchsorted(values, cut, side) / len(values) for side in ("left", "right"))
        assert low - bound <= share <= high + bound
    row = store.span().where("column = 'score'").select("rows", "present", sketches.quantile(0).alias("low"), sketches.quantile(1).alias("high"), sketches.distinct().alias("d")).first()
    assert (row["rows"], row["present"], row["low"], row["high"]) == (18000, 18000, values[0], values[-1])
    true = len(set(values.tolist()))
    assert abs(row["d"] - true) <= 4 * sketches.distinct_error() * true
    assert store.span("202402", "202403").where("column = 'kind'").select("rows", sketches.distinct()).first() == (12000, 37)
    store.add(scores(spark, ["202403"], 100), "day", ["score", "kind"])  # a month that comes again is replaced
    assert {r["cohort"]: r["rows"] for r in store.months().where("column = 'kind'").collect()} == {"202401": 6000, "202402": 6000, "202403": 100}
    plan = store.months("202403")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cohort" in plan


def test_bands_of_each_month(spark):
    rows = scores(spark, ["202401", "202402"])
    cuts = [100.0, 250.0, 250.0, 900.0]
    found = sketches.band_shares(sketches.monthly_sketches(rows, "day", "score", k=500), cuts)
    bound = sketches.rank_error(500, shares=True)
    shares = {}
    for r in found.collect():
        shares.setdefault(r["cohort"], {})[r["band"]] = r["share"]
    for cohort, by_band in shares.items():
        values = np.array([r[0] for r in rows.where(F.date_format("day", "yyyyMM") == cohort).select("score").collect()])
        want = np.bincount(np.searchsorted(cuts, values, side="left"), minlength=5) / len(values)
        assert all(abs(by_band[i + 1] - want[i]) <= bound for i in range(5)) and abs(sum(by_band.values()) - 1) < 1e-9
    with pytest.raises(ValueError):
        sketches.band_shares(found, [2.0, 1.0])


def test_missing_values_and_empty_tables(spark):
    rows = spark.createDataFrame([("2024-01-05", None, "x"), ("2024-01-06", float("nan"), None), ("2024-02-01", 3.0, None), (None, 9.0, "y"), ("2024-02-02", -0.0, "z"), ("2024-02-03", 0.0, "z")], "day string, `a.b` double, t string")
    rows = rows.withColumn("day", F.to_date("day"))
    found = sketches.monthly_sketches(rows, "day", ["a.b", "t"])
    table = {(r["cohort"], r["column"]): tuple(r)[2:] for r in found.select("cohort", "column", "rows", "present", sketches.quantile(0.5).alias("m"), sketches.distinct().alias("d")).collect()}
    assert table == {("202401", "a.b"): (2, 0, None, 0), ("202401", "t"): (2, 1, None, 1), ("202402", "a.b"): (3, 3, 0.0, 2), ("202402", "t"): (3, 2, None, 1)}
    whole = {r["column"]: tuple(r)[1:] for r in sketches.merged(found).select("column", "present", sketches.quantile(1).alias("m"), sketches.distinct().alias("d")).collect()}
    assert whole == {"a.b": (3, 3.0, 2), "t": (3, None, 2)}
    assert sketches.merged(sketches.monthly_sketches(rows.limit(0), "day", "t")).collect() == []
    assert all(r["share"] is None for r in sketches.band_shares(found.where("present = 0"), [1.0]).collect())
