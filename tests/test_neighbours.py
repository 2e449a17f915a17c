import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskloom.functions.neighbours import BLOCK, digamma, neighbour_information
from riskloom.operators import selection


def psi(n):
    return sum(1 / i for i in range(1, n)) - 0.5772156649015329


def brute(rows, k):
    sizes = Counter(y for y, _ in rows)
    rows = [(y, x) for y, x in rows if sizes[y] > 1]
    total = 0.0
    for i, (y, x) in enumerate(rows):
        asked = min(k, sizes[y] - 1)
        d = sorted(abs(v - x) for j, (c, v) in enumerate(rows) if c == y and j != i)[asked - 1]
        m = sum(x - d < v < x + d or (d == 0 and v == x) for _, v in rows)
        total += psi(asked) - psi(sizes[y]) - psi(m)
    return max(0.0, psi(len(rows)) + total / len(rows))


def test_digamma(spark):
    found = spark.range(1, 200).select("id", digamma(F.col("id")).alias("p")).collect()
    assert all(abs(r["p"] - psi(r["id"])) < 1e-10 for r in found)


@pytest.mark.parametrize(("k", "block"), [(1, 4), (3, 5), (3, BLOCK), (7, 9)])
def test_same_as_brute_force(spark, k, block):
    rng = random.Random(k + block)
    features = [
        [(y := rng.randrange(3), rng.gauss(y, 1.0))[0:2] for _ in range(250)],
        [(rng.randrange(2), float(rng.randrange(6))) for _ in range(250)],  # many ties
        [(0, 1.5)] * 60 + [(1, 1.5)] * 3 + [(1, -0.0), (1, 0.0), (2, 7.0), (3, 8.0), (3, 9.0)],  # a single row, small classes, one common value
        [(k % 2, 2.0**k) for k in range(-40, 40)],
    ]
    rows = [(f, y, x) for f, some in enumerate(features) for y, x in some]
    df = spark.createDataFrame(rows, "f int, y int, value double").repartition(7)
    found = {r["f"]: r["mutual_information"] for r in neighbour_information(df, k, len(features), block).collect()}
    for f, some in enumerate(features):
        assert math.isclose(found[f], brute(some, k), abs_tol=1e-9), f


def test_selector(spark):
    rng = random.Random(2)
    rows = [(y := rng.choice("abc"), "abc".index(y) * 3 + rng.random(), rng.random(), ord(y)) for _ in range(600)]
    df = spark.createDataFrame(rows, "y string, `strong.one` double, weak double, code int")
    found = selection.mutual_information(df, "y", ["weak", "strong.one", "code"], estimator="neighbours", discrete_features=[False, False, True], threshold=0.5)
    by = {r["feature"]: r["mutual_information"] for r in found.feature_table}
    assert found.selected_features == ["strong.one", "code"] and by["weak"] < 0.15
    assert abs(by["strong.one"] - by["code"]) < 0.1 and abs(by["code"] - math.log(3)) < 0.05
    assert found.metadata["estimator"] == "neighbours" and found.metadata["n_neighbors"] == 3
    with pytest.raises(ValueError):
        selection.mutual_information(df, "y", ["weak"], estimator="near")
