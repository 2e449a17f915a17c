import math

import numpy as np
import pandas as pd
import pytest

from riskloom.operators.selection import correlation_filter
from riskloom.operators.wide import correlation_table, gram, wide_correlation_filter


def greedy(matrix, threshold):
    kept, clash = [], {}
    for j in range(len(matrix)):
        hit = next((i for i in kept if abs(matrix[i, j]) >= threshold), None)
        if hit is None:
            kept.append(j)
        else:
            clash[j] = hit
    return clash


def test_two_thousand_columns(spark):
    width, rows = 2000, 300
    values = np.random.default_rng(5).integers(0, 1000, (rows, width)).astype(float)
    values[:, 1400:] = -values[:, :600] + np.arange(rows)[:, None] % 7
    names = [f"f{k}" for k in range(width)]
    saved = spark.createDataFrame(pd.DataFrame(values, columns=names)).repartition(6)
    found = wide_correlation_filter(saved, names, threshold=0.95, held=width * 700)  # three strips
    matrix = np.corrcoef(values.T)
    clash = greedy(matrix, 0.95)
    assert len(clash) >= 600
    assert [r["correlated_with"] for r in found.feature_table] == [f"f{clash[k]}" if k in clash else None for k in range(width)]
    for r in found.grouped_table.where("pmod(i * 7919 + j, 40009) = 3").collect():
        assert math.isclose(r["correlation"], matrix[r["i"], r["j"]], abs_tol=1e-9)


@pytest.mark.parametrize("held", [1, 20, 1 << 20])
def test_same_as_the_narrow_filter(spark, held):
    rows = [(float(k), k * 2.0 + 1e9, float(k * k % 11), -float(k), 5.0, 1e-150 * (k % 4)) for k in range(40)]
    names = ["a", "odd.name", "c", "d", "flat", "tiny"]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(5)
    wide = wide_correlation_filter(df, names, threshold=1.0, held=held)
    assert wide.selected_features == ["a", "c", "flat", "tiny"]
    narrow = correlation_filter(df, names[:4], threshold=0.9)
    assert wide_correlation_filter(df, names[:4], threshold=0.9, held=held).feature_table == narrow.feature_table
    pairs = {(r["left"], r["right"]): r["correlation"] for r in correlation_table(gram(df, names, held=held), names).collect()}
    assert len(pairs) == 15 and pairs["a", "d"] == -1.0 and math.isnan(pairs["a", "flat"])
    assert all(math.isclose(pairs[r["left"], r["right"]], r["correlation"], abs_tol=1e-9) for r in narrow.correlation_pairs)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (float("inf"), 1.0)], "a double, b double")
    with pytest.raises(ValueError, match="finite.*: a$"):
        wide_correlation_filter(df, ["a", "b"])
    assert wide_correlation_filter(df.limit(0), ["a", "b"]).selected_features == ["a", "b"]
    assert wide_correlation_filter(df.where("b = 2"), ["a", "b"]).selected_features == ["a", "b"]  # one row: all constant
    with pytest.raises(ValueError):
        wide_correlation_filter(df, ["a"], threshold=2)
