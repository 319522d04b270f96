"""Exact percentiles against numpy."""

import numpy as np
import pytest

from tickerloom.operators import quantiles

FRACTIONS = {"low": 0.001, "p05": 0.05, "median": 0.5, "p95": 0.95, "top": 1.0, "bottom": 0.0}


@pytest.mark.parametrize("small", [40, 100_000])
def test_percentiles_equal_numpy(spark, small):
    rng = np.random.default_rng(8)
    groups = {
        "a": rng.normal(size=30_000), "b": np.round(rng.normal(size=9_000), 1), "c": np.full(5_000, 7.5), "d": np.array([3.0]),
        "e": np.r_[10.0 ** rng.uniform(-300, 300, 4_000), -1e308, 0.0], "f": np.r_[np.zeros(6_000), np.arange(3)], "g": np.array([1.0, 2.0]),
    }
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("a", None), ("h", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r.k: r.asDict() for r in quantiles.exact_percentiles(df, "k", "v", FRACTIONS, small=small).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert got[k]["rows"] == len(values)
        for name, f in FRACTIONS.items():
            want = np.percentile(values, 100 * f)
            assert got[k][name] == pytest.approx(want, rel=1e-12, abs=1e-300), (k, name)
