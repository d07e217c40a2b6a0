"""Profiles of odd tables, and of wide and long ones by plain formulas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import gauss
from plumbline.functions.values import number
from plumbline.operators import features, pairwise, profile, quality

TABLES = {
    "empty": ("a int, s string, b boolean, d double", []),
    "no rows of numbers": ("a int", []),
    "strings only": ("s string, t string", [("x", None), ("y", None)]),
    "numbers only": ("a int, d double", [(1, 2.0), (2, float("nan")), (None, None)]),
    "all missing": ("a int, d double, s string", [(None, float("nan"), None)] * 3),
    "one row": ("a int, s string", [(1, "x")]),
    "neither": ("b boolean", [(True,), (None,)]),
    "odd names": ("`x.y` int, `a b` double, `q``q` string", [(1, 2.0, "s"), (3, 5.0, "t")]),
}
PROFILES = {
    "describe_numbers": lambda df: profile.describe_numbers(df),
    "describe_strings": lambda df: profile.describe_strings(df),
    "missing_ranking": lambda df: profile.missing_ranking(df),
    "missing_table": lambda df: profile.missing_table(df),
    "missing_map": lambda df: profile.missing_map(df),
    "histogram": lambda df: profile.histogram(df),
    "location_stats": lambda df: profile.location_stats(df),
    "value_counts": lambda df: profile.value_counts(df),
    "cardinality_mode": lambda df: profile.cardinality_mode(df),
    "correlation_matrix": lambda df: profile.correlation_matrix(df),
    "strong_pairs": lambda df: profile.strong_pairs(df),
    "outlier_report": lambda df: profile.outlier_report(df),
    "boxplot_stats": lambda df: profile.boxplot_stats(df),
    "recommendations": lambda df: profile.recommendations(df),
    "outlier_counts": lambda df: features.outlier_counts(df, features.Params()),
    "cardinality_split": lambda df: features.cardinality_split(df),
    "fit_transform": lambda df: features.fit_transform(df)[0],
    "verify": lambda df: quality.verify(df),
}
NORMAL = ("a int, d double, s string, t string", [(i, i * 1.5, "xy"[i % 2], "z") for i in range(30)])


@pytest.mark.parametrize("table", TABLES)
def test_odd_tables(spark, table):
    """No profile fails, and one of no columns has the columns that it has of others."""
    schema, rows = TABLES[table]
    df = spark.createDataFrame(rows, schema)
    usual = spark.createDataFrame(NORMAL[1], NORMAL[0])
    for name, make in PROFILES.items():
        out = make(df)
        out.collect()
        if name != "fit_transform":
            assert out.columns == make(usual).columns, name


def test_values_of_odd_tables(spark):
    df = spark.createDataFrame([(None, float("nan"), None)] * 3, "a int, d double, s string")
    rows = {r["column"]: r for r in profile.describe_numbers(df).collect()}
    assert rows["a"]["count"] == 0 and rows["a"]["q50"] is None and rows["d"]["missing_pct"] == 100.0
    assert profile.histogram(df).count() == profile.boxplot_stats(df).count() == profile.outlier_report(df).count() == 0
    assert profile.describe_strings(df).count() == profile.value_counts(df).count() == 0
    assert profile.missing_ranking(df).where("level = 'CRITICAL'").count() == 3


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 300))
    base[:, 1] = base[:, 0] * 2 + 1e-3 * base[:, 1]
    base[:, 2] += 1e7
    base[:, 3] = 5.0
    base[:, 4] = 1e9 + base[:, 0] * 1e-2
    base[rng.random(base.shape) < 0.1] = np.nan
    base[:, 5] = np.nan
    df = spark.createDataFrame(pd.DataFrame(base.copy(), columns=[f"c{i}" for i in range(300)])).repartition(4)
    read = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    seen = df.mapInPandas(watched, df.schema)
    got = {(r["col_a"], r["col_b"]): r["r"] for r in profile.correlation_matrix(seen).collect()}
    assert read.value < 2 * 400  # one scan, and a first row
    shifted = base - np.nanmedian(np.where(np.isnan(base).all(0), 0.0, base), axis=0)  # the same correlations, no digits lost

    def want(i, j):
        x, y = shifted[~np.isnan(shifted[:, i]) & ~np.isnan(shifted[:, j])][:, [i, j]].T
        x, y = x - x.mean(), y - y.mean()
        return (x @ y) / np.sqrt((x @ x) * (y @ y))

    assert len(got) == 300 * 300 - 1  # the column without values has no row with itself
    for i in range(300):
        for j in range(300):
            r = got.get((f"c{i}", f"c{j}"))
            if i == j:
                assert (r == 1.0) == (i != 5)
            elif 3 in (i, j) or 5 in (i, j):
                assert r is None
            else:
                assert abs(r - want(i, j)) < 1e-9, (i, j)
    pair = df.agg(F.corr(number(df, "c0"), number(df, "c1"))).first()[0]
    assert abs(got["c0", "c1"] - pair) < 1e-9
    rows = pairwise.correlations(df, {f"c{i}": F.col(f"c{i}") for i in range(10)})
    assert rows.count() == 55


def test_densities_of_distinct_values(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(0, 1, 3000), rng.lognormal(2, 1, 3000), [400.0]])
    df = spark.createDataFrame(pd.DataFrame({"x": values})).repartition(3)
    got = {r["point"]: (r["x"], r["density"]) for r in profile.kde_curve(df, "x").collect()}
    width = values.std(ddof=1) * len(values) ** -0.2
    at = np.linspace(values.min(), values.max(), 200)
    plain = np.exp(-(((at[:, None] - values[None, :]) / width) ** 2) / 2).sum(1) / (len(values) * width * np.sqrt(2 * np.pi))
    assert sorted(got) == list(range(200)) and np.allclose([got[i][0] for i in range(200)], at)
    assert np.abs(np.array([got[i][1] for i in range(200)]) - plain).max() < 1e-10 * plain.max()
    cells = gauss.cell_moments(df, "x", values.min(), width).count()
    assert cells * 200 < len(values) * 200 / 20


def test_hermite_polynomials():
    assert gauss.hermite(0) == [1.0] and gauss.hermite(1) == [0.0, 1.0] and gauss.hermite(4) == [3.0, 0.0, -6.0, 0.0, 1.0]
