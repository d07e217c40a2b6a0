"""Quantiles, positions and densities that no task gathers a column for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import quantiles as q
from plumbline.functions.shared import dense_positions, shared_folder
from plumbline.operators import features, identifiers, profile


@pytest.mark.parametrize("most", [200_000, 50])
def test_quantiles_by_numpy(spark, most, monkeypatch):
    monkeypatch.setattr(q, "MOST_ROWS", most)  # the smaller one narrows every bracket
    rng = np.random.default_rng(3)
    columns = {"even": rng.random(5000), "tied": rng.integers(0, 4, 5000).astype(float), "same": np.full(5000, 2.5), "heavy": rng.lognormal(0, 4, 5000), "hot": np.where(rng.random(5000) < 0.4, 7.0, rng.random(5000) * 14)}
    rows = [tuple(float(v[i]) if (i + k) % 9 else None for k, v in enumerate(columns.values())) + (None, float("nan")) for i in range(5000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*columns, "none", "nans"])).repartition(5)
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    from plumbline.functions.values import number

    got = q.quantiles(df, {c: number(df, c) for c in df.columns}, shares)
    for k, (c, v) in enumerate(columns.items()):
        present = [v[i] for i in range(5000) if (i + k) % 9]
        assert np.allclose(got[c], np.quantile(present, shares))
    assert got["none"] is None and got["nans"] is None
    near = q.quantiles(df, {"even": F.col("even")}, [0.5], exact=False)["even"][0]
    assert abs(near - got["even"][3]) < 0.01
    one = spark.createDataFrame([(4.0,)], "x double")
    assert q.quantiles(one, {"x": F.col("x")}, [0.25, 0.5]) == {"x": [4.0, 4.0]} and q.quantiles(one.limit(0), {"x": F.col("x")}, [0.5]) == {"x": None}


def test_positions_by_ranges(spark):
    words = spark.range(3000).select(F.concat(F.lit("Customer#"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("value")).repartition(7)
    got = dense_positions(words, "value", "code", range_rows=100).collect()
    assert [r["code"] for r in sorted(got, key=lambda r: r["value"])] == list(range(3000))
    parts = dense_positions(words, "value", "code", range_rows=100).groupBy(F.floor(F.col("code") / 100)).count().collect()
    assert len(parts) == 30
    assert dense_positions(words.limit(0), "value", "code").count() == 0
    table = features.label_table(words, "value").collect()
    assert sorted((r["code"], r["value"]) for r in table) == [(i, f"Customer#{i:06d}") for i in range(3000)]
    numbered = identifiers.replace_identifiers(spark.range(50).select("id", (F.col("id") % 7).alias("code")), ["code"], "id")
    assert {r["id"]: r["code"] for r in numbered.collect()} == {i: f"ANON_{i:06d}" for i in range(50)}


def test_densities_with_and_without_bins(spark):
    df = spark.range(30_000).select((F.rand(1) * 10).alias("x"))
    exact, binned = ({r["point"]: r["density"] for r in profile.kde_curve(df, "x", 20, bins).collect()} for bins in (None, 500))
    n, values = 30_000, np.array([r["x"] for r in df.collect()])
    width = values.std(ddof=1) * n**-0.2
    at = np.linspace(values.min(), values.max(), 20)
    plain = np.exp(-(((at[:, None] - values[None, :]) / width) ** 2) / 2).sum(1) / (n * width * np.sqrt(2 * np.pi))
    assert np.allclose([exact[i] for i in range(20)], plain)
    peak = 1 / (width * np.sqrt(2 * np.pi))
    assert max(abs(exact[i] - binned[i]) for i in range(20)) <= 0.31 * (10 / 500) / width * peak


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})()  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session())
