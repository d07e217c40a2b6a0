import math

import pytest
from pyspark.sql import functions as F

from plumbline.operators import features, profile

ROWS = [(25, 120, 90.0, "a", "F"), (30, 125, None, "b", "M"), (45, 130, 95.0, "c", "F"), (50, 128, 100.0, "a", "M"), (35, 122, 88.0, "b", "F"), (60, 135, None, "a", "M"), (41, 118, 99.0, "a", "F"), (38, 127, 93.0, "c", "M"), (29, 121, 96.0, "b", "F"), (52, 999, 97.0, None, "M")]


def rows_of(df):
    return sorted(tuple(round(v, 9) for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "age int, blood_pressure int, glucose double, diagnosis string, gender string")


def test_fit_transform_scales_every_column(table):
    out, params = features.fit_transform(table)
    assert out.columns == ["age", "blood_pressure", "glucose", "diagnosis_b", "diagnosis_c", "gender_M"]
    stats = out.agg(*[f(c).alias(f"{n}_{c}") for c in out.columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first().asDict()
    assert all(math.isclose(v, 0 if k[0] == "m" else 1, abs_tol=1e-9) for k, v in stats.items())
    assert params.medians["glucose"] == 95.5 and params.modes["diagnosis"] == "a"
    assert features.feature_names(params) == ["diagnosis_b", "diagnosis_c", "gender_M"]


def test_saved_parameters_do_the_same(table, spark, tmp_path):
    out, params = features.fit_transform(table, features.FeatureConfig(max_one_hot=2))
    features.save_params(spark, params, str(tmp_path / "p"))
    assert rows_of(features.transform(table, features.load_params(spark, str(tmp_path / "p")))) == rows_of(out)


def test_large_dictionaries_are_joined(table, spark, tmp_path, monkeypatch):
    expected, _ = features.fit_transform(table, features.FeatureConfig(max_one_hot=1))
    monkeypatch.setattr(features, "INLINE_LABELS", 2)
    out, params = features.fit_transform(table, features.FeatureConfig(max_one_hot=1))
    assert list(params.label_tables) == ["diagnosis"] and rows_of(out) == rows_of(expected)
    features.save_params(spark, params, str(tmp_path / "p"))
    assert rows_of(features.transform(table, features.load_params(spark, str(tmp_path / "p")))) == rows_of(out)


def test_modes_and_unseen_values(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None), (None, None)], "tied string, empty string")
    assert features.modes(df, ["tied", "empty"]) == {"tied": "a", "empty": "UNKNOWN"}
    params = features.Params()
    features.fit_encoder(df, params, max_one_hot=5)
    new = spark.createDataFrame([("z", None), ("b", "x")], df.schema)
    assert [r["tied_b"] for r in features.encode(new, params).collect()] == [0.0, 1.0]
    features.fit_encoder(df, params, max_one_hot=1)
    assert [r["tied"] for r in features.encode(new, params).collect()] == [-1, 1]


def test_dates(spark):
    df = spark.createDataFrame([("2024-01-01", 5), ("2024-02-30", 6), (None, 7)], "admission string, created_count int")
    params = features.Params()
    features.fit_dates(df, params)
    rows = features.date_features(df, params).collect()
    assert (rows[0]["admission"], rows[0]["admission_dayofweek"], rows[1]["admission"], rows[2]["admission_year"]) == ("2024-01-01", 0, None, None)
    assert "created_count_year" not in rows[0].asDict()
    timed = spark.createDataFrame([("2024-01-01 10:30:00",), ("2024-01-02",)], "date string")
    features.fit_dates(timed, params)
    assert [r["date"] for r in features.date_features(timed, params).collect()] == ["2024-01-01 10:30:00", "2024-01-02 00:00:00"]


def test_outliers_keep_missing_values(table, spark):
    params = features.Params()
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(500.0,), (None,), (float("nan"),)], "v double")
    features.fit_bounds(df, params)
    clipped = [r["v"] for r in features.clip_outliers(df, params).collect()]
    assert max(v for v in clipped if v is not None) == params.bounds["v"][1] and clipped[-2:] == [None, None]
    assert None not in [r["v"] for r in features.replace_outliers_median(df, params).collect()]
    assert features.outlier_counts(df, params).first()["outliers"] == 1


def test_constants_and_empty_columns_scale_to_something(spark):
    df = spark.createDataFrame([(3.0, None), (3.0, None)], "same double, none double")
    out, _ = features.fit_transform(df)
    assert [tuple(r) for r in out.collect()] == [(0.0, None), (0.0, None)]


def test_profiles(table, spark):
    numbers = {r["column"]: r for r in profile.describe_numbers(table).collect()}
    assert numbers["glucose"]["count"] == 8 and numbers["glucose"]["missing_pct"] == 20.0
    assert {r["column"]: (r["top"], r["freq"]) for r in profile.describe_strings(table).collect()} == {"diagnosis": ("a", 4), "gender": ("F", 5)}
    bins = profile.histogram(table.select("age"), bins=5).collect()
    assert sum(r["count"] for r in bins) == 10 and math.isclose(sum(r["density"] * r["width"] for r in bins), 1)
    curve = profile.kde_curve(table, "age").collect()
    assert len(curve) == 200 and 0.8 < sum(r["density"] for r in curve) * 35 / 199 < 1
    matrix = {(r["col_a"], r["col_b"]): r["r"] for r in profile.correlation_matrix(table).collect()}
    assert len(matrix) == 9 and matrix["age", "age"] == 1.0 and math.isclose(matrix["age", "glucose"], matrix["glucose", "age"])
    assert profile.recommendations(table).where("subject = 'glucose'").first()["advice"] == "impute"
    boxes = {r["column"]: r for r in profile.boxplot_stats(table).collect()}
    assert boxes["blood_pressure"]["whisker_high"] == 135


def test_a_coarse_density_is_near_the_exact_one(spark):
    df = spark.range(3000).select((F.sin("id") * 10 + F.col("id") % 7).alias("v"))
    exact, coarse = ({r["point"]: r["density"] for r in profile.kde_curve(df, "v", bins=b).collect()} for b in (None, 1000))
    assert max(abs(exact[i] - coarse[i]) for i in exact) < 1e-4
