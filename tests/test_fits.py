"""Date formats, fits in few scans, and label dictionaries with frequent values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import dates
from plumbline.functions import quantiles as q
from plumbline.functions.values import number
from plumbline.operators import features, quality


@pytest.mark.parametrize(
    ("values", "row_id", "how", "shown"),
    [
        (["15/03/2024", "03/04/2024", "2024-01-02"], "id", "d/M/yyyy", ["2024-03-15", "2024-04-03", None]),
        (["03/04/2024", "15/03/2024"], "id", "M/d/yyyy", ["2024-03-04", None]),
        (["03/04/2024", "15/03/2024"], None, "d/M/yyyy", ["2024-04-03", "2024-03-15"]),
        (["2024-01-02", "15/03/2024"], "id", dates.ISO, ["2024-01-02", None]),
        ([None, "soon", "5.3.2024", "20240102", "6.12.2023"], "id", "d.M.yyyy", [None, None, "2024-03-05", None, "2023-12-06"]),
        (["15 Mar 2024", " 1 Feb 2023 "], None, "d MMM yyyy", ["2024-03-15", "2023-02-01"]),
        (["15/03/2024 10:30", "16/03/2024 11:00"], None, "d/M/yyyy H:mm", ["2024-03-15 10:30:00", "2024-03-16 11:00:00"]),
        (["soon", None], "id", dates.ISO, [None, None]),
    ],
)
def test_a_format_for_each_column(spark, values, row_id, how, shown):
    df = spark.createDataFrame(list(enumerate(values)), "id int, visit_date string").repartition(3)
    params = features.Params(skip=("id",))
    features.fit_dates(df, params, row_id)
    assert params.formats == {"visit_date": how}
    rows = sorted(features.date_features(df, params).collect(), key=lambda r: r["id"])
    assert [r["visit_date"] for r in rows] == shown
    whole = features.fit(df, features.FeatureConfig(skip=("id",), row_id=row_id))
    assert (whole.formats, whole.dates) == (params.formats, params.dates)


def test_date_order_by_formats(spark):
    rows = [("15/03/2024", "01/04/2024", 1), ("20/05/2024", "01/05/2024", 2), (None, "02/05/2024", 3)]
    df = spark.createDataFrame(rows, "treatment_date string, diagnosis_date string, id int")
    found = quality.date_order_violations(df, row_id="id").collect()
    assert found == []  # 01/04/2024 comes first, so diagnoses are month first and 15/03/2024's column is day first; all fit
    swapped = spark.createDataFrame([("15/03/2024", "20/04/2024", 1), ("20/05/2024", "01/05/2024", 2)], "treatment_date string, diagnosis_date string, id int")
    assert [(r["column"], r["count"]) for r in quality.date_order_violations(swapped, row_id="id").collect()] == [("treatment_date", 1)]


def mixed(spark, n=900):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        num = None if rng.random() < 0.2 else float(rng.lognormal(0, 1))
        rows.append((i, num, None if i % 11 == 0 else int(rng.integers(0, 5)), None, "abc"[i % 3] if i % 7 else None, f"name {i % 40}" if i % 13 else None, f"2024-0{1 + i % 9}-1{i % 10}" if i % 5 else None, i % 2 == 0))
    return spark.createDataFrame(rows, "id int, amount double, stars int, nothing double, grade string, who string, visit_date string, flag boolean").repartition(4)


def step_by_step(df, config):
    """The fits one by one, each on what the steps before it give."""
    params = features.Params(skip=config.skip)
    features.fit_dates(df, params, config.row_id)
    df = features.date_features(df, params)
    features.fit_imputer(df, params)
    df = features.impute(df, params)
    features.fit_bounds(df, params, config.outlier_factor)
    df = features.clip_outliers(df, params)
    features.fit_encoder(df, params, config.max_one_hot)
    features.fit_scaler(features.encode(df, params), params, config.scaler)
    return params


@pytest.mark.parametrize("scaler", ["standard", "minmax"])
@pytest.mark.parametrize("inline", [1000, 10])
def test_one_fit_gives_what_the_steps_give(spark, monkeypatch, scaler, inline):
    monkeypatch.setattr(features, "INLINE_LABELS", inline)
    monkeypatch.setattr(features, "HEAVY_SHARE", 30)
    df, config = mixed(spark), features.FeatureConfig(skip=("id",), scaler=scaler)
    one, two = features.fit(df, config), step_by_step(df, config)
    for part in ("dates", "formats", "medians", "modes", "one_hot", "labels", "heavy_labels"):
        assert getattr(one, part) == getattr(two, part), part
    assert set(one.label_tables) == set(two.label_tables)
    for part in ("bounds", "scales"):
        a, b = getattr(one, part), getattr(two, part)
        assert a.keys() == b.keys() and all(np.allclose(a[c], b[c]) for c in a), part
    got, want = (sorted(map(tuple, features.transform(df, p).collect())) for p in (one, two))
    assert features.transform(df, one).columns == features.transform(df, two).columns
    assert all(np.allclose([np.nan if x is None else x for x in g], [np.nan if x is None else x for x in w], equal_nan=True) for g, w in zip(got, want, strict=True))


def test_a_fit_reads_its_input_four_times(spark):
    df, read = mixed(spark), spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    seen = df.mapInPandas(watched, df.schema)
    features.fit(seen, features.FeatureConfig(skip=("id",)))
    assert read.value <= 4 * 900
    before = read.value
    q.quantiles(seen, {c: number(seen, c) for c in ("amount", "stars", "nothing")}, [0.1, 0.5])
    assert read.value - before <= 2 * 900


@pytest.mark.parametrize("missing", [0.0, 0.1, 0.6, 0.999])
def test_quartiles_of_imputed_columns(spark, missing):
    rng = np.random.default_rng(int(missing * 10))
    columns = {"a": rng.random(701), "b": rng.integers(0, 3, 701).astype(float), "c": np.full(701, 2.0), "d": rng.lognormal(0, 3, 701)}
    gone = {c: rng.random(701) < missing for c in columns}
    df = spark.createDataFrame(pd.DataFrame({c: np.where(gone[c], np.nan, v) for c, v in columns.items()})).repartition(3)
    values = {c: number(df, c) for c in columns}
    tables = {c: t for c, t in q.rank_tables(df, values).items() if t.count}
    found = q.at_ranks(df, values, tables, {r for c, t in tables.items() for r in q.ranks_of_imputed_quartiles(c, t)})
    for c in tables:
        present = columns[c][~gone[c]]
        filled = np.where(gone[c], np.median(present), columns[c])
        assert np.allclose(q.imputed_quartiles(found, c, tables[c]), [np.median(present), *np.quantile(filled, [0.25, 0.75])])


def test_empty_and_odd_tables(spark):
    for schema in ("id int", "id int, a double", "id int, s string", "id int, s string, a double, visit_date string, b date"):
        empty = spark.createDataFrame([], schema)
        out, params = features.fit_transform(empty, features.FeatureConfig(skip=("id",)))
        assert out.count() == 0
    nulls = spark.createDataFrame([(1, None, None, None)] * 3, "id int, a double, s string, b date")
    out, params = features.fit_transform(nulls, features.FeatureConfig(skip=("id",)))
    assert out.count() == 3 and params.modes["s"] == "UNKNOWN" and params.medians["a"] is None


def test_frequent_labels_are_spread(spark):
    """One value in nine rows of ten beside many others: no task of the join has more than twice the median."""
    df = spark.range(0, 200_000, 1, 8).select("id", F.when(F.col("id") % 10 < 9, "common").when(F.col("id") % 100 == 9, F.lit(None)).otherwise(F.concat(F.lit("v"), F.col("id").cast("string"))).alias("who"))
    params = features.Params(skip=("id",))
    features.fit_encoder(df, params)
    assert set(params.heavy_labels["who"]) == {"common"}
    coded = features.encode(df, params)
    names = {r["value"]: r["code"] for r in params.label_tables["who"].collect()}
    assert coded.where("who = -1").count() == 2000 and coded.where(F.col("who") == names["common"]).count() == 180_000
    wrong = coded.join(df.select("id", F.col("who").alias("was")), "id").where("was like 'v%'").collect()
    assert all(r["who"] == names[r["was"]] for r in wrong)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        sizes = [r["count"] for r in features.encode(df, params).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(sizes) < 2 * np.median(sizes) and len(sizes) == 4
