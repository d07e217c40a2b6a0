import json

import pytest

from plumbline.operators import quality

AGES = [45, 32, 67, 28, 55, 41, 63, 38, 50, 71]


def _by_name(results):
    return {r["name"]: r for r in results.collect()}


@pytest.fixture(scope="module")
def clean(spark):
    rows = [(a, 110 + 3 * i, 80 + 3 * i, 66 + i, "F" if i % 2 else "M", f"d{i}") for i, a in enumerate(AGES)]
    return spark.createDataFrame(rows, "age int, blood_pressure int, glucose int, heart_rate int, gender string, diagnosis string")


def test_a_clean_table_passes(clean):
    results = quality.verify(clean)
    assert {r["status"] for r in results.collect()} == {"pass"} and [r["name"] for r in results.collect()] == ["missing_values", "duplicates", "domain", "consistency", "distribution"]
    assert quality.gate(results).first().asDict() == {"passed": 5, "failed": 0, "warned": 0, "gate_passed": True, "overall": "pass"}


@pytest.mark.parametrize(("missing", "threshold", "status"), [(8, 0.15, "fail"), (1, 0.15, "pass"), (2, 0.15, "warn"), (10, 0.15, "fail"), (2, 0.30, "pass"), (4, 0.10, "fail"), (0, 0.15, "pass")])
def test_missing_thresholds(spark, missing, threshold, status):
    df = spark.createDataFrame([(None if i < missing else float(i), i) for i in range(10)], "a double, b int")
    assert quality.check_missing(df, threshold).first()["status"] == status


def test_nan_is_missing_and_no_columns_pass(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "a double")
    assert quality.missing_rates(df).first()["rate"] == 0.5
    assert quality.check_missing(df.select()).first()["status"] == "pass"


def test_duplicates(clean):
    twice = quality.check_duplicates(clean.union(clean)).first()
    assert (twice["status"], twice["value"], json.loads(twice["details"])["pct"]) == ("fail", 10.0, 50.0)
    two = quality.check_duplicates(clean.union(clean.limit(2))).first()
    assert (two["value"], json.loads(two["details"])["pct"], two["status"]) == (2.0, 16.67, "fail")


def test_missing_equals_missing_in_duplicates(spark):
    df = spark.createDataFrame([(None, float("nan")), (None, float("nan")), ("x", 1.0)], "a string, b double")
    assert quality.duplicate_stats(df).first()["duplicates"] == 1


def test_domain_rules(spark):
    df = spark.createDataFrame([(0, 30, 5.0), (1, 999, 10.0), (2, -5, 150.0), (3, None, float("nan"))], "row_id int, age int, custom_score double")
    found = {r["column"]: r for r in quality.domain_violations(df, {"custom_score": (0, 100)}, "row_id").collect()}
    assert found["age"]["count"] == 2 and found["age"]["examples"] == [999.0, -5.0] and found["custom_score"]["examples"] == [150.0]
    assert quality.check_domain(df, None, "row_id").first()["status"] == "warn"


def test_a_column_under_two_rules_keeps_the_later(spark):
    df = spark.createDataFrame([(0, 700)], "row_id int, age_glucose int")
    assert [r["rule"] for r in quality.domain_violations(df, None, "row_id").collect()] == ["glucose"]


def test_consistency(spark):
    rows = [(30, 120, 90, "2024-03-01", "2024-02-01"), (-1, 120, 90, "2024-01-10", "2024-02-01"), (40, -5, 90, "2024-03-01", None), (41, 110, 95, "2024-03-05", "2024-03-05")]
    df = spark.createDataFrame(rows, "age int, blood_pressure int, glucose int, treatment_date string, diagnosis_date string")
    assert sorted((r["issue"], r["subject"], r["value"]) for r in quality.consistency_issues(df).collect()) == [("date_order", "treatment_date", 1.0), ("negative", "age|age", 1.0), ("negative", "blood_pressure|blood_pressure", 1.0)]
    assert quality.check_consistency(df).first()["status"] == "warn"


def test_an_unparsable_date_skips_the_pair(spark):
    df = spark.createDataFrame([("2024-01-01", "2024-02-01"), ("soon", "2024-02-01")], "treatment_date string, diagnosis_date string")
    assert quality.date_order_violations(df).count() == 0


def test_age_groups(spark):
    df = spark.createDataFrame([(10, "a"), (50, "a"), (20, "b"), (30, "b"), (99, None)], "age int, age_group string")
    assert [tuple(r) for r in quality.age_group_spread(df).collect()] == [("a", 40.0)]
    assert quality.age_group_spread(df.withColumn("age", df["age"].cast("string"))).count() == 0


def test_negative_column_with_two_words_is_told_twice(spark):
    df = spark.createDataFrame([(-1.0,)], "average_glucose double")
    assert sorted(r["word"] for r in quality.negative_values(df).collect()) == ["age", "glucose"]


def test_distribution(spark):
    df = spark.createDataFrame([(1,)] * 9 + [(10000,)], "value int")
    found = {r["warning"]: r["value"] for r in quality.distribution_warnings(df).collect()}
    assert found == {"skewness": 3.162, "cv": 3.159}
    tiny = spark.createDataFrame([(1,), (2,)], "tiny int")
    assert quality.distribution_stats(tiny).count() == 0 and quality.check_distribution(tiny).first()["status"] == "pass"


@pytest.mark.parametrize("n", [0, 5, 50])
def test_any_size_gives_five_results(spark, n):
    df = spark.createDataFrame([(i % 90, float(i)) for i in range(n)], "age int, score double")
    assert quality.verify(df).count() == 5 and quality.gate(quality.verify(df)).first()["gate_passed"] in (True, False)
