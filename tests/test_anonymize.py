import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from plumbline.operators import identifiers, kanon, roles

PEOPLE = [("P001", "A", "a@x", 45, "F", "75001", "flu", 120), ("P002", "B", "b@x", 32, "M", "75002", "flu", 130), ("P003", "C", "c@x", 67, "F", "75003", "cold", 140),
          ("P004", "D", "d@x", 45, "M", "75001", "flu", 125), ("P005", "E", "e@x", 32, "F", "75002", "cold", 135), ("P006", "F", "f@x", 67, "M", "75003", "flu", 145)]


@pytest.fixture(scope="module")
def people(spark):
    schema = "patient_id string, name string, email string, age int, gender string, zip_code string, diagnosis string, blood_pressure int"
    return spark.createDataFrame(PEOPLE, schema).withColumn("row_id", F.substring("patient_id", 2, 3).cast("int") - 1)


def test_roles_come_from_names(people, spark):
    assert roles.phi_columns(people) == {"direct": ["patient_id", "name", "email"], "quasi": ["age", "gender", "zip_code"]}
    assert [roles.role_of(c) for c in ("hospital_name", "dosage", "sex", "ip", "client_ip", "zip", "IP Address")] == ["direct", "quasi", None, "direct", "direct", None, "direct"]
    plain = spark.createDataFrame([(1, 2, "x")], "blood_pressure int, glucose int, diagnosis string")
    assert roles.phi_columns(plain) == {"direct": [], "quasi": []}
    assert roles.detect_phi_columns(plain).count() == 0


def test_hash_is_keyed_and_short(people):
    out = identifiers.hash_identifiers(people, ["patient_id", "absent"], "test-key").orderBy("row_id").collect()
    assert out[0]["patient_id"] == "d6991bbbe8554b0a"
    long_key = "k" * 100
    got = identifiers.hash_identifiers(people, ["name"], long_key).orderBy("row_id").first()["name"]
    assert got == hmac.new(long_key.encode(), b"A", hashlib.sha256).hexdigest()[:16]


def test_missing_values_are_hashed_as_nan(spark):
    df = spark.createDataFrame([(None,), ("nan",)], "name string")
    assert len({r["name"] for r in identifiers.hash_identifiers(df, ["name"], "k").collect()}) == 1


def test_drop_ignores_unknown_names(people):
    assert identifiers.drop_identifiers(people, ["name", "nothing"]).columns == [c for c in people.columns if c != "name"]


def test_replace_keeps_rows_and_leaves_no_original(people):
    direct = ["patient_id", "name", "email"]
    out = identifiers.replace_identifiers(people, direct, "row_id", seed=3)
    rows = out.orderBy("row_id").collect()
    assert [r["patient_id"] for r in rows] == [f"ANON_{i:06d}" for i in range(6)]
    assert not {r["name"] for r in rows} & {p[1] for p in PEOPLE}
    assert rows == identifiers.replace_identifiers(people, direct, "row_id", seed=3).orderBy("row_id").collect()
    assert identifiers.replacement_kind("ip_address") == "address" and identifiers.replacement_kind("telephone") == "phone"


def test_positions_are_dense_over_many_ranges(spark):
    df = spark.range(0, 5000, 7).withColumn("v", F.rand(1)).repartition(5)
    rows = identifiers.with_position(df, "id", "at").orderBy("id").collect()
    assert [r["at"] for r in rows] == list(range(len(rows)))


def test_bins(people, spark):
    ages = kanon.generalize_numeric(people, ["age", "gender"]).orderBy("row_id").select("age").collect()
    assert [r[0] for r in ages] == ["(39.0, 46.0]", "(32.0, 39.0]", "(60.0, 67.0]"] * 2
    df = spark.createDataFrame([(18.0,), (64.0,), (27.0,), (28.0,), (36.4,), (None,)], "age double")
    got = [r[0] for r in kanon.generalize_numeric(df, ["age"]).collect()]
    assert got == ["(18.0, 27.0]", "(55.0, 64.0]", "(18.0, 27.0]", "(27.0, 36.0]", "(27.0, 36.0]", "nan"]
    fives = spark.createDataFrame([(5,)] * 3, "age int")
    assert {r[0] for r in kanon.generalize_numeric(fives, ["age"]).collect()} == {"(4.999, 5.001]"}
    small = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (0.9,)], "age double")
    assert [r[0] for r in kanon.generalize_numeric(small, ["age"]).collect()] == ["(0.1, 0.3]", "(0.1, 0.3]", "(0.3, 0.4]", "(0.7, 0.9]"]
    zeros = spark.createDataFrame([(0.0,)], "age double")
    assert kanon.generalize_numeric(zeros, ["age"]).first()[0] == "(-0.0002, 0.0002]"
    endless = spark.createDataFrame([(1.0,), (float("inf"),)], "age double")
    assert {r[0] for r in kanon.generalize_numeric(endless, ["age"]).collect()} == {"1.0", "Infinity"}


def test_small_groups_go(people, spark):
    quasi = ["age", "gender"]
    assert kanon.k_suppress(people, quasi, 3).count() == 0
    assert kanon.k_suppress(people, quasi, 1).count() == 6
    assert kanon.k_suppress(people, [], 3).count() == 6
    stats = kanon.k_suppressed_stats(people, quasi, 3).first()
    assert (stats["rows_before"], stats["rows_after"], stats["suppressed"], stats["suppressed_pct"]) == (6, 0, 6, 100.0)
    ranges = spark.createDataFrame([("20-30", 1), ("20-30", 2), ("30-40", 3)], "age string, data int")
    found = kanon.k_verify(ranges, ["age"], 3).first()
    assert (found["violating_groups"], found["satisfied"]) == (2, False)
    assert kanon.k_verify(ranges, [], 3).first()["satisfied"]
    holes = spark.createDataFrame([(None, "F")] * 5, "age string, gender string")
    assert kanon.k_suppress(holes, quasi, 2).count() == 0 and kanon.k_verify(holes, quasi, 9).first()["satisfied"]


@pytest.mark.parametrize("strategy", ["drop", "hash", "replace"])
def test_anonymize_and_report(people, strategy):
    config = kanon.AnonymizeConfig(k=2, strategy=strategy, key="k", row_id="row_id")
    kept = kanon.anonymize(people.drop("zip_code", "gender"), config)
    report = kanon.anonymization_report(people.drop("zip_code", "gender"), kept, config).first()
    assert report["output_rows"] == 6 and report["k_anonymity_satisfied"] and report["phi_direct_columns"] == ["patient_id", "name", "email"]
    assert not [r for r in kept.collect() if "name" in kept.columns and r["name"] in {p[1] for p in PEOPLE}]


def test_keys_and_row_ids_are_asked_for(people):
    with pytest.raises(ValueError):
        kanon.anonymize(people, kanon.AnonymizeConfig(strategy="hash"))
    with pytest.raises(ValueError):
        kanon.anonymize(people, kanon.AnonymizeConfig(strategy="replace"))
