"""Roles of columns, found by their names: direct identifiers, quasi-identifiers, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.values import is_missing, kinds, numeric_columns, string_columns

# Words in the names of direct identifiers, of quasi-identifiers, and of the looser candidates.
DIRECT_WORDS = ["name", "nom", "prenom", "first_name", "last_name", "email", "phone", "telephone", "address", "adresse", "ssn", "nss", "nin", "ip_address", "ip", "patient_id", "id_patient", "mrn"]
QUASI_WORDS = ["age", "gender", "sexe", "zip_code", "code_postal", "birth_date", "date_naissance", "ethnicity", "occupation"]
CANDIDATE_WORDS = ["name", "id", "email", "phone", "address", "ssn"]


def role_of(column: str) -> str | None:
    """`direct`, `quasi` or None.  Words match anywhere in the name, so `hospital_name` is direct and `dosage` quasi;
    `ip` matches only as a part of its own between underscores."""
    name = column.lower().replace(" ", "_")
    if "ip" in name.split("_") or any(word in name for word in DIRECT_WORDS if word != "ip"):
        return "direct"
    return "quasi" if any(word in name for word in QUASI_WORDS) else None


def phi_columns(df: DataFrame) -> dict[str, list[str]]:
    """The direct identifiers and quasi-identifiers of a table, in column order."""
    return {kind: [c for c in df.columns if role_of(c) == kind] for kind in ("direct", "quasi")}


def phi_candidates(df: DataFrame) -> list[str]:
    return [c for c in df.columns if any(word in c.lower() for word in CANDIDATE_WORDS)]


def _per_column(df: DataFrame, columns: list[str], **facts: dict[str, object]) -> DataFrame:
    """(column, *facts, values): values counts what isn't missing, in one pass."""
    counts = df.agg(*[F.count_if(~is_missing(df, c)).alias(f"v{i}") for i, c in enumerate(columns)])
    cells = [F.struct(F.lit(c).alias("column"), *[F.lit(f[c]).alias(n) for n, f in facts.items()], F.col(f"v{i}").alias("values")) for i, c in enumerate(columns)]
    return counts.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def detect_phi_columns(df: DataFrame) -> DataFrame:
    """(column, kind, position, values) of the columns with a role."""
    found = {c: k for k, cs in phi_columns(df).items() for c in cs}
    if not found:
        return df.sparkSession.createDataFrame([], "column string, kind string, position int, values long")
    at = {c: i for i, c in enumerate(df.columns)}
    return _per_column(df, sorted(found, key=at.get), kind=found, position=at)


def column_overview(df: DataFrame) -> DataFrame:
    """(column, position, type, family, values, rows): family is number, text or other."""
    number, text = set(numeric_columns(df)), set(string_columns(df))
    family = {c: "number" if c in number else "text" if c in text else "other" for c in df.columns}
    at = {c: i for i, c in enumerate(df.columns)}
    simple = {c: t.simpleString() for c, t in kinds(df).items()}
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(~is_missing(df, c)).alias(f"v{i}") for c, i in at.items()])
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), F.lit(simple[c]).alias("type"), F.lit(family[c]).alias("family"), F.col(f"v{i}").alias("values"), F.col("rows"))
        for c, i in at.items()
    ]
    return counts.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def candidates_table(df: DataFrame) -> DataFrame:
    """(column, position, values) of the looser candidates."""
    at = {c: i for i, c in enumerate(df.columns)}
    names = phi_candidates(df)
    return _per_column(df, names, position=at) if names else df.sparkSession.createDataFrame([], "column string, position int, values long")


