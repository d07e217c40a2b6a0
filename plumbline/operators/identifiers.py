"""Direct identifiers: dropped, hashed with a key, or replaced by synthetic values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.shared import dense_positions
from plumbline.functions.values import col, hmac_sha256, is_missing, quoted, seeded_number

FIRST_NAMES = ["Alma", "Bruno", "Celia", "Dario", "Elena", "Fabio", "Greta", "Hugo", "Irma", "Jonas", "Karla", "Luis", "Mina", "Nils", "Olga", "Pablo"]
LAST_NAMES = ["Arden", "Blum", "Castel", "Dorn", "Elvas", "Ferro", "Gran", "Holm", "Ives", "Jarre", "Kern", "Lund", "Maro", "Noll", "Orsini", "Pardo"]
STREETS = ["Mill Lane", "River Road", "Station Street", "Garden Way", "Church Hill", "Market Square", "Harbour Row", "North Avenue"]
# The first kind whose word is in a column's name is the kind of its replacements; a name with none gets numbered ids.
KINDS = [("person", ["name", "nom", "prenom"]), ("email", ["email"]), ("phone", ["phone", "tel"]), ("address", ["address", "adresse"]), ("ssn", ["ssn", "nss", "nin"]), ("ip", ["ip"])]


def drop_identifiers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Without the columns; names that the table doesn't have are ignored."""
    return df.drop(*[c for c in columns if c in df.columns])


def hash_identifiers(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """The first 16 hex digits of each value's HMAC-SHA256; a missing value is hashed as the text `nan`."""
    made = {c: F.substring(hmac_sha256(F.when(is_missing(df, c), "nan").otherwise(col(c).cast("string")), key.encode()), 1, 16) for c in columns if c in df.columns}
    return df.withColumns(made) if made else df


def replacement_kind(column: str) -> str:
    name = column.lower()
    return next((kind for kind, words in KINDS if any(w in name for w in words)), "number")


def with_position(df: DataFrame, row_id: str, name: str) -> DataFrame:
    """Adds the row's place in the order of row_id, from 0."""
    return dense_positions(df, row_id, name)


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def synthetic(column: str, kind: str, seed: int, row: Column) -> Column:
    """A value of the kind that the seed, the column and the row decide."""

    def n(draw: int, below: int) -> Column:
        return seeded_number(seed, column, row, draw, below)

    first, last = _pick(FIRST_NAMES, n(0, len(FIRST_NAMES))), _pick(LAST_NAMES, n(1, len(LAST_NAMES)))
    if kind == "person":
        return F.concat_ws(" ", first, last)
    if kind == "email":
        return F.lower(F.concat(first, F.lit("."), last, n(2, 10_000).cast("string"), F.lit("@example.org")))
    if kind == "phone":
        return F.concat(F.lit("+00 "), F.lpad(n(0, 1_000_000_000).cast("string"), 9, "0"))
    if kind == "address":
        return F.concat((n(0, 200) + 1).cast("string"), F.lit(" "), _pick(STREETS, n(1, len(STREETS))), F.lit(", "), F.lpad(n(2, 100_000).cast("string"), 5, "0"))
    if kind == "ssn":
        return F.lpad(n(0, 1_000_000_000).cast("string"), 9, "0")
    return F.concat_ws(".", *[(n(i, 254) + 1).cast("string") for i in range(4)])


def replace_identifiers(df: DataFrame, columns: list[str], row_id: str, seed: int = 0) -> DataFrame:
    """Every row gets a synthetic value, rows with a missing one too; equal originals get values of their own."""
    chosen = [c for c in columns if c in df.columns]
    numbered = [c for c in chosen if replacement_kind(c) == "number"]
    if numbered:
        df = with_position(df, row_id, "_position")
    made = {c: F.format_string("ANON_%06d", F.col("_position")) if c in numbered else synthetic(c, replacement_kind(c), seed, col(row_id)) for c in chosen}
    out = df.withColumns(made) if made else df
    return out.drop("_position") if numbered else out


def replacement_map(before: DataFrame, after: DataFrame, column: str, row_id: str) -> DataFrame:
    """(original, replacement): for an original that repeats, the replacement of its last row."""
    old = before.select(col(row_id).alias("row"), F.when(is_missing(before, column), "nan").otherwise(col(column).cast("string")).alias("original"))
    new = after.select(col(row_id).alias("row"), col(column).alias("replacement"))
    return old.join(new, "row").groupBy("original").agg(F.max_by("replacement", "row").alias("replacement"))


def preview(df: DataFrame, order: str, rows: int = 20, columns: list[str] | None = None) -> DataFrame:
    """The first rows by the order key, of the chosen columns (by default the first ten)."""
    return df.orderBy(quoted(order)).limit(min(100, max(5, rows))).select(*[quoted(c) for c in columns or df.columns[:10]])
