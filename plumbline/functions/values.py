"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a delimited file may write for a missing value.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def kinds(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def numeric_columns(df: DataFrame, but: tuple[str, ...] = ()) -> list[str]:
    """Numbers of any width; booleans aren't."""
    return [c for c, t in kinds(df).items() if isinstance(t, T.NumericType) and c not in but]


def number_like_columns(df: DataFrame, but: tuple[str, ...] = ()) -> list[str]:
    """Numbers and booleans."""
    return [c for c, t in kinds(df).items() if isinstance(t, T.NumericType | T.BooleanType) and c not in but]


def string_columns(df: DataFrame, but: tuple[str, ...] = ()) -> list[str]:
    return [c for c, t in kinds(df).items() if isinstance(t, T.StringType) and c not in but]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, and NaN in a floating-point column."""
    if isinstance(kinds(df)[name], T.FloatType | T.DoubleType):
        return col(name).isNull() | F.isnan(col(name))
    return col(name).isNull()


def present(df: DataFrame, name: str) -> Column:
    """The value, null where it is missing."""
    return F.when(~is_missing(df, name), col(name))


def without_nan(df: DataFrame) -> DataFrame:
    """NaN turned into null, so that comparisons and aggregates need no guard."""
    floats = [c for c, t in kinds(df).items() if isinstance(t, T.FloatType | T.DoubleType)]
    return df.withColumns({c: present(df, c) for c in floats}) if floats else df


def number(df: DataFrame, name: str) -> Column:
    """The value as a double, null where it is missing."""
    return present(df, name).cast("double")


def hmac_sha256(value: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a string column as lower-case hex, by nested digests of binary literals."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    inside = F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(value, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(inside)), 256)


def seeded_number(seed: int, name: str, row: Column, draw: int, below: int) -> Column:
    """A number from 0 to below - 1 that the seed, the column, the row and the draw decide."""
    digest = F.sha2(F.concat_ws("|", F.lit(f"{seed}|{name}|{draw}"), row.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(below))


def long_form(df: DataFrame, parts: dict[str, dict[str, Column]], key: str = "column") -> DataFrame:
    """One pass over df: for each key, its aggregates, as rows (key, *names).  All keys have the same names.

    Expressions are taken some hundred at a time, so that no generated method grows too large.
    """
    keys = list(parts)
    names = list(next(iter(parts.values()))) if parts else []
    if not keys:
        raise ValueError("no columns to aggregate")
    step = max(1, 200 // max(1, len(names)))
    out = None
    for at in range(0, len(keys), step):
        some = keys[at : at + step]
        row = df.agg(*[parts[k][n].alias(f"v{i}_{j}") for i, k in enumerate(some) for j, n in enumerate(names)])
        cells = F.array(*[F.struct(F.lit(k).alias(key), *[F.col(f"v{i}_{j}").alias(n) for j, n in enumerate(names)]) for i, k in enumerate(some)])
        long = row.select(F.explode(cells).alias("r")).select("r.*")
        out = long if out is None else out.unionByName(long)
    return out


def long_forms(df: DataFrame, requests: list[tuple[dict[str, dict[str, Column]], str]]) -> list[DataFrame]:
    """What long_form() gives for each (parts, key), all of them by one pass over df; the aggregates' row is collected."""
    flat = [(r, k, n, e) for r, (parts, _) in enumerate(requests) for k, es in parts.items() for n, e in es.items()]
    if not flat:
        raise ValueError("nothing to aggregate")
    found: dict[tuple, object] = {}
    types: dict[tuple, T.DataType] = {}
    for at in range(0, len(flat), 400):  # wider tables take a pass for each 400 aggregates
        some = flat[at : at + 400]
        row = df.agg(*[e.alias(f"v{i}") for i, (_, _, _, e) in enumerate(some)])
        values = row.first()
        for i, (r, k, n, _) in enumerate(some):
            found[r, k, n], types[r, n] = values[i], row.schema[i].dataType
    out = []
    for r, (parts, key) in enumerate(requests):
        names = list(next(iter(parts.values()), {}))
        schema = T.StructType([T.StructField(key, T.StringType()), *[T.StructField(n, types[r, n]) for n in names]]) if parts else T.StructType([T.StructField(key, T.StringType())])
        out.append(df.sparkSession.createDataFrame([(k, *[found[r, k, n] for n in names]) for k in parts], schema))
    return out
