"""Dates in text columns: the format that a column's values have, found by one aggregate, and reading by it.

ISO dates and times need no format.  Of the others each stands for one way of writing all of a column: a value that doesn't
fit its column's format is missing, as a date in another order would be read as another day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.values import col, kinds

ISO = "iso"
# The formats tried, in the order in which one is preferred to the next (month before day, where both fit).
FORMATS = [
    ISO, "M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "M-d-yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy.M.d", "yyyyMMdd", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d-MMM-yyyy",
    "M/d/yyyy H:mm", "d/M/yyyy H:mm", "M/d/yyyy H:mm:ss", "d/M/yyyy H:mm:ss", "d.M.yyyy H:mm", "d.M.yyyy H:mm:ss", "yyyy/M/d H:mm:ss",
]


def _by(text: Column, how: str) -> Column:
    return F.try_to_timestamp(text) if how == ISO else F.try_to_timestamp(text, F.lit(how))


def moment(df: DataFrame, name: str, how: str = ISO) -> Column:
    """The value as a timestamp by its column's format, null where it doesn't fit; dates and timestamps are what they are."""
    if isinstance(kinds(df)[name], T.DateType | T.TimestampType | T.TimestampNTZType):
        return col(name).cast("timestamp")
    return _by(F.trim(col(name).cast("string")), how)


def chosen(fits: list[int], first: list[bool]) -> str:
    """The first format that reads the first value; without a first value, or if none reads it, the one that reads most
    values, ties to the earlier in FORMATS; ISO if none reads any."""
    if any(first):
        return FORMATS[first.index(True)]
    return FORMATS[fits.index(max(fits))] if any(fits) else ISO


def formats_of(values: DataFrame, key: str, value: str, count: str, first: str | None) -> dict:
    """{key: format} of a table of distinct values with their counts and, if given, an order of first appearance."""
    text = F.trim(F.col(value))
    reads = [_by(text, how).isNotNull() for how in FORMATS]
    earliest = F.min_by(F.array(*reads), F.col(first)) if first else F.array(*[F.lit(False) for _ in FORMATS])
    counts = F.array(*[F.coalesce(F.sum(F.when(r, F.col(count))), F.lit(0)) for r in reads])
    return {r["key"]: chosen(r["fits"], r["first"]) for r in values.groupBy(F.col(key).alias("key")).agg(counts.alias("fits"), earliest.alias("first")).collect()}


def formats(df: DataFrame, names: list[str], row_id: str | None = None) -> dict[str, str]:
    """The format of each column that holds text; by one scan, which counts distinct values first, so that each is tried once.

    With row_id the first value in its order decides, without it the one that reads most rows.
    """
    texts = [c for c in names if isinstance(kinds(df)[c], T.StringType)]
    if not texts:
        return {}
    at = col(row_id) if row_id else F.lit(None).cast("long")
    cells = F.array(*[F.struct(F.lit(i).alias("i"), col(c).alias("v")) for i, c in enumerate(texts)])
    each = df.select(F.explode(cells).alias("x"), at.alias("at")).where("x.v is not null")
    values = each.groupBy("x.i", "x.v").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    found = formats_of(values, "i", "v", "n", "at" if row_id else None)
    return {c: found.get(i, ISO) for i, c in enumerate(texts)}
