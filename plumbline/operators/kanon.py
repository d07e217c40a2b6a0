"""k-anonymity: quasi-identifiers in bins, small groups suppressed."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.values import col, is_missing, number, number_like_columns, quoted
from plumbline.operators.identifiers import drop_identifiers, hash_identifiers, replace_identifiers
from plumbline.operators.roles import phi_columns

BINS = 5


def _linspace(low: float, high: float, parts: int) -> list[float]:
    step = (high - low) / parts
    return [low + i * step for i in range(parts)] + [high]


def bin_edges(low: float, high: float, bins: int = BINS) -> list[float]:
    """Equal-width edges.  The first is lowered by a thousandth of the range; a constant is widened to both sides."""
    if low == high:
        margin = 0.001 * abs(low) if low else 0.001
        return _linspace(low - margin, high + margin, bins)
    edges = _linspace(low, high, bins)
    edges[0] -= (high - low) * 0.001
    return edges


def _rounded(x: float, precision: int) -> float:
    if x == 0 or not math.isfinite(x):
        return x
    digits = precision if abs(x) >= 1 else -math.floor(math.log10(abs(x))) - 1 + precision
    scale = 10.0 ** abs(digits)
    return round(x * scale) / scale if digits > 0 else float(round(x / scale) * scale)


def bin_labels(edges: list[float]) -> list[str]:
    """`(lo, hi]` with the fewest decimals that keep the edges apart, halves to even."""
    shown = edges
    for precision in range(20):
        shown = [_rounded(e, precision) for e in edges]
        if len(set(shown)) == len(edges):
            break
    return [f"({a!r}, {b!r}]" for a, b in zip(shown, shown[1:], strict=False)]


def bin_column(df: DataFrame, name: str, low: float | None, high: float | None, bins: int = BINS) -> Column:
    """The value's bin as text; missing values are the group `nan`; where no bins can be made, the value as text."""
    if low is None or not math.isfinite(low) or not math.isfinite(high):
        return F.when(is_missing(df, name), "nan").otherwise(col(name).cast("string"))
    edges = bin_edges(float(low), float(high), bins)
    labels = bin_labels(edges)
    value = number(df, name)
    chain = F.when(value.isNull(), "nan")
    for edge, label in zip(edges[1:-1], labels, strict=False):
        chain = chain.when(value <= F.lit(edge), label)
    return chain.otherwise(labels[-1])


def generalize_numeric(df: DataFrame, columns: list[str], bins: int = BINS) -> DataFrame:
    """Numeric (and boolean) columns among those named, in bins; one pass finds all ranges."""
    chosen = [c for c in number_like_columns(df) if c in columns]
    if not chosen:
        return df
    spans = df.agg(*[f(number(df, c)).alias(f"{n}{i}") for i, c in enumerate(chosen) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return df.withColumns({c: bin_column(df, c, spans[f"lo{i}"], spans[f"hi{i}"], bins) for i, c in enumerate(chosen)})


def group_sizes(df: DataFrame, quasi: list[str]) -> DataFrame:
    """(*quasi, n): sizes of the groups, combined on the map side; groups with a missing value are left out."""
    return df.where(_whole(df, quasi)).groupBy(*[quoted(c) for c in quasi]).agg(F.count(F.lit(1)).alias("n"))


def _whole(df: DataFrame, quasi: list[str]) -> Column:
    out = F.lit(True)
    for c in quasi:
        out = out & ~is_missing(df, c)
    return out


def _present(df: DataFrame, quasi: list[str]) -> list[str]:
    return [c for c in quasi if c in df.columns]


def k_suppress(df: DataFrame, quasi: list[str], k: int) -> DataFrame:
    """Rows whose combination of quasi-identifiers k rows share; without quasi-identifiers, all.

    The large groups' keys are joined back: few keys are broadcast by their measured size, many are shuffled.
    """
    quasi = _present(df, quasi)
    if not quasi:
        return df
    large = group_sizes(df, quasi).where(F.col("n") >= k).select(*[quoted(c) for c in quasi])
    return df.join(large, quasi, "left_semi").select(*[quoted(c) for c in df.columns])


def k_suppressed_stats(df: DataFrame, quasi: list[str], k: int) -> DataFrame:
    """rows_before, rows_after, suppressed, suppressed_pct: from the group table, without a pass over kept rows."""
    quasi = _present(df, quasi)
    if not quasi:
        counted = df.agg(F.count(F.lit(1)).alias("rows_before")).withColumn("rows_after", F.col("rows_before"))
    else:
        groups = df.groupBy(*[quoted(c) for c in quasi]).agg(F.count(F.lit(1)).alias("n"))
        kept = F.when(_whole(df, quasi) & (F.col("n") >= k), F.col("n")).otherwise(0)
        counted = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"), F.coalesce(F.sum(kept), F.lit(0)).alias("rows_after"))
    gone = F.col("rows_before") - F.col("rows_after")
    share = F.when(F.col("rows_before") > 0, gone * 100.0 / F.col("rows_before")).otherwise(F.lit(0.0))
    return counted.select("rows_before", "rows_after", gone.alias("suppressed"), share.cast("double").alias("suppressed_pct"))


def k_verify(df: DataFrame, quasi: list[str], k: int) -> DataFrame:
    """violating_groups (smaller than k, missing values aside) and satisfied."""
    quasi = _present(df, quasi)
    if not quasi:
        return df.limit(0).agg(F.count(F.lit(1)).alias("violating_groups")).withColumn("satisfied", F.lit(True))
    small = group_sizes(df, quasi).agg(F.count_if(F.col("n") < k).alias("violating_groups"))
    return small.withColumn("satisfied", F.col("violating_groups") == 0)


def _side_by_side(**numbers: DataFrame) -> DataFrame:
    """One row of the numbers of one-row tables (x), by a union."""
    rows = None
    for name, table in numbers.items():
        row = table.select(*[F.col("x").alias(n) if n == name else F.lit(None).cast("long").alias(n) for n in numbers])
        rows = row if rows is None else rows.unionByName(row)
    return rows.agg(*[F.max(n).alias(n) for n in numbers])


def retention_report(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """rows_raw, rows_kept, delta, retention_pct, columns_removed (sorted, joined by a comma)."""
    removed = ",".join(sorted(set(raw.columns) - set(kept.columns)))
    counts = _side_by_side(rows_raw=raw.agg(F.count(F.lit(1)).alias("x")), rows_kept=kept.agg(F.count(F.lit(1)).alias("x")))
    return counts.select(
        "rows_raw", "rows_kept", (F.col("rows_raw") - F.col("rows_kept")).alias("delta"),
        F.when(F.col("rows_raw") > 0, F.col("rows_kept") * 100.0 / F.col("rows_raw")).otherwise(F.lit(0.0)).cast("double").alias("retention_pct"), F.lit(removed).alias("columns_removed"),
    )


@dataclass(frozen=True)
class AnonymizeConfig:
    """key is needed for `hash` and row_id for `replace`; there is no default key."""

    k: int = 3
    strategy: str = "replace"
    key: str | None = None
    row_id: str | None = None
    seed: int = 0


def strip_identifiers(df: DataFrame, config: AnonymizeConfig) -> DataFrame:
    direct = phi_columns(df)["direct"]
    if config.strategy == "drop":
        return drop_identifiers(df, direct)
    if config.strategy == "hash":
        if config.key is None:
            raise ValueError("hashing needs a key")
        return hash_identifiers(df, direct, config.key)
    if config.strategy == "replace":
        if config.row_id is None and direct:
            raise ValueError("replacing needs a row_id column")
        return replace_identifiers(df, direct, config.row_id, config.seed)
    raise ValueError(f"unknown strategy {config.strategy}")


def anonymize(df: DataFrame, config: AnonymizeConfig) -> DataFrame:
    """Identifiers stripped, numeric quasi-identifiers in bins, small groups suppressed."""
    quasi = phi_columns(df)["quasi"]
    return k_suppress(generalize_numeric(strip_identifiers(df, config), quasi), quasi, config.k)


def anonymization_report(df: DataFrame, kept: DataFrame, config: AnonymizeConfig) -> DataFrame:
    """One row about what anonymize(df, config) gave as `kept`."""
    roles = phi_columns(df)
    quasi = _present(kept, roles["quasi"])
    one = _side_by_side(
        input_rows=df.agg(F.count(F.lit(1)).alias("x")),
        output_rows=kept.agg(F.count(F.lit(1)).alias("x")),
        violations=k_verify(kept, quasi, config.k).select(F.col("violating_groups").alias("x")),
    ).withColumn("k_anonymity_satisfied", F.col("violations") == 0)

    def names(values: list[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    return one.select(
        "input_rows", names(df.columns).alias("input_columns"), names(roles["direct"]).alias("phi_direct_columns"),
        names(roles["quasi"]).alias("quasi_identifier_columns"), "k_anonymity_satisfied", F.lit(config.k).alias("k_value"),
        (F.col("input_rows") - F.col("output_rows")).alias("rows_suppressed_k_anonymity"), "output_rows",
        names(kept.columns).alias("output_columns"), F.lit(config.strategy).alias("anonymization_strategy"),
    )
