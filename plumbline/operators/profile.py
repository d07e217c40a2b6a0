"""Column profiles for exploration: summaries, missing values, histograms, densities, correlations, outliers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.quantiles import quantiles
from plumbline.functions.values import col, is_missing, long_form, number, numeric_columns, string_columns
from plumbline.functions.gauss import cell_moments, densities
from plumbline.operators.features import Params, fit_bounds, outlier_counts
from plumbline.operators.pairwise import correlations
from plumbline.operators.quality import duplicate_stats, missing_rates, moments
from plumbline.operators.roles import phi_candidates

KDE_POINTS = 200


def _nothing(df: DataFrame, schema: str) -> DataFrame:
    """What a profile of no columns gives."""
    return df.sparkSession.createDataFrame([], schema)


def _quartiles(df: DataFrame, names: list[str], exact: bool) -> dict[str, list[float] | None]:
    return quantiles(df, {c: number(df, c) for c in names}, [0.25, 0.5, 0.75], exact)


def describe_numbers(df: DataFrame, but: tuple[str, ...] = (), exact: bool = True) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max, missing_pct), quartiles exact and interpolated, or approximate."""
    parts = {}
    if not numeric_columns(df, but):
        return _nothing(df, "column string, count long, mean double, std double, min double, q25 double, q50 double, q75 double, max double, missing_pct double")
    for c, found in _quartiles(df, numeric_columns(df, but), exact).items():
        v = number(df, c)
        q = [F.max(F.lit(x).cast("double")) for x in found or [None] * 3]
        parts[c] = {
            "count": F.count(v), "mean": F.avg(v), "std": F.stddev_samp(v), "min": F.min(v), "q25": q[0], "q50": q[1], "q75": q[2], "max": F.max(v),
            "missing_pct": F.when(F.count(F.lit(1)) > 0, F.round(F.count_if(is_missing(df, c)) * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1)), 2)),
        }
    return long_form(df, parts)


def _value_table(df: DataFrame, names: list[str]) -> DataFrame:
    """(i, v, n): counts of each column's present values, by one shuffle on column and value."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), col(c).alias("v")) for i, c in enumerate(names)])
    return df.select(F.explode(cells).alias("x")).where("x.v is not null").groupBy("x.i", "x.v").agg(F.count(F.lit(1)).alias("n"))


def _named(names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in names]), F.col("i") + 1).alias("column")


def describe_strings(df: DataFrame, but: tuple[str, ...] = ()) -> DataFrame:
    """(column, count, unique, top, freq): ties for top go to the smallest."""
    names = string_columns(df, but)
    if not names:
        return _nothing(df, "column string, count long, unique long, top string, freq long")
    best = F.min_by("v", F.struct((-F.col("n")).alias("n"), "v"))
    return _value_table(df, names).groupBy("i").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), best.alias("top"), F.max("n").alias("freq")).select(_named(names), "count", "unique", "top", "freq")


def missing_ranking(df: DataFrame) -> DataFrame:
    """(column, missing, rate, level) of columns with missing values, most first."""
    level = F.when(F.col("rate") > 0.30, "CRITICAL").when(F.col("rate") > 0.15, "WARNING").otherwise("OK")
    return missing_rates(df).where("missing > 0").select("column", "missing", "rate", level.alias("level")).orderBy(F.desc("rate"), "column")


def missing_table(df: DataFrame) -> DataFrame:
    """(column, missing, rate_pct, level, mean_pct): rates in percent with 2 decimals, and their mean over columns."""
    rows = missing_rates(df).select("column", "missing", F.round(F.col("rate") * 100, 2).alias("rate_pct"), "rate")
    level = F.when(F.col("rate_pct") <= 15, "OK").when(F.col("rate_pct") <= 30, "Warn").otherwise("Fail")
    cells = rows.agg(F.collect_list(F.struct("column", "missing", "rate_pct")).alias("rows"), (F.avg("rate") * 100).alias("mean_pct"))
    return cells.select(F.explode("rows").alias("r"), "mean_pct").select("r.column", "r.missing", "r.rate_pct", "mean_pct").withColumn("level", level)


def missing_map(df: DataFrame, but: tuple[str, ...] = ()) -> DataFrame:
    """(pattern, rows): how many rows miss which columns; pattern has a 1 for each missing column, in column order."""
    flags = [F.when(is_missing(df, c), "1").otherwise("0") for c in df.columns if c not in but]
    return df.groupBy(F.concat(*flags).alias("pattern")).agg(F.count(F.lit(1)).alias("rows"))


def histogram(df: DataFrame, bins: int = 25, but: tuple[str, ...] = (), most_columns: int | None = None) -> DataFrame:
    """(column, bin, low, width, count, density): equal-width bins over the range, the last closed on the right; empty bins
    give no row.  A constant column has one bin of width 1 around it."""
    names = numeric_columns(df, but)[:most_columns]
    none = "column string, bin int, low double, width double, count long, density double"
    if not names:
        return _nothing(df, none)
    spans = df.agg(*[f(number(df, c)).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    cells = []
    for i, c in enumerate(names):
        lo, hi = spans[f"lo{i}"], spans[f"hi{i}"]
        if lo is None:
            continue
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        width = (hi - lo) / bins
        at = F.least(F.floor((number(df, c) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
        cells.append(F.struct(F.lit(c).alias("column"), at.alias("bin"), F.lit(float(lo)).alias("first"), F.lit(float(width)).alias("width")))
    if not cells:
        return _nothing(df, none)
    rows = df.select(F.explode(F.array(*cells)).alias("x")).where("x.bin is not null").groupBy("x.column", "x.bin", "x.first", "x.width").agg(F.count(F.lit(1)).alias("count"))
    totals = rows.groupBy("column").agg(F.sum("count").alias("total"))
    return rows.join(F.broadcast(totals), "column").select(
        "column", "bin", (F.col("first") + F.col("bin") * F.col("width")).alias("low"), "width", "count", (F.col("count") / (F.col("total") * F.col("width"))).alias("density")
    )


def location_stats(df: DataFrame, but: tuple[str, ...] = (), exact: bool = True) -> DataFrame:
    """(column, n, mean, median, skewness)."""
    names = numeric_columns(df, but)
    if not names:
        return _nothing(df, "column string, n long, mean double, median double, skewness double")
    found = quantiles(df, {c: number(df, c) for c in names}, [0.5], exact)
    parts = {}
    for c in names:
        m = moments(df, c)
        parts[c] = {"n": m["n"], "mean": m["mean"], "median": F.max(F.lit(found[c] and found[c][0]).cast("double")), "skewness": m["skewness"]}
    return long_form(df, parts)


def kde_curve(df: DataFrame, column: str, points: int = KDE_POINTS, bins: int | None = None) -> DataFrame:
    """(point, x, density): Gaussian kernels at evenly spaced points, bandwidth n ** (-1/5) * std.

    Values go to cells of half a bandwidth with their moments about its middle, by one aggregate; a point meets the cells
    within eight bandwidths (functions/gauss.py), with an error below 1e-10 of a kernel's peak, however many values differ.
    With `bins` the values go to so many bins of the range, and each bin is a kernel at its middle: a value moves by half a
    bin at most, and the kernel is nowhere steeper than 0.61 of its peak a bandwidth, so a density is off by 0.31 * bin /
    bandwidth of the peak at most.
    """
    v = number(df, column)
    s = df.agg(F.count(v).alias("n"), F.stddev_samp(v).alias("std"), F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    if s["n"] < 2 or not s["std"]:
        return df.sparkSession.createDataFrame([], "point int, x double, density double")
    width = s["std"] * s["n"] ** -0.2
    if bins:
        step = (s["hi"] - s["lo"]) / bins
        v = F.lit(s["lo"]) + (F.least(F.floor((v - F.lit(s["lo"])) / F.lit(step)), F.lit(bins - 1)) + 0.5) * F.lit(step)
    return densities(cell_moments(df.select(v.alias("v")), "v", s["lo"], width), s["lo"], s["hi"], width, s["n"], points)


def value_counts(df: DataFrame, most_distinct: int = 20, but: tuple[str, ...] = ()) -> DataFrame:
    """(column, value, count) of string columns with up to most_distinct values."""
    names = string_columns(df, but)
    if not names:
        return _nothing(df, "column string, value string, count long")
    counts = _value_table(df, names)
    few = counts.groupBy("i").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") <= most_distinct).select("i")
    return counts.join(F.broadcast(few), "i").select(_named(names), F.col("v").alias("value"), F.col("n").alias("count"))


def cardinality_mode(df: DataFrame, most_distinct: int = 20, but: tuple[str, ...] = ()) -> DataFrame:
    """(column, distinct, mode) of string columns with up to most_distinct values."""
    rows = describe_strings(df, but).where(F.col("unique") <= most_distinct)
    return rows.select("column", F.col("unique").alias("distinct"), F.col("top").alias("mode"))


def correlation_matrix(df: DataFrame, but: tuple[str, ...] = (), digits: int | None = None) -> DataFrame:
    """(col_a, col_b, r) of every pair of numeric columns, over rows in which both are present; one pass."""
    names = numeric_columns(df, but)
    if len(names) < 2:
        return _nothing(df, "col_a string, col_b string, r double")
    found = correlations(df, {c: number(df, c) for c in names})
    name = F.array(*[F.lit(c) for c in names])
    a, b = F.element_at(name, F.col("a") + 1), F.element_at(name, F.col("b") + 1)
    each = found.where("a < b or n > 1").select(a.alias("a"), b.alias("b"), F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(F.col("r")).alias("r"))
    turned = F.array(F.struct(F.col("a").alias("col_a"), F.col("b").alias("col_b"), "r"), F.when(F.col("a") != F.col("b"), F.struct(F.col("b").alias("col_a"), F.col("a").alias("col_b"), "r")))
    out = each.select(F.explode(F.array_compact(turned)).alias("x")).select("x.*")
    return out if digits is None else out.withColumn("r", F.round("r", digits))


def strong_pairs(df: DataFrame, least: float = 0.5, but: tuple[str, ...] = ()) -> DataFrame:
    """(col_a, col_b, r, strong) of pairs with |r| above least, each once, strongest first; strong: above 0.8."""
    names = numeric_columns(df, but)
    if len(names) < 2:
        return _nothing(df, "col_a string, col_b string, r double, strong boolean")
    place = F.create_map(*[F.lit(x) for i, c in enumerate(names) for x in (c, i)])
    rows = correlation_matrix(df, but).where((place[F.col("col_a")] < place[F.col("col_b")]) & (F.abs("r") > least))
    return rows.select("col_a", "col_b", F.round("r", 3).alias("r"), (F.abs("r") > 0.8).alias("strong")).orderBy(F.abs("r").desc(), "col_a", "col_b")


def outlier_report(df: DataFrame, but: tuple[str, ...] = (), factor: float = 1.5, exact: bool = True) -> DataFrame:
    """(column, low, high, outliers, values, outlier_pct, level): bad above 5 %, warn above 1 %."""
    params = Params(skip=but)
    fit_bounds(df, params, factor, exact)
    pct = F.when(F.col("values") > 0, F.col("outliers") * 100.0 / F.col("values")).otherwise(F.lit(0.0))
    return outlier_counts(df, params).withColumn("outlier_pct", pct).withColumn("level", F.when(F.col("outlier_pct") > 5, "bad").when(F.col("outlier_pct") > 1, "warn").otherwise("ok"))


def boxplot_stats(df: DataFrame, but: tuple[str, ...] = (), exact: bool = True) -> DataFrame:
    """(column, q1, median, q3, whisker_low, whisker_high): whiskers are the extreme values within 1.5 iqr of the box."""
    parts = {}
    for c, found in _quartiles(df, numeric_columns(df, but), exact).items():
        if not found:
            continue
        q1, q2, q3 = found
        v = number(df, c)
        inside = F.when(v.between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)), v)
        parts[c] = {"q1": F.max(F.lit(q1)), "median": F.max(F.lit(q2)), "q3": F.max(F.lit(q3)), "whisker_low": F.min(inside), "whisker_high": F.max(inside)}
    return long_form(df, parts) if parts else _nothing(df, "column string, q1 double, median double, q3 double, whisker_low double, whisker_high double")


def recommendations(df: DataFrame) -> DataFrame:
    """(subject, advice, value): what to do about missing values, candidate identifiers and duplicate rows."""
    rates = missing_rates(df)
    advice = F.when(F.col("rate") > 0.30, "drop").when(F.col("rate") > 0.15, "impute").otherwise("acceptable")
    missing = rates.where("missing > 0").select(F.col("column").alias("subject"), advice.alias("advice"), F.col("rate").cast("double").alias("value"))
    names = phi_candidates(df)
    candidates = rates.where(F.col("column").isin(names)).select(F.col("column").alias("subject"), F.lit("anonymize").alias("advice"), F.lit(None).cast("double").alias("value"))
    copies = duplicate_stats(df).where("duplicates > 0").select(F.lit("rows").alias("subject"), F.lit("remove duplicates").alias("advice"), F.col("duplicates").cast("double").alias("value"))
    return missing.unionByName(candidates).unionByName(copies)
