"""Data-quality checks and the gate: missing values, duplicates, value ranges, dates, negatives, distributions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.dates import ISO, formats, moment
from plumbline.functions.members import may_be_among
from plumbline.functions.shared import written
from plumbline.functions.values import col, is_missing, long_form, long_forms, number, number_like_columns, numeric_columns, quoted
from plumbline.sources.digests import row_digests

# The range of plausible values by a word in the column's name; words of columns that can't be negative;
# pairs of columns of which the first can't be before the second.
DOMAIN_RANGES = {"age": (0, 120), "blood_pressure": (50, 250), "heart_rate": (30, 220), "glucose": (30, 600), "bmi": (10, 70), "temperature": (35, 42), "oxygen_saturation": (70, 100)}
POSITIVE_WORDS = ["age", "blood_pressure", "glucose", "bmi", "heart_rate"]
DATE_PAIRS = [("treatment_date", "diagnosis_date"), ("date_traitement", "date_diagnostic")]
MISSING_FAILS_FROM = 0.30
DUPLICATES_FAIL_FROM = 5.0
WIDEST_AGE_GROUP = 30
LEAST_VALUES = 10
SKEW_WARNS_ABOVE = 3.0

Parts = dict[str, dict[str, Column]]  # aggregates by name, of each column or rule
RESULT = "name string, status string, message string, value double, threshold double, details string"


@dataclass(frozen=True)
class QualityConfig:
    missing_threshold: float = 0.15
    drift_threshold: float = 0.3
    domain_rules: dict[str, tuple[float, float]] = field(default_factory=dict)
    row_id: str | None = None


def _missing_parts(df: DataFrame, but: tuple[str, ...] = ()) -> Parts:
    return {c: {"missing": F.count_if(is_missing(df, c)), "rows": F.count(F.lit(1))} for c in df.columns if c not in but}


def missing_rates(df: DataFrame, but: tuple[str, ...] = (), counted: DataFrame | None = None) -> DataFrame:
    """(column, missing, rows, rate) of every column, in one pass."""
    rate = F.when(F.col("rows") > 0, F.col("missing") / F.col("rows")).otherwise(F.lit(0.0))
    return (long_form(df, _missing_parts(df, but)) if counted is None else counted).withColumn("rate", rate)


def _details(rows: DataFrame, *names: str) -> Column:
    """A JSON text of the rows, sorted by their first name."""
    return F.to_json(F.array_sort(F.collect_list(F.struct(*names))))


def _result(table: DataFrame, name: str, status: Column, message: Column, value: Column, threshold: float | None, details: Column) -> DataFrame:
    return table.select(
        F.lit(name).alias("name"), status.alias("status"), message.alias("message"), value.cast("double").alias("value"),
        F.lit(threshold).cast("double").alias("threshold"), details.cast("string").alias("details"),
    )


def check_missing(df: DataFrame, threshold: float = 0.15, counted: DataFrame | None = None) -> DataFrame:
    """Fails from a rate of 0.30, warns above the threshold; a table without columns passes."""
    if not df.columns:
        return df.sparkSession.createDataFrame([("missing_values", "pass", "no columns", 0.0, float(threshold), "[]")], RESULT)
    rates = missing_rates(df, counted=counted)
    above = F.col("rate") > threshold
    row = rates.agg(
        F.count_if(above).alias("bad"), F.max("rate").alias("top"), _details(rates, "column", "rate").alias("every"),
        F.to_json(F.array_sort(F.collect_list(F.when(above, F.struct("column", "rate"))))).alias("violating"),
    )
    clean = F.col("bad") == 0
    status = F.when(clean, "pass").when(F.col("top") < MISSING_FAILS_FROM, "warn").otherwise("fail")
    message = F.when(clean, "no column above the threshold").otherwise(F.format_string("%d columns above the threshold", "bad"))
    return _result(row, "missing_values", status, message, F.col("top"), threshold, F.when(clean, F.col("every")).otherwise(F.col("violating")))


def duplicate_stats(df: DataFrame, digest: Callable[[DataFrame], Column] = lambda df: row_digests(df)[0]) -> DataFrame:
    """(rows, duplicates, duplicate_pct): rows beyond the first of each group of equal rows; missing equals missing.

    Digests are counted first, which shuffles a few bytes a row; whole rows shuffle only if a bitmap says that their digest
    may repeat, and they alone decide, so digests that collide change nothing.
    """
    cells = df.select(digest(df).alias("key"), *[col(c).alias(f"c{i}") for i, c in enumerate(df.columns)])  # names that can't clash
    repeated = written(cells.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "repeated")
    beyond = 0
    if not repeated.isEmpty():
        groups = may_be_among(cells, F.col("key"), repeated).groupBy(*cells.columns[1:]).agg(F.count(F.lit(1)).alias("n"))
        beyond = groups.agg(F.sum(F.col("n") - 1).alias("n")).first()["n"] or 0
    counted = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("duplicates", F.lit(beyond).cast("long"))
    return counted.withColumn("duplicate_pct", F.when(F.col("rows") > 0, F.col("duplicates") * 100.0 / F.col("rows")).otherwise(F.lit(0.0)).cast("double"))


def check_duplicates(df: DataFrame) -> DataFrame:
    row = duplicate_stats(df)
    status = F.when(F.col("duplicates") == 0, "pass").when(F.col("duplicate_pct") < DUPLICATES_FAIL_FROM, "warn").otherwise("fail")
    details = F.to_json(F.struct(F.col("duplicates").alias("count"), F.round("duplicate_pct", 2).alias("pct")))
    return _result(row, "duplicates", status, F.format_string("%d duplicate rows", "duplicates"), F.col("duplicates"), None, details)


def domain_pairs(df: DataFrame, custom_rules: dict[str, tuple[float, float]] | None) -> list[tuple[str, str, float, float]]:
    """(column, rule, low, high) of all columns that a rule's word names; custom rules come last."""
    rules = {**DOMAIN_RANGES, **(custom_rules or {})}
    return [(c, rule, float(low), float(high)) for rule, (low, high) in rules.items() for c in number_like_columns(df) if rule in c.lower()]


def _domain_parts(df: DataFrame, custom_rules: dict[str, tuple[float, float]] | None) -> Parts:
    pairs = enumerate(domain_pairs(df, custom_rules))
    return {str(i): {"count": F.count_if((number(df, c) < low) | (number(df, c) > high))} for i, (c, _, low, high) in pairs}


def domain_violations(df: DataFrame, custom_rules: dict[str, tuple[float, float]] | None = None, row_id: str | None = None, examples: int = 3, counted: DataFrame | None = None) -> DataFrame:
    """(column, rule, low, high, count, examples) of columns with values outside their range; missing values aren't.

    A column that violates two rules keeps the later one.  examples are the first values in the order of row_id.
    """
    pairs = domain_pairs(df, custom_rules)
    schema = "column string, rule string, low double, high double, count long, examples array<double>"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    counts = long_form(df, _domain_parts(df, custom_rules), "pair") if counted is None else counted
    cells = F.create_map(*[x for i, p in enumerate(pairs) for x in (F.lit(str(i)), F.struct(F.lit(p[0]).alias("column"), F.lit(p[1]).alias("rule"), F.lit(p[2]).alias("low"), F.lit(p[3]).alias("high"), F.lit(i).alias("at")))])
    hit = counts.where("count > 0").select(cells[F.col("pair")].alias("p"), "count").select("p.*", "count")
    last = hit.groupBy("column").agg(F.max_by(F.struct("rule", "low", "high", "count"), "at").alias("r")).select("column", "r.*")
    if row_id is None:
        return last.withColumn("examples", F.array().cast("array<double>"))
    values = [F.struct(F.lit(c).alias("column"), F.lit(rule).alias("rule"), number(df, c).alias("v"), col(row_id).alias("o")) for c, rule, _, _ in pairs]
    outside = [(number(df, c) < low) | (number(df, c) > high) for c, _, low, high in pairs]
    shown = df.select(F.explode(F.array_compact(F.array(*[F.when(o, v) for o, v in zip(outside, values, strict=True)]))).alias("x")).select("x.*")
    order = Window.partitionBy("column", "rule").orderBy("o", "v")  # a limit in each group: a few rows of it leave each task
    every = shown.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= examples)
    lists = every.groupBy("column", "rule").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "v"))), lambda x: x["v"]).alias("examples"))
    return last.join(lists, ["column", "rule"]).select("column", "rule", "low", "high", "count", "examples")


def check_domain(df: DataFrame, custom_rules: dict[str, tuple[float, float]] | None = None, row_id: str | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Warns if any column has values outside its range."""
    found = domain_violations(df, custom_rules, row_id, counted=counted)
    row = found.agg(F.count(F.lit(1)).alias("n"), _details(found, "column", "rule", "low", "high", "count", "examples").alias("details"))
    return _result(row, "domain", F.when(F.col("n") == 0, "pass").otherwise("warn"), F.format_string("%d columns with values outside their range", "n"), F.col("n"), None, F.col("details"))


def _date_parts(df: DataFrame, row_id: str | None = None) -> Parts:
    pairs = [(a, b) for a, b in DATE_PAIRS if a in df.columns and b in df.columns]
    how = formats(df, [c for pair in pairs for c in pair], row_id)
    parts = {}
    for a, b in pairs:
        first, second = moment(df, a, how.get(a, ISO)), moment(df, b, how.get(b, ISO))
        bad = (col(a).isNotNull() & first.isNull()) | (col(b).isNotNull() & second.isNull())
        parts[a] = {"count": F.count_if(first < second), "bad": F.count_if(bad)}
    return parts


def date_order_violations(df: DataFrame, counted: DataFrame | None = None, row_id: str | None = None) -> DataFrame:
    """(issue, column, count): rows in which the first date of a pair is before the second.

    Each text column is read by the format found for it (functions/dates.py).  A missing date never counts; a pair with a value that can't be parsed gives no row.
    """
    parts = _date_parts(df, row_id)
    if not parts:
        return df.sparkSession.createDataFrame([], "issue string, column string, count long")
    counts = long_form(df, parts) if counted is None else counted
    return counts.where("bad = 0 and count > 0").select(F.lit("date_order").alias("issue"), "column", "count")


def age_group_spread(df: DataFrame) -> DataFrame:
    """(age_group, spread) of groups whose ages are more than 30 apart; nothing unless age is a number."""
    if "age_group" not in df.columns or "age" not in numeric_columns(df):
        return df.sparkSession.createDataFrame([], "age_group string, spread double")
    age = number(df, "age")
    spread = df.where(~is_missing(df, "age_group")).groupBy(col("age_group").cast("string").alias("age_group")).agg((F.max(age) - F.min(age)).alias("spread"))
    return spread.where(F.col("spread") > WIDEST_AGE_GROUP)


def _negative_parts(df: DataFrame) -> Parts:
    return {f"{c}|{w}": {"count": F.count_if(number(df, c) < 0)} for w in POSITIVE_WORDS for c in number_like_columns(df) if w in c.lower()}


def negative_values(df: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """(issue, column, word, count) of columns that can't be negative and are; once for each word in the name."""
    parts = _negative_parts(df)
    if not parts:
        return df.sparkSession.createDataFrame([], "issue string, column string, word string, count long")
    rows = (long_form(df, parts) if counted is None else counted).where("count > 0")
    return rows.select(F.lit("negative").alias("issue"), F.regexp_extract("column", r"(?s)^(.*)\|[^|]*$", 1).alias("column"), F.element_at(F.split("column", r"\|"), -1).alias("word"), "count")


def consistency_issues(df: DataFrame, dates_counted: DataFrame | None = None, negatives_counted: DataFrame | None = None) -> DataFrame:
    """(issue, subject, value) of date order, age groups and negatives, in that order of kind."""
    dates = date_order_violations(df, dates_counted).select("issue", F.col("column").alias("subject"), F.col("count").cast("double").alias("value"))
    ages = age_group_spread(df).select(F.lit("age_group").alias("issue"), F.col("age_group").alias("subject"), F.col("spread").alias("value"))
    negatives = negative_values(df, negatives_counted).select("issue", F.concat_ws("|", "column", "word").alias("subject"), F.col("count").cast("double").alias("value"))
    return dates.unionByName(ages).unionByName(negatives)


def check_consistency(df: DataFrame, dates_counted: DataFrame | None = None, negatives_counted: DataFrame | None = None) -> DataFrame:
    issues = consistency_issues(df, dates_counted, negatives_counted)
    row = issues.agg(F.count(F.lit(1)).alias("n"), _details(issues, "issue", "subject", "value").alias("details"))
    return _result(row, "consistency", F.when(F.col("n") == 0, "pass").otherwise("warn"), F.format_string("%d issues", "n"), F.col("n"), None, F.col("details"))


def moments(df: DataFrame, name: str) -> dict[str, Column]:
    """n, mean, std (n - 1), adjusted skewness of the present values."""
    v = number(df, name)
    n = F.count(v)
    adjusted = F.when(n > 2, F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2))
    return {"n": n, "mean": F.avg(v), "std": F.stddev_samp(v), "skewness": F.when(F.stddev_pop(v) == 0, F.lit(0.0)).otherwise(adjusted)}


def _moment_parts(df: DataFrame, but: tuple[str, ...] = ()) -> Parts:
    return {c: moments(df, c) for c in numeric_columns(df) if c not in but}


def distribution_stats(df: DataFrame, but: tuple[str, ...] = (), digits: int = 3, counted: DataFrame | None = None) -> DataFrame:
    """(column, n, mean, std, skewness, cv) of numeric columns with ten values or more, rounded."""
    parts = _moment_parts(df, but)
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, n long, mean double, std double, skewness double, cv double")
    rows = (long_form(df, parts) if counted is None else counted).where(F.col("n") >= LEAST_VALUES)
    rows = rows.withColumn("cv", F.when(F.col("mean") == 0, F.lit(0.0)).otherwise(F.col("std") / F.col("mean")))
    return rows.select("column", "n", *[F.round(c, digits).alias(c) for c in ("mean", "std", "skewness", "cv")])


def distribution_warnings(df: DataFrame, drift_threshold: float = 0.3, but: tuple[str, ...] = (), counted: DataFrame | None = None) -> DataFrame:
    """(column, warning, value): |skewness| above 3; cv above five thresholds (a negative mean never warns)."""
    rows = distribution_stats(df, but, 12, counted)
    found = F.array_compact(
        F.array(
            F.when(F.abs("skewness") > SKEW_WARNS_ABOVE, F.struct(F.lit("skewness").alias("warning"), F.round("skewness", 3).alias("value"))),
            F.when(F.col("cv") > 5 * drift_threshold, F.struct(F.lit("cv").alias("warning"), F.round("cv", 3).alias("value"))),
        )
    )
    return rows.select("column", F.explode(found).alias("w")).select("column", "w.warning", "w.value")


def check_distribution(df: DataFrame, drift_threshold: float = 0.3, counted: DataFrame | None = None) -> DataFrame:
    found = distribution_warnings(df, drift_threshold, counted=counted)
    row = found.agg(F.count(F.lit(1)).alias("n"), _details(found, "column", "warning", "value").alias("details"))
    return _result(row, "distribution", F.when(F.col("n") == 0, "pass").otherwise("warn"), F.format_string("%d warnings", "n"), F.col("n"), drift_threshold, F.col("details"))


def verify(df: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """The five checks' results, one row each.

    One pass over df counts for four of them (wide tables take more); duplicates, age groups and examples of values
    outside their range, where there are any, read it again.
    """
    requests = [
        (_missing_parts(df), "column"), (_domain_parts(df, config.domain_rules), "pair"), (_date_parts(df, config.row_id), "column"), (_negative_parts(df), "column"), (_moment_parts(df), "column"),
    ]
    missing, domain, dates, negatives, moments_ = long_forms(df, requests) if df.columns else [None] * 5
    row_id = config.row_id if domain is not None and "count" in domain.columns and not domain.where("count > 0").isEmpty() else None
    checks = [
        check_missing(df, config.missing_threshold, missing), check_duplicates(df), check_domain(df, config.domain_rules, row_id, domain),
        check_consistency(df, dates, negatives), check_distribution(df, config.drift_threshold, moments_),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def gate(results: DataFrame) -> DataFrame:
    """(passed, failed, warned, gate_passed, overall) of verify()'s rows; the gate passes unless a check fails."""
    row = results.agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("pass", "passed"), ("fail", "failed"), ("warn", "warned"))])
    overall = F.when(F.col("failed") > 0, "fail").when(F.col("warned") > 0, "warn").otherwise("pass")
    return row.withColumns({"gate_passed": F.col("failed") == 0, "overall": overall})
