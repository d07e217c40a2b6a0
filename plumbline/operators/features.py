"""Feature preparation: date parts, imputation, outliers, encoding, scaling; fitted on one table, applied to others.

Steps are fitted in order, each on the output of the one before; a fit is one or two aggregates, an application is a
projection (label codes come by a join).  Fitted parameters are a small table of rows (step, column, key, value).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.dates import ISO, formats, formats_of, moment
from plumbline.functions.quantiles import at_ranks, imputed_quartiles, quantiles, rank_tables, ranks_of_imputed_quartiles
from plumbline.functions.shared import dense_positions, written
from plumbline.functions.values import col, is_missing, kinds, long_form, number, numeric_columns, quoted, string_columns

# Words in the names of date columns.
DATE_WORDS = ["date", "birth", "admission", "discharge", "created"]
UNKNOWN = "UNKNOWN"
#: A dictionary of labels up to this size is kept in the parameters and applied as a literal map; a larger one is joined.
INLINE_LABELS = 1000
#: A value of a large dictionary is frequent if more than one row in HEAVY_SHARE has it.
HEAVY_SHARE = 1000


@dataclass
class Params:
    """What the steps learned.  labels holds dictionaries of up to INLINE_LABELS values, label_tables the larger ones."""

    dates: dict[str, bool] = field(default_factory=dict)  # column: whether any value has a time of day
    formats: dict[str, str] = field(default_factory=dict)  # text date column: the format of its values
    medians: dict[str, float | None] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    one_hot: dict[str, list[str]] = field(default_factory=dict)
    labels: dict[str, list[str]] = field(default_factory=dict)
    label_tables: dict[str, DataFrame] = field(default_factory=dict)
    heavy_labels: dict[str, dict[str, int]] = field(default_factory=dict)  # the codes of a large dictionary's frequent values
    scales: dict[str, tuple[float, float]] = field(default_factory=dict)  # column: (subtract, divide by)
    skip: tuple[str, ...] = ()


def _first(df: DataFrame, exprs: list[Column]) -> dict:
    return df.agg(*exprs).first().asDict() if exprs else {}


# --- dates ---------------------------------------------------------------------------------------------------------


def date_columns(df: DataFrame, skip: tuple[str, ...] = ()) -> list[str]:
    """Columns with a date word in their name that aren't numbers or booleans."""
    plain = T.NumericType | T.BooleanType
    return [c for c, t in kinds(df).items() if c not in skip and not isinstance(t, plain) and any(w in c.lower() for w in DATE_WORDS)]


def _moment(df: DataFrame, name: str, params: Params) -> Column:
    return moment(df, name, params.formats.get(name, ISO))


def fit_dates(df: DataFrame, params: Params, row_id: str | None = None) -> None:
    """Each text date column's format (the first value's, in the order of row_id, else the one that fits most), and whether
    any value has a time of day."""
    names = date_columns(df, params.skip)
    params.formats = formats(df, names, row_id)
    timed = [F.coalesce(F.bool_or(_moment(df, c, params) != F.date_trunc("day", _moment(df, c, params))), F.lit(False)).alias(f"d{i}") for i, c in enumerate(names)]
    row = _first(df, timed)
    params.dates = {c: row[f"d{i}"] for i, c in enumerate(names)}


def _date_text(at: Column, timed: bool) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss" if timed else "yyyy-MM-dd")


def date_features(df: DataFrame, params: Params) -> DataFrame:
    """Adds year, month and day of week (Monday 0) of each date column, which becomes text; what doesn't fit its column's
    format is missing."""
    made: dict[str, Column] = {}
    for c, timed in params.dates.items():
        if c in df.columns:
            at = _moment(df, c, params)
            made |= {f"{c}_year": F.year(at), f"{c}_month": F.month(at), f"{c}_dayofweek": F.weekday(at)}
            made[c] = _date_text(at, timed)
    return df.withColumns(made) if made else df


# --- missing values ------------------------------------------------------------------------------------------------


def modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The most frequent present value of each column, ties to the smallest; UNKNOWN where there is none.

    Values are counted by a shuffle on (column, value), so no task holds a column's dictionary.
    """
    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(i).alias("i"), col(c).alias("v")) for i, c in enumerate(columns)])
    counts = df.select(F.explode(cells).alias("x")).where("x.v is not null").groupBy("x.i", "x.v").count()
    best = counts.groupBy("i").agg(F.min_by("v", F.struct((-F.col("count")).alias("n"), "v")).alias("v")).collect()
    return {c: UNKNOWN for c in columns} | {columns[r["i"]]: r["v"] for r in best}


def fit_imputer(df: DataFrame, params: Params, exact: bool = True) -> None:
    names = numeric_columns(df, params.skip)
    found = quantiles(df, {c: number(df, c) for c in names}, [0.5], exact)
    params.medians = {c: q and q[0] for c, q in found.items()}
    params.modes = modes(df, string_columns(df, params.skip))


def impute(df: DataFrame, params: Params) -> DataFrame:
    """Missing numbers become the median (a column without any stays missing), missing strings the mode."""
    made: dict[str, Column] = {}
    for c, m in params.medians.items():
        if c in df.columns and m is not None:
            made[c] = F.when(is_missing(df, c), F.lit(float(m))).otherwise(col(c).cast("double"))
    made |= {c: F.coalesce(col(c), F.lit(m)) for c, m in params.modes.items() if c in df.columns}
    return df.withColumns(made) if made else df


# --- outliers ------------------------------------------------------------------------------------------------------


def fit_bounds(df: DataFrame, params: Params, factor: float = 1.5, exact: bool = True) -> None:
    """q1 - factor * iqr and q3 + factor * iqr of each numeric column's present values, quartiles interpolated."""
    names = numeric_columns(df, params.skip)
    found = quantiles(df, {c: number(df, c) for c in names}, [0.25, 0.75], exact)
    params.bounds = {c: (q[0] - factor * (q[1] - q[0]), q[1] + factor * (q[1] - q[0])) for c, q in found.items() if q}


def clip_outliers(df: DataFrame, params: Params) -> DataFrame:
    """Values outside their bounds become the bound; missing values stay."""
    made = {}
    for c, (low, high) in params.bounds.items():
        if c in df.columns:
            v = number(df, c)
            made[c] = F.when(v < low, F.lit(low)).when(v > high, F.lit(high)).otherwise(v)
    return df.withColumns(made) if made else df


def replace_outliers_median(df: DataFrame, params: Params, exact: bool = True) -> DataFrame:
    """Values outside their bounds, and missing ones, become the median of the table at hand."""
    found = quantiles(df, {c: number(df, c) for c in params.bounds if c in df.columns}, [0.5], exact)
    made = {}
    for c, median in found.items():
        low, high = params.bounds[c]
        made[c] = F.when(number(df, c).between(low, high), number(df, c)).otherwise(F.lit(median and median[0]).cast("double"))
    return df.withColumns(made) if made else df


def outlier_counts(df: DataFrame, params: Params) -> DataFrame:
    """(column, low, high, outliers, values) by the fitted bounds."""
    parts = {
        c: {"low": F.max(F.lit(low)), "high": F.max(F.lit(high)), "outliers": F.count_if((number(df, c) < low) | (number(df, c) > high)), "values": F.count(number(df, c))}
        for c, (low, high) in params.bounds.items()
        if c in df.columns
    }
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, low double, high double, outliers long, values long")
    return long_form(df, parts)


# --- categories ----------------------------------------------------------------------------------------------------


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, v): each column's distinct present values, by one shuffle for all columns."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), col(c).alias("v")) for i, c in enumerate(columns)])
    return df.select(F.explode(cells).alias("x")).where("x.v is not null").select("x.i", "x.v").distinct()


def cardinality_split(df: DataFrame, max_one_hot: int = 5, skip: tuple[str, ...] = ()) -> DataFrame:
    """(column, distinct, encoding): one_hot up to max_one_hot distinct values, else label."""
    names = string_columns(df, skip)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, distinct long, encoding string")
    counts = distinct_values(df, names).groupBy("i").agg(F.count(F.lit(1)).alias("distinct"))
    name = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("i") + 1)
    return counts.select(name.alias("column"), "distinct", F.when(F.col("distinct") <= max_one_hot, "one_hot").otherwise("label").alias("encoding"))


def label_table(df: DataFrame, column: str) -> DataFrame:
    """(value, code): codes from 0 in the order of the values, by ranges of values, so that no task sorts them all."""
    values = df.select(col(column).alias("value")).where("value is not null").distinct()
    return dense_positions(values, "value", "code")


def heavy_labels(df: DataFrame, column: str, table: DataFrame) -> dict[str, int]:
    """The codes of the values that more than one row in HEAVY_SHARE has."""
    counts = df.select(col(column).alias("value")).where("value is not null").groupBy("value").count()
    frequent = counts.where(F.col("count") > df.count() // HEAVY_SHARE)
    return {r["value"]: r["code"] for r in table.join(frequent, "value").collect()}


def _joined_codes(out: DataFrame, column: str, table: DataFrame, heavy: dict[str, int]) -> DataFrame:
    """out with a dictionary's codes for the column's values.  Frequent values are coded by a literal map and, like missing
    ones, dealt evenly over the join's tasks, whose other keys are so many that none has more than a small share."""
    value = col(column)
    known = F.create_map(*[F.lit(x) for v, i in heavy.items() for x in (v, i)])[value] if heavy else F.lit(None).cast("int")
    apart = value.isNull() | known.isNotNull()
    keyed = out.withColumns({"_known": known, "_key": F.when(~apart, value), "_deal": F.when(apart, F.pmod(F.monotonically_increasing_id(), F.lit(4096)) + 1).otherwise(0)})
    none = F.pmod("code", F.lit(1)).cast("long")  # always 0; a literal would be taken out of the join's keys
    codes = table.select(F.col("value").alias("_key"), F.col("code").alias("_code"), none.alias("_deal"))
    met = keyed.join(codes, ["_key", "_deal"], "left").withColumn(column, F.coalesce("_known", "_code", F.lit(-1)).cast("long"))
    return met.select(*[quoted(c) for c in out.columns])


def fit_encoder(df: DataFrame, params: Params, max_one_hot: int = 5) -> None:
    names = string_columns(df, params.skip)
    params.one_hot, params.labels, params.label_tables, params.heavy_labels = {}, {}, {}, {}
    if not names:
        return
    values = distinct_values(df, names)
    counts = {r["i"]: r["count"] for r in values.groupBy("i").count().collect()}
    small = [i for i in range(len(names)) if counts.get(i, 0) <= INLINE_LABELS]
    lists = {r["i"]: sorted(r["vs"]) for r in values.where(F.col("i").isin(small)).groupBy("i").agg(F.collect_list("v").alias("vs")).collect()}
    for i, c in enumerate(names):
        if counts.get(i, 0) <= max_one_hot:
            params.one_hot[c] = lists.get(i, [])
        elif i in lists:
            params.labels[c] = lists[i]
        else:
            params.label_tables[c] = label_table(df, c)
            params.heavy_labels[c] = heavy_labels(df, c, params.label_tables[c])


def encode(df: DataFrame, params: Params) -> DataFrame:
    """One-hot columns (all but the first category, as 0.0 and 1.0) replace their source at the end; label columns become
    codes, -1 for values that the fit didn't see."""
    made: dict[str, Column] = {}
    for c, values in params.labels.items():
        if c in df.columns:
            codes = F.create_map(*[F.lit(x) for i, v in enumerate(values) for x in (v, i)])
            made[c] = F.coalesce(codes[col(c)], F.lit(-1)).cast("long")
    out = df.withColumns(made) if made else df
    for c, table in params.label_tables.items():
        if c in df.columns:
            out = _joined_codes(out, c, table, params.heavy_labels.get(c, {}))
    dummies = {f"{c}_{v}": F.coalesce(col(c) == v, F.lit(False)).cast("double") for c, vs in params.one_hot.items() if c in df.columns for v in vs[1:]}
    keep = [c for c in out.columns if c not in params.one_hot]
    return out.select(*[quoted(c) for c in keep], *[v.alias(n) for n, v in dummies.items()])


# --- scales --------------------------------------------------------------------------------------------------------


def fit_scaler(df: DataFrame, params: Params, method: str = "standard") -> None:
    """What to subtract and divide by; a column of one value is divided by 1 (its deviation may be rounding, so its ends say so)."""
    names = numeric_columns(df, params.skip)
    parts = {"a": F.avg, "b": F.stddev_pop, "lo": F.min, "hi": F.max} if method == "standard" else {"lo": F.min, "hi": F.max}
    row = _first(df, [f(number(df, c)).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in parts.items()])
    params.scales = {}
    for i, c in enumerate(names):
        low, high = row[f"lo{i}"], row[f"hi{i}"]
        if low is not None:
            plain = method != "standard" or low == high
            params.scales[c] = _scale_of(low if plain else row[f"a{i}"], 0.0 if plain else row[f"b{i}"], low, high, method)


def scale(df: DataFrame, params: Params) -> DataFrame:
    made = {c: (number(df, c) - F.lit(a)) / F.lit(b) for c, (a, b) in params.scales.items() if c in df.columns}
    return df.withColumns(made) if made else df


# --- all steps -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class FeatureConfig:
    outlier_factor: float = 1.5
    scaler: str = "standard"
    max_one_hot: int = 5
    exact: bool = True
    skip: tuple[str, ...] = ()  # columns that no step looks at, row ids among them
    row_id: str | None = None  # the order that decides which of a date column's values is the first


def _text_values(df: DataFrame, names: list[str], row_id: str | None) -> DataFrame:
    """(i, v, at, n, first): the distinct present values of the text and date columns, by one scan and one shuffle, written,
    as several steps read them: v of a text column, at of another."""
    nothing, cells = F.lit(None), []
    for i, c in enumerate(names):
        v, at = (col(c), nothing) if isinstance(kinds(df)[c], T.StringType) else (nothing, moment(df, c))
        cells.append(F.struct(F.lit(i).alias("i"), v.cast("string").alias("v"), at.cast("timestamp").alias("at")))
    order = col(row_id) if row_id else F.lit(None).cast("long")
    each = df.select(F.explode(F.array(*cells)).alias("x"), order.alias("o")).where("x.v is not null or x.at is not null")
    return written(each.groupBy("x.i", "x.v", "x.at").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("first")), "text-values")


def _as_shown(values: DataFrame, names: list[str], df: DataFrame, params: Params, row_id: str | None) -> DataFrame:
    """(i, v, n) of the values as date_features() shows them; fits the date columns on the way."""
    places = [i for i, c in enumerate(names) if c in date_columns(df, params.skip)]
    if not places:
        return values.select("i", "v", "n")
    texts = [i for i in places if isinstance(kinds(df)[names[i]], T.StringType)]
    found = formats_of(values.where(F.col("i").isin(texts)), "i", "v", "n", "first" if row_id else None) if texts else {}
    params.formats = {names[i]: found.get(i, ISO) for i in texts}
    at = F.col("at")
    for how in set(params.formats.values()):
        mine = [i for i in texts if params.formats[names[i]] == how]
        text = F.trim("v")
        at = F.when(F.col("i").isin(mine), F.try_to_timestamp(text) if how == ISO else F.try_to_timestamp(text, F.lit(how))).otherwise(at)
    dated = values.where(F.col("i").isin(places)).withColumn("at", at)
    timed = {r["i"]: r["timed"] for r in dated.groupBy("i").agg(F.coalesce(F.bool_or(F.col("at") != F.date_trunc("day", "at")), F.lit(False)).alias("timed")).collect()}
    params.dates = {names[i]: timed.get(i, False) for i in places}
    shown = F.when(F.col("i").isin([i for i in places if params.dates[names[i]]]), _date_text(F.col("at"), True)).otherwise(_date_text(F.col("at"), False))
    merged = dated.select("i", shown.alias("v"), "n").where("v is not null").groupBy("i", "v").agg(F.sum("n").alias("n"))
    return written(values.where(~F.col("i").isin(places)).select("i", "v", "n").unionByName(merged), "shown-values")


def _fit_texts(values: DataFrame, names: list[str], rows: int, params: Params, max_one_hot: int, method: str) -> None:
    """Modes, categories, label dictionaries and the scales of their codes, from counted values alone."""
    summed = values.groupBy("i").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("n"), F.min_by("v", F.struct((-F.col("n")).alias("n"), "v")).alias("mode"))
    found = {r["i"]: r for r in summed.collect()}
    small = [i for i in found if found[i]["distinct"] <= INLINE_LABELS]
    counts: dict[int, dict[str, int]] = {i: {} for i in range(len(names))}
    for r in values.where(F.col("i").isin(small)).collect():  # INLINE_LABELS rows a column at the most
        counts[r["i"]][r["v"]] = r["n"]
    for i, c in enumerate(names):
        params.modes[c] = found[i]["mode"] if i in found else UNKNOWN
        missing = rows - (found[i]["n"] if i in found else 0)
        if i in found and i not in small:
            table = written(dense_positions(values.where(F.col("i") == i).select(F.col("v").alias("value"), "n"), "value", "code"), "labels")
            weight = F.col("n") + F.when(F.col("value") == params.modes[c], missing).otherwise(0)
            params.label_tables[c] = table.select("value", "code")
            params.heavy_labels[c] = {r["value"]: r["code"] for r in table.where(weight > rows // HEAVY_SHARE).collect()}  # HEAVY_SHARE rows at the most
            code, n = F.col("code").cast("double"), weight.cast("double")
            row = table.agg((F.sum(code * n) / F.sum(n)).alias("a"), F.min("code").alias("lo"), F.max("code").alias("hi")).first()
            spread = table.agg(F.sqrt(F.sum((code - row["a"]) * (code - row["a"]) * n) / F.sum(n)).alias("s")).first()["s"]
            params.scales[c] = _scale_of(row["a"], spread, row["lo"], row["hi"], method)
            continue
        if rows and missing:
            counts[i][params.modes[c]] = counts[i].get(params.modes[c], 0) + missing
        values_in_order = sorted(counts[i])
        weights = [counts[i][v] for v in values_in_order]
        if len(values_in_order) <= max_one_hot:
            params.one_hot[c] = values_in_order
            for v, n in list(zip(values_in_order, weights, strict=True))[1:]:
                share = n / rows
                params.scales[f"{c}_{v}"] = _scale_of(share, (share * (1 - share)) ** 0.5, int(share == 1), int(n > 0), method)
        else:
            params.labels[c] = values_in_order
            mean = sum(k * n for k, n in enumerate(weights)) / rows
            spread = (sum((k - mean) ** 2 * n for k, n in enumerate(weights)) / rows) ** 0.5
            params.scales[c] = _scale_of(mean, spread, 0, len(weights) - 1, method)


def _scale_of(mean: float, spread: float, low: float, high: float, method: str) -> tuple[float, float]:
    return (float(mean), float(spread) or 1.0) if method == "standard" else (float(low), float(high - low) or 1.0)


def fit(df: DataFrame, config: FeatureConfig = FeatureConfig()) -> Params:
    """Dates, imputer, outliers, encoder, scaler, each on what the steps before it give, by four scans of df:

    1. the distinct values of text and date columns, from which date formats, modes, categories, labels and the scales of
       their codes follow (one_hot shares and label codes are sums over counted values);
    2. a rank table of each number;
    3. the values at the ranks that medians, and quartiles with missing values at the median, need;
    4. scales of the clipped numbers.
    With exact=False the third is left out.  Very long columns take further scans in the third (functions/quantiles.py).
    """
    params = Params(skip=config.skip)
    dates, texts = date_columns(df, params.skip), string_columns(df, params.skip)
    names = [c for c in df.columns if c in texts or c in dates]
    shown = _as_shown(_text_values(df, names, config.row_id), names, df, params, config.row_id) if names else None
    dated = date_features(df, params)
    numbers = {c: number(dated, c) for c in numeric_columns(dated, params.skip)}
    tables = rank_tables(dated, numbers)
    rows = next(iter(tables.values())).rows if tables else df.count()
    filled = {c: t for c, t in tables.items() if t.count}
    params.medians = {c: None for c in tables}
    if config.exact:
        found = at_ranks(dated, numbers, filled, {r for c, t in filled.items() for r in ranks_of_imputed_quartiles(c, t)})
        quartiles = {c: imputed_quartiles(found, c, t) for c, t in filled.items()}
    else:
        quartiles = {c: t.approximate_imputed_quartiles() for c, t in filled.items()}
    for c, (median, q1, q3) in quartiles.items():
        params.medians[c] = median
        params.bounds[c] = (q1 - config.outlier_factor * (q3 - q1), q3 + config.outlier_factor * (q3 - q1))
    fit_scaler(clip_outliers(impute(dated.select(*[quoted(c) for c in numbers]), params), params), params, config.scaler)
    if names:
        _fit_texts(shown, names, rows, params, config.max_one_hot, config.scaler)
    return params


def transform(df: DataFrame, params: Params) -> DataFrame:
    """The fitted steps on any table with these columns: projections, and a join for large label dictionaries."""
    for step in (date_features, impute, clip_outliers, encode, scale):
        df = step(df, params)
    return df


def fit_transform(df: DataFrame, config: FeatureConfig = FeatureConfig()) -> tuple[DataFrame, Params]:
    params = fit(df, config)
    return transform(df, params), params


def feature_names(params: Params) -> list[str]:
    """Names of one-hot columns, then of label columns."""
    return [f"{c}_{v}" for c, vs in params.one_hot.items() for v in vs[1:]] + [*params.labels, *params.label_tables]


_SMALL = ("dates", "formats", "heavy_labels", "medians", "modes", "bounds", "one_hot", "labels", "scales")


def params_table(spark: SparkSession, params: Params) -> DataFrame:
    """(step, column, value as JSON); large dictionaries of labels are rows (label_table, column, [value, code])."""
    rows = [(s, c, json.dumps(v)) for s in _SMALL for c, v in getattr(params, s).items()] + [("skip", c, "true") for c in params.skip]
    out = spark.createDataFrame(rows, "step string, column string, value string") if rows else spark.createDataFrame([], "step string, column string, value string")
    for c, table in params.label_tables.items():
        pair = F.to_json(F.struct("value", "code"))
        out = out.unionByName(table.select(F.lit("label_table").alias("step"), F.lit(c).alias("column"), pair.alias("value")))
    return out


def save_params(spark: SparkSession, params: Params, path: str) -> None:
    params_table(spark, params).write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str) -> Params:
    table = spark.read.parquet(path)
    params = Params()
    skip = []
    for r in table.where("step <> 'label_table'").collect():
        value = json.loads(r["value"])
        if r["step"] == "skip":
            skip.append(r["column"])
        else:
            getattr(params, r["step"])[r["column"]] = tuple(value) if r["step"] in ("bounds", "scales") else value
    params.skip = tuple(skip)
    large = table.where("step = 'label_table'")
    for r in large.select("column").distinct().collect():
        pair = F.from_json("value", "value string, code long").alias("p")
        params.label_tables[r["column"]] = large.where(F.col("column") == r["column"]).select(pair).select("p.*")
    return params
