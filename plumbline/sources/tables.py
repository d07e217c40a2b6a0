"""Reading and writing delimited tables and reports; classifying source names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.values import NA_TOKENS, col
from plumbline.sources.delimited import find_separator

#: A dataset page's address gives owner and dataset.
_DATASET = r"kaggle\.com/datasets/([^/]+)/([^/?#\s]+)"


def infer_types(texts: DataFrame) -> DataFrame:
    """Columns of strings as long, double, boolean or string, by one pass: NA tokens are missing, `?` isn't one; whole
    numbers with missing values become double."""
    clean = texts.withColumns({c: F.when(~F.trim(col(c)).isin(NA_TOKENS), col(c)) for c in texts.columns}) if texts.columns else texts
    tests = []
    for i, c in enumerate(clean.columns):
        v = F.trim(col(c))
        tests += [
            F.count_if(v.isNotNull() & (v.try_cast("bigint").isNull() | ~v.rlike(r"^[+-]?\d+$"))).alias(f"i{i}"), F.count_if(v.isNotNull() & (v.try_cast("double").isNull() | v.rlike("[dDfF]$"))).alias(f"d{i}"),
            F.count_if(v.isNotNull() & ~F.lower(v).isin("true", "false")).alias(f"b{i}"), F.count_if(v.isNull()).alias(f"n{i}"), F.count(v).alias(f"c{i}"),
        ]
    found = clean.agg(*tests).first() if tests else None
    made = {}
    for i, c in enumerate(clean.columns):
        if not found[f"c{i}"] or not found[f"d{i}"]:
            whole = found[f"c{i}"] and not found[f"i{i}"] and not found[f"n{i}"]
            made[c] = F.trim(col(c)).cast("bigint" if whole else "double")
        elif not found[f"b{i}"]:
            made[c] = (F.lower(F.trim(col(c))) == "true") if not found[f"n{i}"] else col(c)
    return clean.withColumns(made) if made else clean


def _has_quoted_breaks(spark: SparkSession, path: str) -> bool:
    """Whether a record may go on over a line's end: some line has an odd number of quotes.  Files without such a line are
    split among tasks wherever a line ends."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).limit(1).isEmpty()


def _read_csv(spark: SparkSession, path: str, header: bool, separator: str) -> DataFrame:
    options = spark.read.option("header", header).option("sep", separator).option("escape", '"')
    return infer_types(options.option("multiLine", _has_quoted_breaks(spark, path)).csv(path))


def read_table_csv(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated, header row, types inferred; a path that can't be read is an error."""
    return _read_csv(spark, path, True, ",")


def read_delimited(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """A .csv, .data or .txt file with a separator found from its first line, which is the header unless told otherwise.
    Line breaks in quotes stay in their field."""
    if not path.lower().endswith((".csv", ".data", ".txt")):
        raise ValueError("a .csv, .data or .txt file is needed")
    first = spark.read.text(path).limit(1).collect()
    if not first:
        return spark.createDataFrame([], T.StructType([]))
    return _read_csv(spark, path, header, find_separator(first[0][0]))


def source_url(source: Column) -> Column:
    """The source trimmed, `https://` put before it unless it is a local .csv file or has a scheme of the web."""
    s = F.trim(source)
    local = F.lower(s).endswith(".csv") & ~s.rlike("^https?://")
    return F.when(local | s.rlike("^https?://"), s).otherwise(F.concat(F.lit("https://"), s))


def source_kind(source: Column) -> Column:
    """local_csv, kaggle, invalid, raw_file or html, the first that holds."""
    url = source_url(source)
    web = url.rlike("^https?://")
    return (
        F.when(~web, "local_csv")
        .when(F.lower(url).contains("kaggle.com/datasets"), "kaggle")
        .when(~url.rlike(r"^https?://[^/?#\s]+"), "invalid")
        .when(F.lower(url).rlike(r"\.(csv|data|txt)$"), "raw_file")
        .otherwise("html")
    )


def classify_sources(df: DataFrame, column: str = "url") -> DataFrame:
    """df with source (the address to read) and kind."""
    return df.withColumns({"source": source_url(col(column)), "kind": source_kind(col(column))})


def dataset_handle(url: Column) -> Column:
    """`owner/dataset` of a dataset page's address, else null."""
    owner, name = F.regexp_extract(url, _DATASET, 1), F.regexp_extract(url, _DATASET, 2)
    return F.when((owner != "") & (name != ""), F.concat_ws("/", owner, name))


def read_first_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The .csv file with the smallest path below a folder; none is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder)
    first = files.agg(F.min("path")).first()[0]
    if first is None:
        raise FileNotFoundError(f"no .csv file below {folder}")
    return read_table_csv(spark, first)


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """CSV with a header; missing values are empty fields."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("escape", '"').csv(path)


def write_csv_quoted(df: DataFrame, path: str) -> None:
    write_csv(df, path, quote_all=True)


def write_report_json(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_report_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return spark.read.json(path, schema=schema) if schema is not None else spark.read.json(path)
