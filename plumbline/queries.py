"""Registered queries over the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.shared import fresh_path
from plumbline.operators import features, identifiers, kanon, profile, quality, roles
from plumbline.plans.jobs import JobConfig, reproduce, run_pipeline
from plumbline.sources import pages, tables, versions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: One row an order, with missing values, identifiers and quasi-identifiers.  The same text in Spark and in the SQL.
PATIENTS = """
SELECT o.o_orderkey AS row_id, o.o_custkey AS patient_id, c.c_name AS name, CAST(18 + (o.o_custkey * 37) % 73 AS INT) AS age,
       CASE WHEN o.o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
       CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE n.n_name END AS zip_code, c.c_mktsegment AS diagnosis,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE c.c_acctbal END AS glucose,
       CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE o.o_totalprice END AS charges,
       CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE o.o_orderpriority END AS priority, o.o_orderdate AS diagnosis_date
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
"""
P = f"WITH patients AS ({PATIENTS.format(orders='orders', customer='customer', nation='nation')})"
QUASI = ["age", "gender", "zip_code"]
KEY, K, SEED = "test-key", 30, 7


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PATIENTS, **{t: read(spark, sf_dir, t) for t in ("orders", "customer", "nation")})


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = re.sub(r"(?<![\w\"'])(column|distinct)(?![\w\"'])", r'"\1"', sql)  # reserved words
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


# --- anonymizing ---------------------------------------------------------------------------------------------------

_PAD = KEY.encode().ljust(64, b"\0")
_INNER, _OUTER = bytes(b ^ 0x36 for b in _PAD).hex(), bytes(b ^ 0x5C for b in _PAD).hex()


def _hmac(x: str) -> str:
    return f"substr(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode({x}::VARCHAR)))), 1, 16)"


def _binned(column: str, table: str = "patients") -> str:
    """CTEs `edges` and `binned`: the table with its column in five bins, for edges that differ as whole numbers."""
    labels = [f"'(' || round_even(e{i}, 0)::VARCHAR || ', ' || round_even(e{i + 1}, 0)::VARCHAR || ']'" for i in range(5)]
    cases = " ".join(f"WHEN {column} <= e{i + 1} THEN {labels[i]}" for i in range(4))
    return f"""
    , span AS (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi FROM {table}),
    edges AS (SELECT lo - (hi - lo) * 0.001 AS e0, lo + 1 * ((hi - lo) / 5) AS e1, lo + 2 * ((hi - lo) / 5) AS e2,
              lo + 3 * ((hi - lo) / 5) AS e3, lo + 4 * ((hi - lo) / 5) AS e4, hi AS e5 FROM span),
    binned AS (SELECT t.* REPLACE (CASE WHEN {column} IS NULL THEN 'nan' {cases} ELSE {labels[4]} END AS {column}) FROM {table} t, edges)"""


def _kept(k: int) -> str:
    return f""", large AS (SELECT age, gender, zip_code FROM binned GROUP BY ALL HAVING count(*) >= {k}),
    kept AS (SELECT b.* FROM binned b SEMI JOIN large l ON b.age = l.age AND b.gender = l.gender AND b.zip_code = l.zip_code)"""


def _sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = patients(spark, sf_dir)
    return df, kanon.generalize_numeric(df, QUASI)


@query(f"{P}{_binned('age')}{_kept(3)} SELECT row_id, {_hmac('patient_id')} AS patient_id, {_hmac('name')} AS name, age, gender, zip_code, diagnosis FROM kept")
def publishable(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = kanon.anonymize(patients(spark, sf_dir), kanon.AnonymizeConfig(k=3, strategy="hash", key=KEY))
    return kept.select("row_id", "patient_id", "name", "age", "gender", "zip_code", "diagnosis")


@query(f"""{P} SELECT column, kind, position::INT AS position, values FROM (
  SELECT 'patient_id' AS column, 'direct' AS kind, 1 AS position, count(patient_id) AS values FROM patients
  UNION ALL SELECT 'name', 'direct', 2, count(name) FROM patients UNION ALL SELECT 'age', 'quasi', 3, count(age) FROM patients
  UNION ALL SELECT 'gender', 'quasi', 4, count(gender) FROM patients UNION ALL SELECT 'zip_code', 'quasi', 5, count(zip_code) FROM patients)""")
def detect_phi_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.detect_phi_columns(patients(spark, sf_dir))


@query(f"""{P} SELECT column, position::INT AS position, values FROM (SELECT 'row_id' AS column, 0 AS position, count(row_id) AS values FROM patients
  UNION ALL SELECT 'patient_id', 1, count(patient_id) FROM patients UNION ALL SELECT 'name', 2, count(name) FROM patients)""")
def phi_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.candidates_table(patients(spark, sf_dir))


@query("""SELECT column, position::INT AS position, type, family, values, rows FROM (
  SELECT 'c_custkey' AS column, 0 AS position, 'bigint' AS type, 'number' AS family, count(c_custkey) AS values, count(*) AS rows FROM customer
  UNION ALL SELECT 'c_name', 1, 'string', 'text', count(c_name), count(*) FROM customer UNION ALL SELECT 'c_nationkey', 2, 'int', 'number', count(c_nationkey), count(*) FROM customer
  UNION ALL SELECT 'c_acctbal', 3, 'double', 'number', count(c_acctbal), count(*) FROM customer UNION ALL SELECT 'c_mktsegment', 4, 'string', 'text', count(c_mktsegment), count(*) FROM customer)""")
def column_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.column_overview(read(spark, sf_dir, "customer"))


@query(f"{P} SELECT row_id, age, gender, zip_code, diagnosis, glucose, charges, priority FROM patients")
def drop_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers.drop_identifiers(patients(spark, sf_dir), ["patient_id", "name", "email", "diagnosis_date"])


@query(f"{P} SELECT row_id, {_hmac('patient_id')} AS patient_id, {_hmac('name')} AS name, {_hmac("coalesce(zip_code, 'nan')")} AS zip_code FROM patients")
def hash_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers.hash_identifiers(patients(spark, sf_dir).select("row_id", "patient_id", "name", "zip_code"), ["patient_id", "name", "zip_code"], KEY)


def _drawn(column: str, draw: int, below: int) -> str:
    return f"('0x' || substr(sha256('{SEED}|{column}|{draw}|' || row_id::VARCHAR), 1, 8))::BIGINT % {below}"


def _listed(values: list[str], at: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({at}) + 1]"


_PERSON = f"{_listed(identifiers.FIRST_NAMES, _drawn('name', 0, 16))} || ' ' || {_listed(identifiers.LAST_NAMES, _drawn('name', 1, 16))}"
_REPLACED = f"SELECT row_id, format('ANON_{{:06d}}', row_number() OVER (ORDER BY row_id) - 1) AS patient_id, {_PERSON} AS name FROM patients"


@query(f"{P} {_REPLACED}")
def replace_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers.replace_identifiers(patients(spark, sf_dir).select("row_id", "patient_id", "name"), ["patient_id", "name"], "row_id", SEED)


@query(f"{P}, r AS ({_REPLACED}) SELECT p.name AS original, arg_max(r.name, r.row_id) AS replacement FROM patients p JOIN r USING (row_id) GROUP BY p.name")
def replacement_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = patients(spark, sf_dir)
    return identifiers.replacement_map(df, identifiers.replace_identifiers(df, ["name"], "row_id", SEED), "name", "row_id")


@query(f"{P} SELECT row_id, patient_id, name, age FROM patients ORDER BY row_id LIMIT 20")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers.preview(patients(spark, sf_dir), "row_id", 20, ["row_id", "patient_id", "name", "age"])


@query(f"{P}{_binned('age')} SELECT row_id, age, gender, zip_code FROM binned")
def generalize_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir)[1].select("row_id", "age", "gender", "zip_code")


@query(f"{P}{_binned('age')}{_kept(K)} SELECT row_id, age, gender, zip_code FROM kept")
def k_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kanon.k_suppress(_sets(spark, sf_dir)[1], QUASI, K).select("row_id", "age", "gender", "zip_code")


@query(f"""{P}{_binned('age')}{_kept(K)} SELECT a.n AS rows_before, b.n AS rows_after, a.n - b.n AS suppressed, round((a.n - b.n) * 100.0 / a.n, 6)::DOUBLE AS suppressed_pct
  FROM (SELECT count(*) AS n FROM patients) a, (SELECT count(*) AS n FROM kept) b""")
def k_suppressed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kanon.k_suppressed_stats(_sets(spark, sf_dir)[1], QUASI, K))


@query(f"""{P}{_binned('age')}, g AS (SELECT count(*) AS n FROM binned WHERE zip_code IS NOT NULL GROUP BY age, gender, zip_code)
  SELECT count(*) FILTER (n < {K}) AS violating_groups, count(*) FILTER (n < {K}) = 0 AS satisfied FROM g""")
def k_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kanon.k_verify(_sets(spark, sf_dir)[1], QUASI, K)


@query(f"""{P}{_binned('age')}{_kept(K)} SELECT a.n AS rows_raw, b.n AS rows_kept, a.n - b.n AS delta, round(b.n * 100.0 / a.n, 6)::DOUBLE AS retention_pct, 'name,patient_id' AS columns_removed
  FROM (SELECT count(*) AS n FROM patients) a, (SELECT count(*) AS n FROM kept) b""")
def retention_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = patients(spark, sf_dir)
    return rounded(kanon.retention_report(df, kanon.anonymize(df, kanon.AnonymizeConfig(k=K, strategy="drop"))))


@query(f"{P}{_binned('age')}{_kept(K)} SELECT row_id, age, gender, zip_code, diagnosis, glucose, charges, priority FROM kept")
def anonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kanon.anonymize(patients(spark, sf_dir).drop("diagnosis_date"), kanon.AnonymizeConfig(k=K, strategy="drop"))


@query(f"""{P}{_binned('age')}{_kept(K)} SELECT a.n AS input_rows, 'patient_id,name' AS direct, 'age,gender,zip_code' AS quasi, true AS k_anonymity_satisfied, {K} AS k_value,
  a.n - b.n AS rows_suppressed_k_anonymity, b.n AS output_rows, 'drop' AS anonymization_strategy FROM (SELECT count(*) AS n FROM patients) a, (SELECT count(*) AS n FROM kept) b""")
def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anonymization report, written as JSON and read back."""
    df, config, path = patients(spark, sf_dir), kanon.AnonymizeConfig(k=K, strategy="drop"), fresh_path(spark, "report")
    report = kanon.anonymization_report(df, kanon.anonymize(df, config), config)
    tables.write_report_json(report, path)
    back = tables.read_report_json(spark, path, report.schema)
    direct, quasi = F.array_join("phi_direct_columns", ",").alias("direct"), F.array_join("quasi_identifier_columns", ",").alias("quasi")
    return back.select("input_rows", direct, quasi, "k_anonymity_satisfied", "k_value", "rows_suppressed_k_anonymity", "output_rows", "anonymization_strategy")


# --- sources and sinks ---------------------------------------------------------------------------------------------


@query("SELECT * FROM part")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV and read with inferred types."""
    path = fresh_path(spark, "csv")
    tables.write_csv(read(spark, sf_dir, "part"), path)
    return tables.read_table_csv(spark, path).withColumn("p_size", F.col("p_size").cast("int"))


@query("SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate) FROM orders")
def quoted_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "quoted")
    tables.write_csv_quoted(read(spark, sf_dir, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")), path)
    return tables.read_table_csv(spark, path)


@query("SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def read_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with bars between its fields, whose separator is found from its first line."""
    path = fresh_path(spark, "bars") + ".txt"
    read(spark, sf_dir, "customer").write.option("header", True).option("sep", "|").csv(path)
    return tables.read_delimited(spark, path)


@query("SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier")
def read_first_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "folder")
    read(spark, sf_dir, "supplier").coalesce(1).write.option("header", True).csv(f"{folder}/a")
    read(spark, sf_dir, "nation").coalesce(1).write.option("header", True).csv(f"{folder}/b")
    return tables.read_first_csv(spark, folder)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey::DOUBLE END AS c_nationkey,
  c_custkey % 2 = 0 AS flag, CASE WHEN c_custkey % 5 = 0 THEN '?' ELSE c_nationkey::VARCHAR END AS odd FROM customer""")
def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with several marks for missing values: types come from the values."""
    texts = read(spark, sf_dir, "customer").selectExpr(
        "cast(c_custkey as string) as c_custkey", "case when c_custkey % 20 = 0 then 'N/A' when c_custkey % 10 = 0 then '' else cast(c_acctbal as string) end as c_acctbal",
        "case when c_custkey % 7 = 0 then 'null' else cast(c_nationkey as string) end as c_nationkey", "case when c_custkey % 2 = 0 then 'True' else 'False' end as flag",
        "case when c_custkey % 5 = 0 then '?' else cast(c_nationkey as string) end as odd",
    )
    return tables.infer_types(texts)


_SOURCES = """SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN ' ' || regexp_replace(url, '^https?://', '') WHEN 2 THEN url || '/data.CSV' WHEN 3 THEN 'data/file' || page_id || '.csv'
  WHEN 4 THEN 'https://www.kaggle.com/datasets/owner' || page_id || '/set' || page_id || '?a=b' ELSE 'https:///nothing' END AS url FROM {pages}"""


@query(f"""WITH s AS ({_SOURCES.format(pages='pages')}), t AS (SELECT page_id, url, trim(url) AS u FROM s),
  w AS (SELECT *, CASE WHEN u LIKE 'http://%' OR u LIKE 'https://%' OR (lower(u) LIKE '%.csv' AND NOT u LIKE 'http%://%') THEN u ELSE 'https://' || u END AS source FROM t)
  SELECT page_id, url, source, CASE WHEN NOT (source LIKE 'http://%' OR source LIKE 'https://%') THEN 'local_csv' WHEN lower(source) LIKE '%kaggle.com/datasets%' THEN 'kaggle'
  WHEN NOT regexp_matches(source, '^https?://[^/?#\\s]+') THEN 'invalid' WHEN regexp_matches(lower(source), '\\.(csv|data|txt)$') THEN 'raw_file' ELSE 'html' END AS kind FROM w""")
def classify_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.classify_sources(spark.sql(_SOURCES, pages=read(spark, sf_dir, "pages")))


@query(f"""WITH s AS ({_SOURCES.format(pages='pages')}) SELECT page_id, CASE WHEN page_id % 6 = 4 THEN 'owner' || page_id || '/set' || page_id END AS handle FROM s""")
def dataset_handle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SOURCES, pages=read(spark, sf_dir, "pages")).select("page_id", tables.dataset_handle(F.col("url")).alias("handle"))


_TABLE = """concat('<html><body><p>x</p><table><tr><th>key</th><th>name</th></tr><tr><td>', c_custkey, '</td><td> ', c_name, ' </td></tr><tr><td>', c_nationkey,
  '</td></tr></table><table><tr><td>other</td></tr></table></body></html>')"""
_TEXT = "concat('<html><body>key,name,more\n', c_custkey, ',', c_name, '\n', c_nationkey, '\n</body></html>')"
_LIST = "concat('<ul><li><b>key</b><span>', c_custkey, '</span></li><li>alone</li><li><b>name</b> <span>', c_name, '</span></li></ul>')"
_TABLE_ROWS = """SELECT c_custkey AS page_id, 'table' AS method, 0 AS row, 'key' AS field, c_custkey::VARCHAR AS value FROM c UNION ALL SELECT c_custkey, 'table', 0, 'name', c_name FROM c
  UNION ALL SELECT c_custkey, 'table', 1, 'key', c_nationkey::VARCHAR FROM c UNION ALL SELECT c_custkey, 'table', 1, 'name', NULL FROM c"""
_TEXT_ROWS = """SELECT c_custkey AS page_id, 'text' AS method, 0 AS row, 'key' AS field, c_custkey::VARCHAR AS value FROM c UNION ALL SELECT c_custkey, 'text', 0, 'name', c_name FROM c UNION ALL SELECT c_custkey, 'text', 0, 'more', NULL FROM c
  UNION ALL SELECT c_custkey, 'text', 1, 'key', c_nationkey::VARCHAR FROM c UNION ALL SELECT c_custkey, 'text', 1, 'name', NULL FROM c UNION ALL SELECT c_custkey, 'text', 1, 'more', NULL FROM c"""
_LIST_ROWS = """SELECT c_custkey AS page_id, 'list' AS method, 0 AS row, 'key' AS field, c_custkey::VARCHAR AS value FROM c UNION ALL SELECT c_custkey, 'list', 1, 'name', c_name FROM c"""


def _pages(spark: SparkSession, sf_dir: str, html: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), F.expr(html.replace("\n'", "\\n'").replace("more\n", "more\\n")).alias("html"))


@query(f"WITH c AS (SELECT * FROM customer) {_TABLE_ROWS}")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.html_tables(_pages(spark, sf_dir, _TABLE))


@query(f"WITH c AS (SELECT * FROM customer) {_TEXT_ROWS}")
def html_text_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.html_text_csv(_pages(spark, sf_dir, _TEXT))


@query(f"WITH c AS (SELECT * FROM customer) {_LIST_ROWS}")
def html_list_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.html_list_pairs(_pages(spark, sf_dir, _LIST))


@query(
    " UNION ALL ".join(
        f"SELECT * FROM (WITH c AS (SELECT * FROM customer WHERE c_custkey % 3 = {i}) {rows})" for i, rows in enumerate((_TABLE_ROWS, _TEXT_ROWS, _LIST_ROWS))
    )
)
def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the pages of each kind; what each page holds decides how it is read."""
    return pages.extract_pages(_pages(spark, sf_dir, f"case c_custkey % 3 when 0 then {_TABLE} when 1 then {_TEXT} else {_LIST} end"))


@query()
def extract_web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The web pages as they are; tests hold the rows against a plain reading of each page."""
    return pages.extract_pages(read(spark, sf_dir, "pages"))


#: The same by patterns: what is left without scripts, comments and tags is delimited if no line has more separators than the first.
@query(r"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->|<[^>]*>', '', 'g') AS bare FROM pages),
  t AS (SELECT page_id, regexp_replace(bare, '^\s+|\s+$', '', 'g') AS text FROM b),
  l AS (SELECT page_id, text, list_filter(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: regexp_matches(x, '\S')) AS lines FROM t),
  s AS (SELECT *, CASE WHEN contains(lines[1], ',') THEN ',' WHEN contains(lines[1], chr(9)) THEN chr(9) WHEN contains(lines[1], ';') THEN ';' WHEN contains(lines[1], '|') THEN '|' ELSE ',' END AS sep FROM l),
  n AS (SELECT page_id, text, list_transform(lines, lambda x: length(x) - length(replace(x, sep, ''))) AS n FROM s),
  o AS (SELECT page_id, n, contains(text, chr(10)) AND (contains(text, ',') OR contains(text, chr(9))) AND list_max(n) <= n[1] AS ok FROM n)
  SELECT page_id, CASE WHEN ok THEN 'text' END AS method, CASE WHEN ok THEN len(n) - 1 ELSE 0 END AS rows, CASE WHEN ok THEN n[1] + 1 ELSE 0 END AS fields, CASE WHEN NOT ok THEN 'no table, delimited text or list' END AS reason FROM o""")
def page_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each raw page was read, or why it wasn't."""
    return pages.page_reports(read(spark, sf_dir, "pages"))


# --- quality -------------------------------------------------------------------------------------------------------

COLUMNS = ["row_id", "patient_id", "name", "age", "gender", "zip_code", "diagnosis", "glucose", "charges", "priority", "diagnosis_date"]
NUMBERS = ["patient_id", "age", "glucose", "charges"]
_RATES = "rates AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column, count(*) - count({c}) AS missing, count(*) AS rows FROM patients" for c in COLUMNS) + ")"
SKIP = ("row_id",)


@query(f"{P}, {_RATES} SELECT column, missing, rows, round(missing::DOUBLE / rows, 6) AS rate FROM rates")
def missing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.missing_rates(patients(spark, sf_dir)))


@query(f"""{P}, {_RATES} SELECT 'missing_values' AS name, CASE WHEN max(missing / rows) <= 0.1 THEN 'pass' WHEN max(missing / rows) < 0.3 THEN 'warn' ELSE 'fail' END AS status,
  round(max(missing::DOUBLE / rows), 6) AS value, 0.1::DOUBLE AS threshold FROM rates""")
def check_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.check_missing(patients(spark, sf_dir), 0.1).select("name", "status", "value", "threshold"))


@query("""WITH g AS (SELECT count(*) AS n FROM documents GROUP BY text, lang, source, n_chars) SELECT sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS duplicates,
  round(sum(n - 1) * 100.0 / sum(n), 6)::DOUBLE AS duplicate_pct FROM g""")
def duplicate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.duplicate_stats(read(spark, sf_dir, "documents").drop("doc_id")))


ITEM_KEYS, ITEM_NUMBERS = ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ITEMS = [*ITEM_KEYS, *ITEM_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]
#: Whole rows, some of them twice.
_TWICE = "SELECT * FROM {lineitem} UNION ALL SELECT * FROM {lineitem} WHERE l_linenumber = 1"


@query(f"""WITH d AS ({_TWICE.format(lineitem='lineitem')}), g AS (SELECT count(*) AS n FROM d GROUP BY {', '.join(ITEMS)})
  SELECT 'duplicates' AS name, CASE WHEN sum(n - 1) = 0 THEN 'pass' WHEN sum(n - 1) * 100.0 / sum(n) < 5 THEN 'warn' ELSE 'fail' END AS status, sum(n - 1)::DOUBLE AS value FROM g""")
def check_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check_duplicates(spark.sql(_TWICE, lineitem=read(spark, sf_dir, "lineitem"))).select("name", "status", "value")


_RULES = [("age", "age", 0, 60), ("glucose", "glucose", 30, 600), ("charges", "charges", 1000, 100000)]
_DOMAIN = " UNION ALL ".join(
    f"SELECT '{c}' AS column, '{r}' AS rule, {lo}::DOUBLE AS low, {hi}::DOUBLE AS high, count(*) AS count, array_to_string((list({c}::DOUBLE ORDER BY row_id))[:3], ',') AS examples FROM patients WHERE {c} < {lo} OR {c} > {hi}"
    for c, r, lo, hi in _RULES
)


@query(f"{P} SELECT * FROM ({_DOMAIN}) WHERE count > 0")
def domain_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules for age and charges are the caller's; examples in the order of row_id."""
    found = quality.domain_violations(patients(spark, sf_dir), {"age": (0, 60), "charges": (1000, 100000)}, "row_id")
    return found.withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


@query(f"{P} SELECT 'domain' AS name, CASE WHEN count(*) = 0 THEN 'pass' ELSE 'warn' END AS status, count(*)::DOUBLE AS value FROM ({_DOMAIN}) WHERE count > 0")
def check_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check_domain(patients(spark, sf_dir), {"age": (0, 60), "charges": (1000, 100000)}, "row_id").select("name", "status", "value")


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipping before or after the order's date, shifted so that some are before."""
    return spark.sql(
        "SELECT l.l_orderkey AS row_id, cast(l.l_shipdate AS timestamp) AS treatment_date, cast(o.o_orderdate AS timestamp) + make_interval(0, 0, 0, 30) AS diagnosis_date, "
        "CAST(l.l_quantity AS INT) - 5 AS age, CASE WHEN l.l_quantity < 10 THEN 'low' WHEN l.l_quantity < 45 THEN 'middle' ELSE 'high' END AS age_group FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey",
        lineitem=read(spark, sf_dir, "lineitem"), orders=read(spark, sf_dir, "orders"),
    )


V = """WITH visits AS (SELECT l.l_orderkey AS row_id, l.l_shipdate AS treatment_date, o.o_orderdate + INTERVAL 30 DAY AS diagnosis_date, CAST(l.l_quantity AS INT) - 5 AS age,
  CASE WHEN l.l_quantity < 10 THEN 'low' WHEN l.l_quantity < 45 THEN 'middle' ELSE 'high' END AS age_group FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""
_DATES = "SELECT 'date_order' AS issue, 'treatment_date' AS subject, count(*)::DOUBLE AS value FROM visits WHERE treatment_date < diagnosis_date HAVING count(*) > 0"
_AGES = "SELECT 'age_group' AS issue, age_group AS subject, (max(age) - min(age))::DOUBLE AS value FROM visits GROUP BY age_group HAVING max(age) - min(age) > 30"
_NEGATIVE = "SELECT 'negative' AS issue, 'age|age' AS subject, count(*)::DOUBLE AS value FROM visits WHERE age < 0 HAVING count(*) > 0"


@query(f"{V} SELECT issue, subject AS column, value::BIGINT AS count FROM ({_DATES})")
def date_order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.date_order_violations(_visits(spark, sf_dir))


@query(f"{V} SELECT subject AS age_group, value AS spread FROM ({_AGES})")
def age_group_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.age_group_spread(_visits(spark, sf_dir))


@query(f"{P} SELECT 'negative' AS issue, 'glucose' AS column, 'glucose' AS word, count(*) AS count FROM patients WHERE glucose < 0 HAVING count(*) > 0")
def negative_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.negative_values(patients(spark, sf_dir))


@query(f"{V} {_DATES} UNION ALL {_AGES} UNION ALL {_NEGATIVE}")
def consistency_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.consistency_issues(_visits(spark, sf_dir))


@query(f"{V} SELECT 'consistency' AS name, CASE WHEN count(*) = 0 THEN 'pass' ELSE 'warn' END AS status, count(*)::DOUBLE AS value FROM ({_DATES} UNION ALL {_AGES} UNION ALL {_NEGATIVE})")
def check_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check_consistency(_visits(spark, sf_dir)).select("name", "status", "value")


def _stats(names: list[str], table: str = "patients") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, skewness({c}) AS skewness FROM {table}" for c in names)


@query(f"""{P} SELECT column, n, round(mean, 3) AS mean, round(std, 3) AS std, round(skewness, 3) AS skewness, round(CASE WHEN mean = 0 THEN 0 ELSE std / mean END, 3) AS cv
  FROM ({_stats(NUMBERS)}) WHERE n >= 10""")
def distribution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.distribution_stats(patients(spark, sf_dir), SKIP)


_EVENTS = "SELECT value, value * value * value * value AS spiky FROM {events}"
_WARN = f"""WITH e AS ({_EVENTS.format(events='events')}), s AS ({_stats(['value', 'spiky'], 'e')}), w AS (
  SELECT column, 'skewness' AS warning, round(skewness, 3) AS value FROM s WHERE n >= 10 AND abs(skewness) > 3
  UNION ALL SELECT column, 'cv', round(std / mean, 3) FROM s WHERE n >= 10 AND mean <> 0 AND std / mean > 0.5)"""


@query(f"{_WARN} SELECT * FROM w")
def distribution_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.distribution_warnings(spark.sql(_EVENTS, events=read(spark, sf_dir, "events")), 0.1)


@query(f"{_WARN} SELECT 'distribution' AS name, CASE WHEN count(*) = 0 THEN 'pass' ELSE 'warn' END AS status, count(*)::DOUBLE AS value FROM w")
def check_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check_distribution(spark.sql(_EVENTS, events=read(spark, sf_dir, "events")), 0.1).select("name", "status", "value")


_VERIFY = f"""{P}, {_RATES}, stats AS ({_stats(['row_id', *NUMBERS])}),
  results AS (SELECT 'missing_values' AS name, CASE WHEN max(missing / rows) <= 0.1 THEN 'pass' WHEN max(missing / rows) < 0.3 THEN 'warn' ELSE 'fail' END AS status, round(max(missing::DOUBLE / rows), 6) AS value FROM rates
  UNION ALL SELECT 'duplicates', CASE WHEN sum(n - 1) = 0 THEN 'pass' WHEN sum(n - 1) * 100.0 / sum(n) < 5 THEN 'warn' ELSE 'fail' END, sum(n - 1)::DOUBLE FROM (SELECT count(*) AS n FROM patients GROUP BY ALL)
  UNION ALL SELECT 'domain', CASE WHEN max(bad) THEN 'warn' ELSE 'pass' END, max(bad)::INT::DOUBLE FROM (SELECT glucose < 30 OR glucose > 600 AS bad FROM patients)
  UNION ALL SELECT 'consistency', CASE WHEN max(glucose < 0) THEN 'warn' ELSE 'pass' END, max(glucose < 0)::INT::DOUBLE FROM patients
  UNION ALL SELECT 'distribution', CASE WHEN count(*) = 0 THEN 'pass' ELSE 'warn' END, count(*)::DOUBLE FROM (SELECT 1 FROM stats WHERE abs(skewness) > 3 UNION ALL SELECT 1 FROM stats WHERE std / mean > 1.5))"""
# every column that verify() counts by duplicates is in `patients`, so GROUP BY ALL needs them selected
_VERIFY = _VERIFY.replace("(SELECT count(*) AS n FROM patients GROUP BY ALL)", f"(SELECT count(*) AS n FROM patients GROUP BY {', '.join(COLUMNS)})")


@query(f"{_VERIFY} SELECT name, status, value FROM results")
def verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.verify(patients(spark, sf_dir), quality.QualityConfig(missing_threshold=0.1)).select("name", "status", "value"))


@query(f"""WITH rates AS ({' UNION ALL '.join(f"SELECT (count(*) - count({c}))::DOUBLE / count(*) AS rate FROM lineitem" for c in ITEMS)}), stats AS ({_stats([*ITEM_KEYS, *ITEM_NUMBERS], 'lineitem')}),
  dups AS (SELECT sum(n - 1) AS d, sum(n) AS n FROM (SELECT count(*) AS n FROM lineitem GROUP BY {', '.join(ITEMS)})), w AS (SELECT 1 FROM stats WHERE abs(skewness) > 3 UNION ALL SELECT 1 FROM stats WHERE std / mean > 1.5)
  SELECT 'missing_values' AS name, CASE WHEN max(rate) <= 0.15 THEN 'pass' WHEN max(rate) < 0.3 THEN 'warn' ELSE 'fail' END AS status, round(max(rate), 6) AS value FROM rates
  UNION ALL SELECT 'duplicates', CASE WHEN d = 0 THEN 'pass' WHEN d * 100.0 / n < 5 THEN 'warn' ELSE 'fail' END, d::DOUBLE FROM dups
  UNION ALL SELECT 'domain', 'pass', 0::DOUBLE WHERE (SELECT count(*) FROM lineitem) > 0 UNION ALL SELECT 'consistency', 'pass', 0::DOUBLE WHERE (SELECT count(*) FROM lineitem) > 0
  UNION ALL SELECT 'distribution', CASE WHEN count(*) = 0 THEN 'pass' ELSE 'warn' END, count(*)::DOUBLE FROM w""")
def verify_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks on lineitem, of whose columns none has a range or a pair of dates."""
    return rounded(quality.verify(read(spark, sf_dir, "lineitem")).select("name", "status", "value"))


@query(f"""{_VERIFY} SELECT count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status = 'warn') AS warned,
  count(*) FILTER (status = 'fail') = 0 AS gate_passed, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'pass' END AS overall FROM results""")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.gate(quality.verify(patients(spark, sf_dir), quality.QualityConfig(missing_threshold=0.1)))


# --- features ------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN (SELECT bool_or(o_orderdate <> date_trunc('day', o_orderdate)) FROM orders) THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS o_orderdate,
  year(o_orderdate)::INT AS o_orderdate_year, month(o_orderdate)::INT AS o_orderdate_month, (isodow(o_orderdate) - 1)::INT AS o_orderdate_dayofweek FROM orders""")
def date_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    params = features.Params(skip=("o_orderkey",))
    features.fit_dates(df, params)
    return features.date_features(df, params)


_WRITTEN = "CASE o_orderkey % 10 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN 'soon' WHEN 2 THEN NULL ELSE strftime(o_orderdate, '%d/%m/%Y') END"


@query(f"""WITH t AS (SELECT o_orderkey, {_WRITTEN} AS visit_date FROM orders), d AS (SELECT o_orderkey, try_strptime(visit_date, '%d/%m/%Y') AS day FROM t)
  SELECT o_orderkey, strftime(day, '%Y-%m-%d') AS visit_date, year(day)::INT AS visit_date_year, month(day)::INT AS visit_date_month, (isodow(day) - 1)::INT AS visit_date_dayofweek FROM d""")
def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written day first, a few of them in another way, which are missing."""
    day = F.expr("CASE o_orderkey % 10 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN 'soon' WHEN 2 THEN NULL ELSE date_format(o_orderdate, 'dd/MM/yyyy') END")
    df = read(spark, sf_dir, "orders").select("o_orderkey", day.alias("visit_date"))
    params = features.Params(skip=("o_orderkey",))
    features.fit_dates(df, params)
    return features.date_features(df, params)


_MODE = "(SELECT priority FROM patients WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)"
_IMPUTED = f"""imputed AS (SELECT row_id, patient_id::DOUBLE AS patient_id, age::DOUBLE AS age, coalesce(glucose, (SELECT quantile_cont(glucose, 0.5) FROM patients)) AS glucose,
  coalesce(charges, (SELECT quantile_cont(charges, 0.5) FROM patients)) AS charges, gender, coalesce(priority, {_MODE}) AS priority, diagnosis FROM patients)"""
_FIVE = ("row_id", "patient_id", "age", "glucose", "charges", "gender", "priority", "diagnosis")


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patients(spark, sf_dir).select(*_FIVE)


@query(f"{P}, {_IMPUTED} SELECT * FROM imputed")
def impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, params = _table(spark, sf_dir), features.Params(skip=SKIP)
    features.fit_imputer(df, params)
    return features.impute(df, params)


@query(f"{P} " + " UNION ALL ".join(f"SELECT '{c}' AS column, (SELECT quantile_cont({c}::DOUBLE, 0.5) FROM patients) AS median" for c in NUMBERS))
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = features.Params(skip=SKIP)
    features.fit_imputer(_table(spark, sf_dir), params)
    return spark.createDataFrame(list(params.medians.items()), "column string, median double")


@query(f"{P} SELECT 'gender' AS column, (SELECT gender FROM patients GROUP BY gender ORDER BY count(*) DESC, gender LIMIT 1) AS mode UNION ALL SELECT 'priority', {_MODE} UNION ALL SELECT 'diagnosis', (SELECT diagnosis FROM patients GROUP BY diagnosis ORDER BY count(*) DESC, diagnosis LIMIT 1)")
def impute_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.modes(_table(spark, sf_dir), ["gender", "priority", "diagnosis"])
    return spark.createDataFrame(list(found.items()), "column string, mode string")


_ITEMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_BOUNDS = ", ".join(
    f"{c}_b AS (SELECT q[1] - 0.5 * (q[2] - q[1]) AS lo, q[2] + 0.5 * (q[2] - q[1]) AS hi FROM (SELECT quantile_cont({c}, [0.25, 0.75]) AS q FROM lineitem))" for c in _ITEMS
)


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, features.Params]:
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_ITEMS)
    params = features.Params(skip=("l_orderkey", "l_linenumber"))
    features.fit_bounds(df, params, factor=0.5)
    return df, params


@query(f"WITH {_BOUNDS} " + " UNION ALL ".join(f"SELECT '{c}' AS column, round(lo, 6) AS low, round(hi, 6) AS high FROM {c}_b" for c in _ITEMS))
def iqr_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = _items(spark, sf_dir)[1]
    return rounded(spark.createDataFrame([(c, *b) for c, b in params.bounds.items()], "column string, low double, high double"))


@query(f"WITH {_BOUNDS} SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(greatest(least({c}, {c}_b.hi), {c}_b.lo), 6) AS {c}" for c in _ITEMS) + f" FROM lineitem, {', '.join(f'{c}_b' for c in _ITEMS)}")
def clip_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.clip_outliers(*_items(spark, sf_dir)))


@query(
    f"WITH {_BOUNDS} SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"round(CASE WHEN {c} BETWEEN {c}_b.lo AND {c}_b.hi THEN {c} ELSE (SELECT quantile_cont({c}, 0.5) FROM lineitem) END, 6) AS {c}" for c in _ITEMS)
    + f" FROM lineitem, {', '.join(f'{c}_b' for c in _ITEMS)}"
)
def replace_outliers_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.replace_outliers_median(*_items(spark, sf_dir)))


@query(f"WITH {_BOUNDS} " + " UNION ALL ".join(f"SELECT '{c}' AS column, count(*) FILTER ({c} < lo OR {c} > hi) AS outliers, count({c}) AS values FROM lineitem, {c}_b" for c in _ITEMS))
def outlier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.outlier_counts(*_items(spark, sf_dir)).select("column", "outliers", "values")


@query("SELECT column, distinct_values AS distinct, CASE WHEN distinct_values <= 5 THEN 'one_hot' ELSE 'label' END AS encoding FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column, count(DISTINCT {c}) AS distinct_values FROM part" for c in ("p_name", "p_brand", "p_type")) + ")")
def cardinality_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.cardinality_split(read(spark, sf_dir, "part"))


@query(f"""{P}, cats AS (SELECT list(DISTINCT priority ORDER BY priority) AS ps FROM patients WHERE priority IS NOT NULL), segs AS (SELECT list(DISTINCT diagnosis ORDER BY diagnosis) AS ds FROM patients)
  SELECT row_id, c.column, (p.v IS NOT NULL AND p.v = c.value)::INT::DOUBLE AS flag FROM (SELECT row_id, unnest([priority, diagnosis]) AS v, unnest(['priority', 'diagnosis']) AS src FROM patients) p
  JOIN (SELECT 'priority' AS src, unnest(ps[2:]) AS value, 'priority_' || unnest(ps[2:]) AS column FROM cats UNION ALL SELECT 'diagnosis', unnest(ds[2:]), 'diagnosis_' || unnest(ds[2:]) FROM segs) c ON p.src = c.src""")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = patients(spark, sf_dir).select("row_id", "priority", "diagnosis")
    params = features.Params(skip=SKIP)
    features.fit_encoder(df, params)
    out = features.encode(df, params)
    return out.unpivot(["row_id"], [c for c in out.columns if c != "row_id"], "column", "flag")


@query("""WITH b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part)), n AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS code FROM (SELECT DISTINCT p_name FROM part))
  SELECT p_partkey, b.code AS p_brand, n.code AS p_name FROM part JOIN b USING (p_brand) JOIN n USING (p_name)""")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    params = features.Params(skip=("p_partkey",))
    features.fit_encoder(df, params, max_one_hot=3)
    return features.encode(df, params)


@query("SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT c_name AS value FROM customer)")
def label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of a column with as many values as rows."""
    return features.label_table(read(spark, sf_dir, "customer"), "c_name")


def _scaled(method: str) -> str:
    if method == "standard":
        return ", ".join(f"round(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem), 4) AS {c}" for c in _ITEMS)
    return ", ".join(f"round(({c} - (SELECT min({c}) FROM lineitem)) / (SELECT max({c}) - min({c}) FROM lineitem), 4) AS {c}" for c in _ITEMS)


def _scale(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_ITEMS)
    params = features.Params(skip=("l_orderkey", "l_linenumber"))
    features.fit_scaler(df, params, method)
    return rounded(features.scale(df, params), 4)


@query(f"SELECT l_orderkey, l_linenumber, {_scaled('standard')} FROM lineitem")
def scale_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scale(spark, sf_dir, "standard")


@query(f"SELECT l_orderkey, l_linenumber, {_scaled('minmax')} FROM lineitem")
def scale_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scale(spark, sf_dir, "minmax")


_SCALED = ["patient_id", "age", "glucose", "charges", "gender_M", *[f"priority_{p}" for p in ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]]
_FITTED = f"""{P}, {_IMPUTED}, b AS (SELECT {', '.join(f"quantile_cont({c}, [0.25, 0.75]) AS {c}_q" for c in NUMBERS)} FROM imputed),
  clipped AS (SELECT row_id, {', '.join(f"greatest(least({c}, {c}_q[2] + 1.5 * ({c}_q[2] - {c}_q[1])), {c}_q[1] - 1.5 * ({c}_q[2] - {c}_q[1])) AS {c}" for c in NUMBERS)}, gender, priority FROM imputed, b),
  coded AS (SELECT row_id, patient_id, age, glucose, charges, (gender = 'M')::INT::DOUBLE AS gender_M, {', '.join(f"(priority = '{p}')::INT::DOUBLE AS \"priority_{p}\"" for p in ('2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'))} FROM clipped),
  m AS (SELECT {', '.join(f'avg("{c}") AS "{c}_m", stddev_pop("{c}") AS "{c}_s"' for c in _SCALED)} FROM coded),
  done AS (SELECT row_id, {', '.join(f'round(("{c}" - "{c}_m") / CASE WHEN "{c}_s" = 0 THEN 1 ELSE "{c}_s" END, 4) AS "{c}"' for c in _SCALED)} FROM coded, m)"""


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir).drop("diagnosis")


@query(f"{_FITTED} SELECT * FROM done")
def fit_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.fit_transform(_features(spark, sf_dir), features.FeatureConfig(skip=SKIP))[0], 4)


_NEWER = "CASE WHEN row_id % 5 = 0 THEN 'never seen' ELSE priority END"
_CODED_NEW = ", ".join(f'"{c}" * (row_id % 5 <> 0)::INT AS "{c}"' for c in _SCALED if c.startswith("priority"))


@query(f"""{_FITTED}, fresh AS (SELECT * REPLACE ({_CODED_NEW}) FROM coded)
  SELECT row_id, {', '.join(f'round(("{c}" - "{c}_m") / CASE WHEN "{c}_s" = 0 THEN 1 ELSE "{c}_s" END, 4) AS "{c}"' for c in _SCALED)} FROM fresh, m""")
def transform_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters fitted on the table, applied to one of as many rows, some in a category that the fit didn't see."""
    df = _features(spark, sf_dir)
    return rounded(features.transform(df.withColumn("priority", F.expr(_NEWER)), features.fit(df, features.FeatureConfig(skip=SKIP))), 4)


_PARTS = ["l_shipdate_year", "l_shipdate_month", "l_shipdate_dayofweek"]
_CLIPPED = [*ITEM_NUMBERS, *_PARTS]
_CODES = ["l_returnflag_N", "l_returnflag_R", "l_linestatus_O", "l_shipdate"]


@query(f"""WITH base AS (SELECT {', '.join(ITEM_KEYS)}, {', '.join(f'{c}::DOUBLE AS {c}' for c in ITEM_NUMBERS)}, year(l_shipdate)::DOUBLE AS l_shipdate_year, month(l_shipdate)::DOUBLE AS l_shipdate_month,
    (isodow(l_shipdate) - 1)::DOUBLE AS l_shipdate_dayofweek, l_shipdate, l_returnflag, l_linestatus FROM lineitem),
  b AS (SELECT {', '.join(f'quantile_cont({c}, [0.25, 0.75]) AS {c}_q' for c in _CLIPPED)} FROM base),
  coded AS (SELECT {', '.join(ITEM_KEYS)}, {', '.join(f'greatest(least({c}, {c}_q[2] + 1.5 * ({c}_q[2] - {c}_q[1])), {c}_q[1] - 1.5 * ({c}_q[2] - {c}_q[1])) AS {c}' for c in _CLIPPED)},
    (l_returnflag = 'N')::INT::DOUBLE AS l_returnflag_N, (l_returnflag = 'R')::INT::DOUBLE AS l_returnflag_R, (l_linestatus = 'O')::INT::DOUBLE AS l_linestatus_O, (dense_rank() OVER (ORDER BY l_shipdate) - 1)::DOUBLE AS l_shipdate FROM base, b),
  m AS (SELECT {', '.join(f'avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s' for c in [*_CLIPPED, *_CODES])} FROM coded)
  SELECT {', '.join(ITEM_KEYS)}, {', '.join(f'round(({c} - {c}_m) / CASE WHEN {c}_s = 0 THEN 1 ELSE {c}_s END, 4) AS {c}' for c in [*_CLIPPED, *_CODES])} FROM coded, m""")
def fit_transform_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps on lineitem, with parts of its date and a code for each day."""
    df = read(spark, sf_dir, "lineitem")
    return rounded(features.fit_transform(df, features.FeatureConfig(skip=tuple(ITEM_KEYS)))[0], 4)


@query(f"{_FITTED} SELECT * FROM done")
def params_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters saved and loaded before they are applied."""
    df, path = _features(spark, sf_dir), fresh_path(spark, "params")
    features.save_params(spark, features.fit(df, features.FeatureConfig(skip=SKIP)), path)
    return rounded(features.transform(df, features.load_params(spark, path)), 4)


@query(f"""{P} SELECT 'gender_' || v AS feature FROM (SELECT DISTINCT gender AS v FROM patients) WHERE v <> (SELECT min(gender) FROM patients)
  UNION ALL SELECT 'priority_' || v FROM (SELECT DISTINCT priority AS v FROM patients WHERE priority IS NOT NULL) WHERE v <> (SELECT min(priority) FROM patients) UNION ALL SELECT 'name'""")
def feature_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = patients(spark, sf_dir).select("row_id", "gender", "priority", "name")
    params = features.fit(df, features.FeatureConfig(skip=SKIP))
    return spark.createDataFrame([(n,) for n in features.feature_names(params)], "feature string")


# --- profile -------------------------------------------------------------------------------------------------------


@query(f"{P} " + " UNION ALL ".join(f"""SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25,
  round(quantile_cont({c}::DOUBLE, 0.5), 6) AS q50, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75, max({c})::DOUBLE AS max, round((count(*) - count({c})) * 100.0 / count(*), 2)::DOUBLE AS missing_pct FROM patients""" for c in NUMBERS))
def describe_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rounded(profile.describe_numbers(patients(spark, sf_dir), SKIP))
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std")})


_TEXTS = ["name", "gender", "zip_code", "diagnosis", "priority"]


@query(f"{P} " + " UNION ALL ".join(f"SELECT '{c}' AS column, sum(n)::BIGINT AS count, count(*) AS \"unique\", arg_min(v, (-n, v)) AS top, max(n) AS freq FROM (SELECT {c} AS v, count(*) AS n FROM patients WHERE {c} IS NOT NULL GROUP BY 1)" for c in _TEXTS))
def describe_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.describe_strings(patients(spark, sf_dir))


@query(f"{P}, {_RATES} SELECT column, missing, round(missing::DOUBLE / rows, 6) AS rate, CASE WHEN missing / rows > 0.3 THEN 'CRITICAL' WHEN missing / rows > 0.15 THEN 'WARNING' ELSE 'OK' END AS level FROM rates WHERE missing > 0")
def missing_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.missing_ranking(patients(spark, sf_dir)))


@query(f"""{P}, {_RATES}, r AS (SELECT column, missing, round(missing * 100.0 / rows, 2)::DOUBLE AS rate_pct, round((SELECT avg(missing * 100.0 / rows) FROM rates), 6) AS mean_pct FROM rates)
  SELECT *, CASE WHEN rate_pct <= 15 THEN 'OK' WHEN rate_pct <= 30 THEN 'Warn' ELSE 'Fail' END AS level FROM r""")
def missing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.missing_table(patients(spark, sf_dir)))


@query(f"{P} SELECT {' || '.join(f'({c} IS NULL)::INT::VARCHAR' for c in COLUMNS)} AS pattern, count(*) AS rows FROM patients GROUP BY 1")
def missing_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.missing_map(patients(spark, sf_dir))


@query(" UNION ALL ".join(f"""SELECT '{c}' AS column, bin, round(any_value(lo) + bin * any_value(w), 6) AS low, round(any_value(w), 6) AS width, count(*) AS count, round(count(*) / ((SELECT count({c}) FROM lineitem) * any_value(w)), 6) AS density
  FROM (SELECT least(floor(({c} - lo) / w), 24)::INT AS bin, lo, w FROM lineitem, (SELECT min({c}) AS lo, (max({c}) - min({c})) / 25 AS w FROM lineitem)) GROUP BY bin""" for c in ("l_quantity", "l_extendedprice")))
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.histogram(read(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")))


@query(f"{P} " + " UNION ALL ".join(f"SELECT '{c}' AS column, count({c}) AS n, round(avg({c}), 4) AS mean, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median, round(skewness({c}), 6) AS skewness FROM patients" for c in NUMBERS))
def location_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.location_stats(patients(spark, sf_dir), SKIP)).withColumn("mean", F.round("mean", 4))


@query("""WITH s AS (SELECT count(l_quantity) AS n, stddev_samp(l_quantity) * power(count(l_quantity), -0.2) AS h, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
  g AS (SELECT i AS point, lo + i * (hi - lo) / 199 AS x FROM s, range(200) t(i)), c AS (SELECT l_quantity AS v, count(*) AS c FROM lineitem GROUP BY 1)
  SELECT point::INT AS point, round(x, 6) AS x, round(sum(c * exp(-(((x - v) / h) * ((x - v) / h)) / 2)) / any_value(n * h * sqrt(2 * pi())), 6) AS density FROM g, c, s GROUP BY point, x""")
def kde_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.kde_curve(read(spark, sf_dir, "lineitem"), "l_quantity"))


@query("""WITH s AS (SELECT count(*) AS n, stddev_samp(l_extendedprice) * power(count(*), -0.2) AS h, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
  g AS (SELECT i AS point, lo + i * (hi - lo) / 199 AS x FROM s, range(200) t(i)), c AS (SELECT l_extendedprice AS v, count(*) AS c FROM lineitem GROUP BY 1)
  SELECT point::INT AS point, round(x, 4) AS x, round(1e9 * sum(c * exp(-(((x - v) / h) * ((x - v) / h)) / 2)) / any_value(n * h * sqrt(2 * pi())), 4) AS density FROM g, c, s GROUP BY point, x""")
def kde_curve_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The density, in parts of 1e9, of a column of which nearly all values differ."""
    out = profile.kde_curve(read(spark, sf_dir, "lineitem"), "l_extendedprice")
    return out.select("point", F.round("x", 4).alias("x"), F.round(F.col("density") * 1e9, 4).alias("density"))


@query(f"{P}, v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column, {c} AS value, count(*) AS count FROM patients WHERE {c} IS NOT NULL GROUP BY {c}" for c in _TEXTS) + ") SELECT * FROM v WHERE column IN (SELECT column FROM v GROUP BY column HAVING count(*) <= 20)")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(patients(spark, sf_dir))


@query(f"{P} SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column, count(*) AS \"distinct\", arg_min(v, (-n, v)) AS mode FROM (SELECT {c} AS v, count(*) AS n FROM patients WHERE {c} IS NOT NULL GROUP BY 1)" for c in _TEXTS) + ') WHERE "distinct" <= 20')
def cardinality_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.cardinality_mode(patients(spark, sf_dir))


_PAIRS = [(a, b) for i, a in enumerate(_ITEMS) for b in _ITEMS[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in _ITEMS for b in _ITEMS))
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.correlation_matrix(read(spark, sf_dir, "lineitem").select(*_ITEMS)))


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 3) AS r, abs(corr({a}, {b})) > 0.8 AS strong FROM lineitem HAVING abs(corr({a}, {b})) > 0.5" for a, b in _PAIRS) + ")")
def strong_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.strong_pairs(read(spark, sf_dir, "lineitem").select(*_ITEMS))


_LINKED = "l_quantity::DOUBLE AS a, l_extendedprice AS b, l_extendedprice * (1 - l_discount) AS net, l_quantity * l_quantity AS sq, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE -l_quantity + l_tax * 100 END AS minus"
_LINKS = [(a, b) for i, a in enumerate(("a", "b", "net", "sq", "minus")) for b in ("a", "b", "net", "sq", "minus")[i + 1 :]]


@query(f"WITH t AS (SELECT {_LINKED} FROM lineitem) SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 3) AS r, abs(corr({a}, {b})) > 0.8 AS strong FROM t HAVING abs(corr({a}, {b})) > 0.5" for a, b in _LINKS) + ")")
def strong_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong pairs among columns of which some follow from others, one with missing values."""
    df = spark.sql("SELECT " + _LINKED.replace("l_quantity::DOUBLE", "CAST(l_quantity AS DOUBLE)") + " FROM {t}", t=read(spark, sf_dir, "lineitem"))
    return profile.strong_pairs(df)


@query(f"WITH {_BOUNDS} SELECT *, CASE WHEN outlier_pct > 5 THEN 'bad' WHEN outlier_pct > 1 THEN 'warn' ELSE 'ok' END AS level FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column, round(any_value(lo), 6) AS low, round(any_value(hi), 6) AS high, count(*) FILTER ({c} < lo OR {c} > hi) AS outliers, count({c}) AS values, round(count(*) FILTER ({c} < lo OR {c} > hi) * 100.0 / count({c}), 6)::DOUBLE AS outlier_pct FROM lineitem, {c}_b" for c in _ITEMS) + ")")
def outlier_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.outlier_report(read(spark, sf_dir, "lineitem").select(*_ITEMS), factor=0.5))


@query(" UNION ALL ".join(f"""SELECT '{c}' AS column, round(any_value(q[1]), 6) AS q1, round(any_value(q[2]), 6) AS median, round(any_value(q[3]), 6) AS q3, min({c}) FILTER ({c} >= q[1] - 1.5 * (q[3] - q[1])) AS whisker_low,
  max({c}) FILTER ({c} <= q[3] + 1.5 * (q[3] - q[1])) AS whisker_high FROM lineitem, (SELECT quantile_cont({c}, [0.25, 0.5, 0.75]) AS q FROM lineitem)""" for c in _ITEMS))
def boxplot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.boxplot_stats(read(spark, sf_dir, "lineitem").select(*_ITEMS)))


@query(f"""{P}, {_RATES} SELECT column AS subject, CASE WHEN missing / rows > 0.3 THEN 'drop' WHEN missing / rows > 0.15 THEN 'impute' ELSE 'acceptable' END AS advice, round(missing::DOUBLE / rows, 6) AS value FROM rates WHERE missing > 0
  UNION ALL SELECT column, 'anonymize', NULL FROM rates WHERE column IN ('row_id', 'patient_id', 'name')""")
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.recommendations(patients(spark, sf_dir)))


# --- versions ------------------------------------------------------------------------------------------------------

_OLD = "SELECT row_id, age, gender, glucose FROM {patients} WHERE row_id % 10 <> 3"
_NEW = "SELECT row_id, CASE WHEN row_id % 100 = 0 THEN age + 1 ELSE age END AS age, gender, glucose FROM {patients} WHERE row_id % 10 <> 4"
_OLD_NEW = f"{P}, a AS ({_OLD.format(patients='patients')}), b AS ({_NEW.format(patients='patients')})"


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = patients(spark, sf_dir)
    return spark.sql(_OLD, patients=df), spark.sql(_NEW, patients=df)


def _history(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame, DataFrame]:
    """Three tags of two contents."""
    root, (old, new) = fresh_path(spark, "versions"), _two(spark, sf_dir)
    versions.write_version(old, root, "v1", "first")
    versions.write_version(new, root, "v2", "second")
    versions.write_version(old, root, "v3", "back to the first")
    return root, old, new


@query(f"{_OLD_NEW} SELECT 'v1' AS tag, 4 AS columns, count(*) AS rows, 'first' AS message FROM a UNION ALL SELECT 'v2', 4, count(*), 'second' FROM b UNION ALL SELECT 'v3', 4, count(*), 'back to the first' FROM a")
def write_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, _, _ = _history(spark, sf_dir)
    return versions.manifest(spark, root).select("tag", F.size("columns").alias("columns"), "rows", "message")


@query(f"{_OLD_NEW} SELECT tag FROM (VALUES ('v3'), ('v2'), ('v1')) AS t(tag) WHERE (SELECT count(*) FROM a) > 0")
def list_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.list_versions(spark, _history(spark, sf_dir)[0])


@query(f"{_OLD_NEW} SELECT * FROM b")
def read_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.read_version(spark, _history(spark, sf_dir)[0], "v2")


@query(f"{_OLD_NEW} SELECT 'v2' AS tag, count(*) AS rows, 'second' AS message FROM b")
def version_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.version_info(spark, _history(spark, sf_dir)[0], "v2").select("tag", "rows", "message")


_APART = "(SELECT count(*) FROM ((SELECT * FROM {0} EXCEPT ALL SELECT * FROM {1}) UNION ALL (SELECT * FROM {1} EXCEPT ALL SELECT * FROM {0}))) > 0"


@query(f"{_OLD_NEW}, turned AS (SELECT * FROM a ORDER BY glucose) SELECT 'v1' AS tag, {_APART.format('a', 'turned')} AS changed UNION ALL SELECT 'v2', {_APART.format('a', 'b')} UNION ALL SELECT 'v3', {_APART.format('a', 'turned')}")
def version_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, old, _ = _history(spark, sf_dir)
    out = [versions.status(old, root, t) for t in ("v1", "v2", "v3")]
    return out[0].union(out[1]).union(out[2])


@query(f"{_OLD_NEW}, turned AS (SELECT * FROM a ORDER BY glucose) SELECT (SELECT count(*) FROM a) AS rows, NOT ({_APART.format('a', 'turned')}) AS same_in_any_order, NOT ({_APART.format('a', 'b')}) AS same_as_new")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint doesn't depend on the order of rows, and changes with them."""
    old, new = _two(spark, sf_dir)
    turned = old.repartition(7, "glucose")
    marks = [versions.fingerprint(x).withColumn("of", F.lit(n)) for n, x in (("old", old), ("turned", turned), ("new", new))]
    rows = marks[0].union(marks[1]).union(marks[2]).withColumn("mark", F.concat_ws("/", "rows", "hash_sum", "hash_xor"))
    of = {n: F.max(F.when(F.col("of") == n, F.col("mark"))) for n in ("old", "turned", "new")}
    return rows.agg(F.max(F.when(F.col("of") == "old", F.col("rows"))).alias("rows"), (of["old"] == of["turned"]).alias("same_in_any_order"), (of["old"] == of["new"]).alias("same_as_new"))


@query(f"{_OLD_NEW} SELECT *, 'removed' AS change, 1::BIGINT AS copies FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'added', 1 FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def diff_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.diff_versions(*_two(spark, sf_dir))


@query(f"{_OLD_NEW} SELECT 'removed' AS change, count(*) AS rows FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'added', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.diff_summary(*_two(spark, sf_dir))


_MOVED_OLD = "SELECT row_id, CASE WHEN row_id % 2 = 0 THEN age END AS x, CASE WHEN row_id % 2 = 1 OR row_id % 3 = 0 THEN age END AS y FROM {patients}"
_MOVED_NEW = "SELECT row_id, y AS x, x AS y FROM ({old}) WHERE row_id % 40 < 20 UNION ALL SELECT * FROM ({old}) WHERE row_id % 40 >= 20"
_MOVED = f"{P}, a AS ({_MOVED_OLD.format(patients='patients')}), b AS ({_MOVED_NEW.format(old='SELECT * FROM a')})"


def _moved(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame, DataFrame]:
    """Two versions that differ by the columns in which values are missing."""
    df, root = patients(spark, sf_dir), fresh_path(spark, "versions")
    old, new = spark.sql(_MOVED_OLD, patients=df), spark.sql(_MOVED_NEW.format(old=_MOVED_OLD), patients=df)
    versions.write_version(old, root, "v1")
    versions.write_version(new, root, "v2")
    return root, old, new


@query(f"{_MOVED} SELECT *, 'removed' AS change, 1::BIGINT AS copies FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'added', 1 FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def diff_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difference of two saved versions, by buckets."""
    return versions.diff_tags(spark, _moved(spark, sf_dir)[0], "v1", "v2")


@query(f"{_MOVED} SELECT 'v2' AS tag, {_APART.format('a', 'b')} AS changed, (SELECT count(*) FROM b) AS rows, (SELECT sum(x) FROM b)::BIGINT AS x, (SELECT sum(y) FROM b)::BIGINT AS y")
def version_of_moved_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that go from one column to another, nulls the other way, are a change, and are read back as they are."""
    root, old, _ = _moved(spark, sf_dir)
    back = versions.read_version(spark, root, "v2").agg(F.count(F.lit(1)).alias("rows"), F.sum("x").cast("long").alias("x"), F.sum("y").cast("long").alias("y"))
    return versions.status(old, root, "v2").join(back.withColumn("tag", F.lit("v2")), "tag")


# --- jobs ----------------------------------------------------------------------------------------------------------


_GATE = """(SELECT max(rate) < 0.3 FROM (SELECT unnest([count(*) - count(glucose), count(*) - count(charges), count(*) - count(priority)]) / count(*) AS rate FROM kept))
  AND (SELECT sum(n - 1) * 100.0 / sum(n) < 5 FROM (SELECT count(*) AS n FROM kept GROUP BY row_id))"""


@query(f"""{P}{_binned('age')}{_kept(K)}, g AS (SELECT {_GATE} AS ok)
  SELECT (SELECT count(*) FROM kept) AS rows, CASE WHEN ok THEN 'collect,anonymize,verify,transform,version' ELSE 'collect,anonymize,verify' END AS steps, ok AS success, ok AS gate_passed, CASE WHEN ok THEN 'v1' END AS version FROM g""")
def run_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run with its outputs; the transformed table's rows, read back from its version."""
    out = fresh_path(spark, "job")
    config = JobConfig(
        anonymize=kanon.AnonymizeConfig(k=K, strategy="hash", key=KEY), quality=quality.QualityConfig(missing_threshold=0.2, row_id="row_id"), features=features.FeatureConfig(skip=SKIP), output=out, version="v1"
    )
    done = run_pipeline(patients(spark, sf_dir), config)
    if done.error:
        raise RuntimeError(done.error)
    rows = versions.read_version(spark, f"{out}/versions", done.version_tag)
    return rows.agg(F.count(F.lit(1)).alias("rows")).withColumns({"steps": F.lit(",".join(done.steps_completed)), "success": F.lit(done.success), "gate_passed": F.lit(done.gate_passed), "version": F.lit(done.version_tag)})


@query(f"""{P}{_binned('age')}{_kept(K)}, runs AS (SELECT * FROM (VALUES (1), (2), (3)) AS v(run)), stages AS (SELECT * FROM (VALUES ('collect'), ('anonymize'), ('verify'), ('transform')) AS v(stage))
  SELECT CAST(run AS INT) AS run, stage, CASE WHEN run = 1 OR run = 3 AND stage = 'verify' THEN 'ran' ELSE 'skipped' END AS outcome, (SELECT count(*) FROM kept) AS rows FROM runs CROSS JOIN stages""")
def stage_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages from a Parquet table on: all run, then none, then with another threshold the checks alone; and the rows of
    the transformed table."""
    out = fresh_path(spark, "stages")
    patients(spark, sf_dir).write.parquet(f"{out}/patients")
    config = JobConfig(kanon.AnonymizeConfig(k=K, strategy="hash", key=KEY), quality.QualityConfig(missing_threshold=0.2, row_id="row_id"), features.FeatureConfig(skip=SKIP), out)
    other = replace(config, quality=quality.QualityConfig(missing_threshold=0.21, row_id="row_id"))
    found = [(i, *x) for i, how in enumerate((config, config, other), 1) for x in reproduce(spark, f"{out}/patients", how).items()]
    rows = spark.read.parquet(f"{out}/transformed").count()
    return spark.createDataFrame(found, "run int, stage string, outcome string").withColumn("rows", F.lit(rows).cast("long"))
