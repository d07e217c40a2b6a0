"""The folder that the driver and all executors share, and what is written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.values import quoted

#: Rows of a range in dense_positions().
RANGE_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Only a session on one machine that names none (a test) gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there and no executor's loss repeats the work."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dense_positions(df: DataFrame, key: str, name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds the row's place in the order of key, from 0, without sending all rows through one task.

    Rows are dealt to about as many ranges of key as they make range_rows; a range's rows are counted, and its first place
    is the sum of the counts before.  The driver sees one count a range.
    """
    ranges = max(1, -(-df.count() // range_rows))
    dealt = written(df.repartitionByRange(ranges, quoted(key)).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = sorted((r["_range"], r["count"]) for r in dealt.groupBy("_range").count().collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    first = F.broadcast(df.sparkSession.createDataFrame(starts, "_range int, _start long"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(quoted(key))) - 1 + F.col("_start")
    return dealt.join(first, "_range").withColumn(name, place.cast("long")).select(*[quoted(c) for c in dict.fromkeys([*df.columns, name])])
