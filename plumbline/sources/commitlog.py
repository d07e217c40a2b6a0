"""A log of numbered entries in a shared folder, each created once however many writers there are.

An entry is a JSON file named by its number.  A writer makes the whole file under a hidden name and then gives it its number
in one step that fails if the number is taken: a hard link on a local file system, elsewhere a rename that doesn't overwrite
(atomic on HDFS and on stores with such a rename).  Who comes second takes the next number.  So an entry is there as a whole
or not at all, none is lost, and their order needs no clock.
"""

from __future__ import annotations

import json
import os
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_NAME = re.compile(r"^(\d{20})\.json$")


def _file_system(spark: SparkSession, folder: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, folder: str) -> list[int]:
    path, fs = _file_system(spark, folder)
    if not fs.exists(path):
        return []
    return sorted(int(m[1]) for m in (_NAME.match(s.getPath().getName()) for s in fs.listStatus(path)) if m)


def create(spark: SparkSession, folder: str, name: str, text: str, linked: bool | None = None) -> bool:
    """Make the file with this text, as a whole; False if there is one by that name already."""
    path, fs = _file_system(spark, folder)
    fs.mkdirs(path)
    hidden = f".{uuid.uuid4().hex}"
    if fs.getScheme() == "file" if linked is None else linked:
        local = path.toUri().getPath()
        with open(f"{local}/{hidden}", "x") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(f"{local}/{hidden}", f"{local}/{name}")
        except FileExistsError:
            return False
        finally:
            os.unlink(f"{local}/{hidden}")
        return True
    jvm = spark._jvm
    made = jvm.org.apache.hadoop.fs.Path(path, hidden)
    out = fs.create(made, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark._sc._gateway.new_array(kind, 1)
    how[0] = kind.valueOf("NONE")
    try:
        context.rename(made, jvm.org.apache.hadoop.fs.Path(path, name), how)
    except Py4JJavaError as e:
        fs.delete(made, False)
        if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
            return False
        raise
    return True


def append(spark: SparkSession, folder: str, entry: dict) -> int:
    """Add an entry under the next free number, which becomes its field `number`."""
    number = max(numbers(spark, folder), default=0) + 1
    while not create(spark, folder, f"{number:020d}.json", json.dumps(entry | {"number": number})):
        number = max(number, *numbers(spark, folder)) + 1
    return number


def entries(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All entries, in no order; an empty table if there are none."""
    return spark.read.schema(schema).json(folder) if numbers(spark, folder) else spark.createDataFrame([], schema)
