"""Stages that run only if what they read, their parameters, their code or their outputs changed since they last ran.

A log of numbered entries (sources/commitlog.py) says of each run what went in and what came out.  Files are compared first,
by names, lengths and times, without opening one; if those differ, the rows' fingerprint decides, by one scan.
"""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass
from types import ModuleType

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources import commitlog
from plumbline.sources.digests import fingerprint

RAN, SKIPPED, FAILED = "ran", "skipped", "failed"
_ENTRY = "number long, stage string, asked string, files string, rows string, outputs map<string,string>"


@dataclass(frozen=True)
class Stage:
    name: str
    path: str  # what it reads
    outputs: tuple[str, ...]  # what its work writes
    work: Callable[[DataFrame], bool]  # False: it failed, and what comes after it doesn't run
    parameters: object = None  # anything that JSON takes
    code: tuple[ModuleType, ...] = ()  # modules whose text counts as a parameter


def _mark(df: DataFrame) -> str:
    return ":".join(str(x) for x in fingerprint(df).first())


def files_mark(spark: SparkSession, path: str) -> str | None:
    """A mark of the names, lengths and times of the files under a path; None if there is no such path.  No file is opened."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return _mark(files.select("path", "length", "modificationTime"))


def _asked(stage: Stage) -> str:
    text = json.dumps([stage.path, stage.parameters, [inspect.getsource(m) for m in stage.code]], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def run_stage(spark: SparkSession, log: str, stage: Stage, read: Callable[[SparkSession, str], DataFrame], force: bool = False) -> str:
    """RAN, SKIPPED or FAILED.  A stage that fails leaves no entry, so it runs again; so does one that ended between its
    outputs and its entry, as the outputs aren't those of the last entry.  An input that changes while a stage reads it has
    the mark of before, so the next run sees the change."""
    asked, files = _asked(stage), files_mark(spark, stage.path)
    last = commitlog.entries(spark, log, _ENTRY).where(F.col("stage") == stage.name).orderBy(F.desc("number")).first()
    same = not force and last is not None and last["asked"] == asked and last["outputs"] == {o: files_mark(spark, o) for o in stage.outputs}
    if same and last["files"] == files:
        return SKIPPED
    df = read(spark, stage.path)
    rows = _mark(df)
    outcome = SKIPPED if same and last["rows"] == rows else RAN
    if outcome == RAN and not stage.work(df):
        return FAILED
    outputs = {o: files_mark(spark, o) for o in stage.outputs}
    commitlog.append(spark, log, {"stage": stage.name, "asked": asked, "files": files, "rows": rows, "outputs": outputs})
    return outcome


def run_stages(spark: SparkSession, log: str, stages: list[Stage], read: Callable[[SparkSession, str], DataFrame], force: bool = False) -> dict[str, str]:
    """The outcome of each stage, in order, up to the first that fails."""
    found: dict[str, str] = {}
    for stage in stages:
        found[stage.name] = run_stage(spark, log, stage, read, force)
        if found[stage.name] == FAILED:
            break
    return found
