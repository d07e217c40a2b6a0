"""The whole run and its stages: read, anonymize, check, transform, version."""

from __future__ import annotations

import argparse
from dataclasses import asdict, dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from plumbline.operators import features, kanon, quality
from plumbline.operators.features import FeatureConfig, fit_transform, save_params
from plumbline.operators.kanon import AnonymizeConfig, anonymization_report, anonymize
from plumbline.operators.quality import QualityConfig, gate, verify
from plumbline.plans.stages import FAILED, Stage, run_stage, run_stages
from plumbline.sources.tables import read_delimited, read_table_csv, write_csv_quoted, write_report_json
from plumbline.sources.versions import write_version


@dataclass(frozen=True)
class JobConfig:
    anonymize: AnonymizeConfig = AnonymizeConfig()
    quality: QualityConfig = QualityConfig()
    features: FeatureConfig = FeatureConfig()
    output: str | None = None  # folder of anonymized/, reports/, transformed/ and versions/; nothing is written without
    version: str | None = None


@dataclass
class JobResult:
    success: bool = False
    gate_passed: bool = False
    steps_completed: list[str] = field(default_factory=list)
    output_path: str | None = None
    version_tag: str | None = None
    error: str | None = None
    warnings: list[str] = field(default_factory=list)
    table: DataFrame | None = None


def run_pipeline(df: DataFrame, config: JobConfig = JobConfig()) -> JobResult:
    """Anonymize, check (after anonymizing, so that binned columns are text there), stop at a failed gate, transform, version."""
    spark, result, out = df.sparkSession, JobResult(), config.output
    if not df.columns or df.isEmpty():
        result.error = "the input is empty"
        return result
    result.steps_completed.append("collect")
    kept = anonymize(df, config.anonymize)
    if out:
        kept.write.mode("overwrite").parquet(f"{out}/anonymized")
        kept = spark.read.parquet(f"{out}/anonymized")
        write_report_json(anonymization_report(df, kept, config.anonymize), f"{out}/reports/anonymization")
    else:
        kept = kept.persist(StorageLevel.MEMORY_AND_DISK)
    result.steps_completed.append("anonymize")
    results = verify(kept, config.quality).persist(StorageLevel.MEMORY_AND_DISK)
    result.gate_passed = gate(results).first()["gate_passed"]
    if out:
        write_report_json(results, f"{out}/reports/quality")
    result.steps_completed.append("verify")
    if not result.gate_passed:
        result.error = "the quality gate failed"
        return result
    table, params = fit_transform(kept, config.features)
    if out:
        table.write.mode("overwrite").parquet(f"{out}/transformed")
        table = spark.read.parquet(f"{out}/transformed")
        save_params(spark, params, f"{out}/params")
        result.output_path = f"{out}/transformed"
    result.table = table
    result.steps_completed.append("transform")
    if out:
        try:
            result.version_tag = write_version(table, f"{out}/versions", config.version)
            result.steps_completed.append("version")
        except Exception as e:  # a version that can't be saved doesn't undo the run
            result.warnings.append(f"not versioned: {e}")
    result.success = True
    return result


def job_stages(path: str, config: JobConfig) -> list[Stage]:
    """The stages of a run from the file or folder at path to config.output, each reading what one before it wrote."""
    out = config.output

    def collect(df: DataFrame) -> bool:
        if df.isEmpty():
            return False
        write_csv_quoted(df, f"{out}/raw.csv")
        return True

    def hide(df: DataFrame) -> bool:
        anonymize(df, config.anonymize).write.mode("overwrite").parquet(f"{out}/anonymized")
        kept = df.sparkSession.read.parquet(f"{out}/anonymized")
        write_report_json(anonymization_report(df, kept, config.anonymize), f"{out}/reports/anonymization")
        return True

    def check(df: DataFrame) -> bool:
        results = verify(df, config.quality).persist(StorageLevel.MEMORY_AND_DISK)
        write_report_json(results, f"{out}/reports/quality")
        return gate(results).first()["gate_passed"]

    def prepare(df: DataFrame) -> bool:
        table, params = fit_transform(df, config.features)
        table.write.mode("overwrite").parquet(f"{out}/transformed")
        save_params(df.sparkSession, params, f"{out}/params")
        return True

    hidden = f"{out}/anonymized"
    return [
        Stage("collect", path, (f"{out}/raw.csv",), collect),
        Stage("anonymize", f"{out}/raw.csv", (hidden, f"{out}/reports/anonymization"), hide, asdict(config.anonymize), (kanon,)),
        Stage("verify", hidden, (f"{out}/reports/quality",), check, asdict(config.quality), (quality,)),
        Stage("transform", hidden, (f"{out}/transformed", f"{out}/params"), prepare, asdict(config.features), (features,)),
    ]


def reproduce(spark: SparkSession, path: str, config: JobConfig, force: bool = False) -> dict[str, str]:
    """Bring config.output up to date: each stage's outcome, of which only those run whose input, parameters, code or outputs
    changed.  A gate that rejects the table ends the run."""
    return run_stages(spark, f"{config.output}/stages", job_stages(path, config), source, force)


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description="Anonymize, check and prepare a table.")
    p.add_argument("--stage", choices=["all", "changed", "collect", "anonymize", "verify", "transform"], default="all", help="changed: of all stages those whose input, parameters or outputs changed")
    p.add_argument("--path", required=True, help="a .csv, .txt or .data file, or the folder of the stage before")
    p.add_argument("--output", required=True)
    p.add_argument("--k", type=int, default=3)
    p.add_argument("--strategy", choices=["drop", "hash", "replace"], default="replace")
    p.add_argument("--key", help="for --strategy hash")
    p.add_argument("--row-id", help="for --strategy replace")
    p.add_argument("--force", action="store_true", help="run stages though nothing changed")
    p.add_argument("--version")
    p.add_argument("--missing-threshold", type=float, default=0.15)
    return p.parse_args(argv)


def source(spark: SparkSession, path: str) -> DataFrame:
    """A table by the end of its name: .csv (a file, or the folder that collecting makes), another delimited file, or Parquet."""
    name = path.lower().rstrip("/")
    if name.endswith(".csv"):
        return read_table_csv(spark, path)
    return read_delimited(spark, path) if name.endswith((".txt", ".data")) else spark.read.parquet(path)


def main(argv: list[str] | None = None) -> int:
    """Exit code 0, or 1 if the gate rejects the table or the run fails."""
    a = arguments(argv)
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    skip = (a.row_id,) if a.row_id else ()
    config = JobConfig(AnonymizeConfig(a.k, a.strategy, a.key, a.row_id), QualityConfig(a.missing_threshold, row_id=a.row_id), FeatureConfig(skip=skip), a.output, a.version)
    if a.stage == "all":
        return int(not run_pipeline(source(spark, a.path), config).success)
    if a.stage == "changed":
        return int(FAILED in reproduce(spark, a.path, config, a.force).values())
    one = next(s for s in job_stages(a.path, config) if s.name == a.stage)
    return int(run_stage(spark, f"{a.output}/stages", replace(one, path=a.path), source, a.force) == FAILED)


if __name__ == "__main__":
    raise SystemExit(main())
