"""Cleaned data, issue log, reconciliation, run report and the four-table BI package."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablesmith.operators.reconcile import metric_rows
from tablesmith.operators.reshape import visible
from tablesmith.schema import ISSUE_SCHEMA, SHEET, quoted

# Names of the BI tables, and the columns of the run table.
BI_TABLES = ["Cleaned_Data", "Issue_Log", "Reconciliation_Summary", "Run_Info"]
RUN_INFO = [
    "job_id", "filename", "engine", "llm_mode", "confidence",
    "input_rows", "output_rows", "issues", "duration_seconds",
]


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Cleaned data as CSV, without provenance columns. Quotes are doubled, as spreadsheets expect."""
    visible(df).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Cleaned data as Parquet, without provenance columns."""
    visible(df).write.mode(mode).parquet(path)


def _log_columns(issues: DataFrame) -> list[Column]:
    """The columns of a log; file and sheet come first where rows are named by them."""
    scope = [F.col(n) for n in ("file", SHEET) if n in issues.columns]
    return [*scope, *[F.col(f.name).cast(f.dataType) for f in ISSUE_SCHEMA.fields]]


def write_issue_log(issues: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The issue log as CSV; a clean run still gets a header."""
    issues.select(*_log_columns(issues)).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_reconciliation(summary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The one-row summary as section/metric/value rows in CSV."""
    metric_rows(summary).coalesce(1).write.mode(mode).option("header", True).csv(path)


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Run metadata as JSON; unset fields stay visible as null."""
    report.write.mode(mode).option("ignoreNullFields", False).json(path)


def run_report(
    summary: DataFrame, mapping: dict[str, str | None], required: list[str], mode: str, review: list[str] | None = None,
    duration_seconds: float | None = None,
) -> DataFrame:
    """The one-row report of a run: its counts, what was mapped to what, and what to review."""
    pairs = [F.lit(mapping.get(t)).cast("string").alias(t) for t in required]
    notes = F.array(*[F.lit(n) for n in review or []]).cast("array<string>")
    return summary.select(
        "*",
        F.lit(mode).alias("dataset_mode"),
        F.struct(*pairs).alias("mapping"),
        F.array(*[F.lit(t) for t in required]).alias("required_columns"),
        notes.alias("review"),
        F.lit(duration_seconds).cast("double").alias("duration_seconds"),
    )


def run_info(spark: SparkSession, report: dict) -> DataFrame:
    """The one-row run table, from whichever of its fields are known."""
    types = {"job_id": "bigint", "confidence": "double", "duration_seconds": "double"}
    types |= {n: "bigint" for n in ("input_rows", "output_rows", "issues")}
    return spark.range(1).select(*[F.lit(report.get(n)).cast(types.get(n, "string")).alias(n) for n in RUN_INFO])


def write_bi_package(
    rows: DataFrame, issues: DataFrame, summary: DataFrame, info: DataFrame, folder: str, mode: str = "errorifexists"
) -> dict[str, str]:
    """Four Parquet tables under ``folder``; cleaned columns are sorted by name. Returns their paths."""
    plain = visible(rows)
    frames = [
        plain.select(*[F.col(quoted(n)) for n in sorted(plain.columns)]),
        issues.select(*_log_columns(issues)),
        metric_rows(summary),
        info.select(*RUN_INFO),
    ]
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in BI_TABLES}
    for name, df in zip(BI_TABLES, frames):
        df.write.mode(mode).parquet(paths[name])
    return paths


def write_run(rows: DataFrame, folder: str, job_id: int) -> None:
    """The output of a run into the dataset of all runs, as the partition of its ``job_id``.

    Writing a job again replaces its rows and no others. Runs may differ in their columns.
    """
    marked = visible(rows).withColumn("job_id", F.lit(job_id).cast("bigint"))
    marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(folder)


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The dataset of all runs; a column that a run lacks is null. A filter on ``job_id`` reads only those runs."""
    runs = spark.read.option("mergeSchema", True).parquet(folder)
    return runs.select(F.col("job_id").cast("bigint").alias("job_id"), *[F.col(quoted(n)) for n in runs.columns if n != "job_id"])
