"""Figures across runs, and totals of cleaned rows by dimension."""

from pyspark.sql import DataFrame, functions as F

from tablesmith.operators.lookup import lookup_join
from tablesmith.operators.reshape import SOURCE_ROW
from tablesmith.schema import quoted

# How many of the latest runs the summary covers, lists, and shows first.
SUMMARY_RUNS = 200
LISTED_RUNS = 100
RECENT_RUNS = 10
COMPLETED = "COMPLETED"


def latest_runs(runs: DataFrame, n: int = LISTED_RUNS) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(n)


def completed_runs(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status") == COMPLETED)


def run_kpis(runs: DataFrame) -> DataFrame:
    """One row: run counts, summed rows and issues, mean confidence, success rate in percent."""
    done = F.col("status") == COMPLETED
    total = lambda name: F.coalesce(F.sum(F.when(done, F.col(name))), F.lit(0))
    mean = F.round(F.avg(F.when(done, F.col("confidence"))), 3)
    rate = F.round(F.count_if(done) / F.nullif(F.count("*"), F.lit(0)) * 100)
    return runs.agg(
        F.count("*").alias("total_jobs"),
        F.count_if(done).alias("completed_jobs"),
        total("row_count").alias("total_input_rows"),
        total("output_rows").alias("total_output_rows"),
        total("issue_count").alias("total_issues"),
        F.coalesce(mean, F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(rate, F.lit(0.0)).cast("bigint").alias("success_rate_pct"),
    )


def runs_by_engine(runs: DataFrame) -> DataFrame:
    engine = F.coalesce(F.nullif(F.col("engine"), F.lit("")), F.lit("UNKNOWN"))
    return completed_runs(runs).groupBy(engine.alias("engine")).agg(F.count("*").alias("runs"))


def runs_by_status(runs: DataFrame) -> DataFrame:
    return runs.groupBy("status").agg(F.count("*").alias("runs"))


def totals_by_dimension(df: DataFrame, dimension: str, periods: list[str]) -> DataFrame:
    """Row count and the sum of each period column per value of one dimension."""
    return df.groupBy(F.col(quoted(dimension))).agg(
        F.count("*").alias("row_count"), *[F.sum(F.col(quoted(p)).cast("double")).alias(p) for p in periods]
    )


def totals_rollup(df: DataFrame, dimensions: list[str], periods: list[str]) -> DataFrame:
    """Row count and sums of the period columns for each prefix of ``dimensions``, down to the grand total.

    ``_level`` is the number of dimensions that a row is told by, so that a null of the data is
    not taken for a sub-total: rows of the full number are those of ``totals_by_dimension`` over
    all of them, and the row of level 0 is the total.
    """
    keys = [F.col(quoted(d)) for d in dimensions]
    level = len(dimensions) - F.bit_count(F.grouping_id())
    sums = [F.sum(F.col(quoted(p)).cast("double")).alias(p) for p in periods]
    return df.rollup(*keys).agg(level.cast("int").alias("_level"), F.count("*").alias("row_count"), *sums)


def with_run_info(rows: DataFrame, run_info: DataFrame, spread: str = SOURCE_ROW) -> DataFrame:
    """Add the run's columns to its cleaned rows; one run may hold most of the rows."""
    return lookup_join(rows, run_info, ["job_id"], F.col(quoted(spread)), "left")
