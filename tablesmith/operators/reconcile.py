"""Row-count reconciliation and column profiles."""

from pyspark.sql import Column, DataFrame, functions as F

from tablesmith.functions.numbers import is_numeric
from tablesmith.schema import AGGREGATE_ROW, DUPLICATE, INVALID_PERIOD, NULL_ROW, quoted

# Metric names in report order.
METRICS = [
    "job_id",
    "source_file",
    "input_rows",
    "output_rows",
    "rows_removed_null",
    "rows_removed_duplicate",
    "rows_removed_aggregate",
    "rows_flagged_invalid_period",
    "total_rows_removed_or_flagged",
    "net_reconciliation_pct",
    "null_cells_in_source",
    "total_issues_logged",
]


def issue_breakdown(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue_type").agg(F.count("*").alias("count"))


def null_count(columns: list[str]) -> Column:
    """How many cells of a row are null."""
    nulls = [F.col(quoted(n)).isNull().cast("bigint") for n in columns]
    return sum(nulls[1:], nulls[0])


def input_totals(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row count and null cells of a source table, in one pass."""
    return df.agg(
        F.count("*").alias("input_rows"),
        F.coalesce(F.sum(null_count(columns)), F.lit(0)).alias("null_cells_in_source"),
    )


def reconciliation(
    totals: DataFrame, output: DataFrame | int, issues: DataFrame, job_id: int | None = None, source_file: str | None = None
) -> DataFrame:
    """One row of counts, with the issue breakdown as a map.

    Each input shrinks to a handful of (metric, value) rows first; those are put together
    by one small aggregate. ``output`` is the output, or its number of rows if that is known.
    """
    if isinstance(output, int):
        rows = totals.sparkSession.createDataFrame([(output,)], "value bigint")
    else:
        rows = output.agg(F.count("*").alias("value"))
    pair = lambda name, value: F.struct(F.lit(name).alias("metric"), value.cast("bigint").alias("value"))
    metrics = (
        totals.select(F.inline(F.array(*[pair(n, F.col(n)) for n in ("input_rows", "null_cells_in_source")])))
        .unionByName(rows.select(F.lit("output_rows").alias("metric"), "value"))
        .unionByName(
            issue_breakdown(issues).select(F.concat(F.lit("issue:"), F.col("issue_type")).alias("metric"), F.col("count").alias("value"))
        )
    )
    is_issue = F.col("metric").startswith("issue:")
    value = lambda name: F.coalesce(F.max(F.when(F.col("metric") == name, F.col("value"))), F.lit(0))
    breakdown = F.collect_list(F.when(is_issue, F.struct(F.regexp_replace("metric", "^issue:", "").alias("name"), "value")))
    row = metrics.agg(
        value("input_rows").alias("input_rows"),
        value("output_rows").alias("output_rows"),
        value(f"issue:{NULL_ROW}").alias("rows_removed_null"),
        value(f"issue:{DUPLICATE}").alias("rows_removed_duplicate"),
        value(f"issue:{AGGREGATE_ROW}").alias("rows_removed_aggregate"),
        value(f"issue:{INVALID_PERIOD}").alias("rows_flagged_invalid_period"),
        value("null_cells_in_source").alias("null_cells_in_source"),
        F.coalesce(F.sum(F.when(is_issue, F.col("value"))), F.lit(0)).alias("total_issues_logged"),
        F.map_from_entries(breakdown).alias("issue_breakdown"),
    )
    removed = sum(
        [F.col(n) for n in ("rows_removed_duplicate", "rows_removed_aggregate", "rows_flagged_invalid_period")],
        F.col("rows_removed_null"),
    )
    share = F.round(F.col("output_rows") / F.nullif(F.col("input_rows"), F.lit(0)) * 100, 2)
    extra = {
        "job_id": F.lit(job_id).cast("bigint"),
        "source_file": F.lit(source_file).cast("string"),
        "total_rows_removed_or_flagged": removed,
        "net_reconciliation_pct": F.coalesce(share, F.lit(0.0)),
    }
    return row.select(*[extra.get(n, F.col(n)).alias(n) for n in [*METRICS, "issue_breakdown"]])


def metric_rows(summary: DataFrame) -> DataFrame:
    """The summary as (section, metric, value) rows: the metrics, then the issue types."""
    row = lambda section, metric, value: F.struct(
        F.lit(section).alias("section"), metric.alias("metric"), value.cast("string").alias("value")
    )
    metrics = F.array(*[row("Metric", F.lit(n), F.col(n)) for n in METRICS])
    types = F.transform(F.map_entries("issue_breakdown"), lambda e: row("Issue type", e["key"], e["value"]))
    return summary.select(F.inline(F.concat(metrics, types)))


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Name, type and null count of every column, with the row count; one pass over the table."""
    columns = df.columns if columns is None else columns
    types = dict(df.dtypes)
    counts = df.agg(
        F.count("*").alias("row_count"),
        *[F.count(F.col(quoted(n))).alias(f"_filled_{i}") for i, n in enumerate(columns)],
    )
    rows = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(n).alias("name"),
            F.lit(types[n]).alias("dtype"),
            (F.col("row_count") - F.col(f"_filled_{i}")).alias("null_count"),
            F.col("row_count"),
        )
        for i, n in enumerate(columns)
    ]
    return counts.select(F.inline(F.array(*rows)))


def head(df: DataFrame, n: int, order_by: str) -> DataFrame:
    """The first ``n`` rows of a table, for a look at it."""
    return df.orderBy(F.col(quoted(order_by))).limit(n)


def numeric_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column the fraction of values that read as numbers; nulls count as not numeric."""
    shares = df.agg(*[F.avg(is_numeric(F.col(quoted(n)).cast("string")).cast("double")).alias(f"_{i}") for i, n in enumerate(columns)])
    rows = [F.struct(F.lit(n).alias("name"), F.col(f"_{i}").alias("numeric_share")) for i, n in enumerate(columns)]
    return shares.select(F.inline(F.array(*rows)))
