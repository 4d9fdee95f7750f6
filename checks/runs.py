"""Figures across runs."""

from pyspark.sql import functions as F

from checks.fixtures import view
from checks.registry import query
from tablesmith.operators.portfolio import (
    RECENT_RUNS,
    SUMMARY_RUNS,
    completed_runs,
    latest_runs,
    run_kpis,
    runs_by_engine,
    runs_by_status,
    with_run_info,
)

_LATEST = "(select * from job_runs order by id desc limit 200) as latest"


def _runs(spark, sf_dir):
    return view(spark, sf_dir, "job_runs")


@query("p11_completed_runs", "select * from job_runs where status = 'COMPLETED'")
def _(spark, sf_dir):
    return completed_runs(_runs(spark, sf_dir))


@query("l1_latest_runs", "select * from job_runs order by id desc limit 100")
def _(spark, sf_dir):
    return latest_runs(_runs(spark, sf_dir))


@query("l1_recent_runs", "select * from job_runs order by id desc limit 10")
def _(spark, sf_dir):
    return latest_runs(_runs(spark, sf_dir), RECENT_RUNS)


_KPIS = """
select count(*) as total_jobs, count(*) filter (status = 'COMPLETED') as completed_jobs,
  cast(coalesce(sum(row_count) filter (status = 'COMPLETED'), 0) as bigint) as total_input_rows,
  cast(coalesce(sum(output_rows) filter (status = 'COMPLETED'), 0) as bigint) as total_output_rows,
  cast(coalesce(sum(issue_count) filter (status = 'COMPLETED'), 0) as bigint) as total_issues,
  coalesce(round(avg(confidence) filter (status = 'COMPLETED'), 3), 0) as avg_confidence,
  cast(round(count(*) filter (status = 'COMPLETED') / count(*) * 100) as bigint) as success_rate_pct
from 
"""


@query("a8_run_kpis", _KPIS + _LATEST)
def _(spark, sf_dir):
    return run_kpis(latest_runs(_runs(spark, sf_dir), SUMMARY_RUNS))


@query("a8_run_kpis_all", _KPIS + "job_runs")
def _(spark, sf_dir):
    return run_kpis(_runs(spark, sf_dir))


@query("a9_runs_by_engine", f"select coalesce(nullif(engine, ''), 'UNKNOWN') as engine, count(*) as runs from {_LATEST} where status = 'COMPLETED' group by 1")
def _(spark, sf_dir):
    return runs_by_engine(latest_runs(_runs(spark, sf_dir), SUMMARY_RUNS))


@query("a9_runs_by_status", "select status, count(*) as runs from job_runs group by 1")
def _(spark, sf_dir):
    return runs_by_status(_runs(spark, sf_dir))


@query("a10_success_rate", "select cast(round(count(*) filter (status = 'COMPLETED') / count(*) * 100) as bigint) as success_rate_pct from job_runs")
def _(spark, sf_dir):
    return run_kpis(_runs(spark, sf_dir)).select("success_rate_pct")


@query(
    "j3_run_info",
    """select s.source_row as _source_row, s.source_row % 300 as job_id, s.canal as "Channel", r.filename, r.engine, r.confidence
       from shipments_long as s left join job_runs as r on r.id = s.source_row % 300""",
)
def _(spark, sf_dir):
    rows = view(spark, sf_dir, "shipments_long").select(
        F.col("source_row").alias("_source_row"), (F.col("source_row") % 300).alias("job_id"), F.col("canal").alias("Channel")
    )
    info = _runs(spark, sf_dir).select(F.col("id").alias("job_id"), "filename", "engine", "confidence")
    return with_run_info(rows, info)
