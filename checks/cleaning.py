"""Row rules, de-duplication, issue log, reconciliation and profiles."""

from pyspark.sql import functions as F

from checks.fixtures import table, view
from checks.registry import query
from tablesmith.operators.cleaning import (
    clean_rows,
    clean_values,
    issue_log,
    remove_bad_rows,
    split_duplicates,
    strict_aggregate,
    tag_rows,
)
from tablesmith.operators.reconcile import (
    METRICS,
    column_profile,
    head,
    input_totals,
    issue_breakdown,
    metric_rows,
    numeric_share,
    reconciliation,
)
from tablesmith.schema import AGGREGATE_ROW, INVALID_PERIOD, NULL_ROW
from tablesmith.session import materialize

CELLS = ["pais", "canal", "categoria", "quantity", "email"]


def cleaned_sql(column: str) -> str:
    return f"nullif(trim(regexp_replace({column}, '\\s+', ' ', 'g')), '')"


_FILLED = " + ".join(f"cast({c} is not null as int)" for c in CELLS)
# Every row with its verdict: KEPT or the issue type.
JUDGED = f"""
with cleaned as (select source_row, {", ".join(f"{cleaned_sql(c)} as {c}" for c in CELLS)} from dirty_orders),
tagged as (select *, case when {_FILLED} = 0 then 'NULL_ROW_REMOVED'
    when {_FILLED} <= 2 and regexp_matches(concat_ws(' ', {", ".join(CELLS)}), '(?i)\\b(Result|Subtotal|Grand Total|Total)\\b')
    then 'AGGREGATE_ROW' end as tag from cleaned),
numbered as (select *, row_number() over (partition by tag, {", ".join(CELLS)} order by source_row) as copy from tagged),
judged as (select *, coalesce(tag, case when copy > 1 then 'DUPLICATE_REMOVED' else 'KEPT' end) as verdict from numbered)
"""
_DETAIL = """case verdict when 'NULL_ROW_REMOVED' then 'Entirely blank row removed'
  when 'AGGREGATE_ROW' then 'Subtotal/Result/Total row excluded' else 'Exact duplicate row removed' end"""


def _cleaned(spark, sf_dir):
    return clean_values(view(spark, sf_dir, "dirty_orders"), unicode=False)


def _tagged(spark, sf_dir):
    return tag_rows(_cleaned(spark, sf_dir))


def _split(spark, sf_dir):
    return remove_bad_rows(materialize(_tagged(spark, sf_dir), "tagged"))


@query("p5_blank_rows", JUDGED + f"select source_row, verdict as issue_type, {_DETAIL} as detail from judged where verdict = 'NULL_ROW_REMOVED'")
def _(spark, sf_dir):
    return issue_log(_tagged(spark, sf_dir).where(F.col("issue_type") == NULL_ROW), NULL_ROW)


@query("p6_sparse_aggregate_rows", JUDGED + f"select source_row, verdict as issue_type, {_DETAIL} as detail from judged where verdict = 'AGGREGATE_ROW'")
def _(spark, sf_dir):
    return issue_log(_tagged(spark, sf_dir).where(F.col("issue_type") == AGGREGATE_ROW), AGGREGATE_ROW)


@query(
    "p7_strict_aggregate_rows",
    r"""select source_row, pais, canal, categoria, marca from shipments_wide
        where not regexp_matches(concat_ws(' ', pais, canal, categoria, marca), '(?i)\b(Result|Subtotal|Total)\b')""",
)
def _(spark, sf_dir):
    columns = ["pais", "canal", "categoria", "marca"]
    rows = view(spark, sf_dir, "shipments_wide").select("source_row", *columns)
    return rows.where(~strict_aggregate(columns))


@query("p12_row_tags", JUDGED + f"select source_row, verdict, case when verdict <> 'KEPT' then {_DETAIL} end as detail from judged")
def _(spark, sf_dir):
    split = _split(spark, sf_dir)
    kept = split.rows.select("source_row", F.lit("KEPT").alias("verdict"), F.lit(None).cast("string").alias("detail"))
    return kept.unionByName(split.issues.select("source_row", F.col("issue_type").alias("verdict"), "detail"))


@query("p12_kept_rows", JUDGED + f"select source_row, {', '.join(CELLS)} from judged where verdict = 'KEPT'")
def _(spark, sf_dir):
    return remove_bad_rows(_tagged(spark, sf_dir)).rows


@query("p12_issue_log", JUDGED + f"select source_row, verdict as issue_type, {_DETAIL} as detail from judged where verdict <> 'KEPT'")
def _(spark, sf_dir):
    return _split(spark, sf_dir).issues


@query(
    "p12_clean_rows",
    JUDGED + f"""select source_row, pais, canal, categoria, lower(email) as email,
        case when regexp_matches(quantity, '^\\(?\\d+\\)?$')
             then case when quantity[1] = '(' then 0 - cast(trim(quantity, '()') as double) else cast(quantity as double) end end as quantity
        from judged where verdict = 'KEPT'""",
)
def _(spark, sf_dir):
    rows = clean_rows(view(spark, sf_dir, "dirty_orders"), {"quantity": "number", "pais": "as_is", "canal": "as_is", "categoria": "as_is"})
    return rows.rows


_LINE = "l_orderkey, l_partkey, l_returnflag, l_linestatus"


@query(
    "a3_deduplicate",
    f"""select {_LINE}, min(l_orderkey * 10 + l_linenumber) as source_row
        from (select l_orderkey % 500 as l_orderkey, l_partkey % 7 as l_partkey, l_returnflag, l_linestatus,
                     l_linenumber from lineitem) as t group by all""",
)
def _(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 500).alias("l_orderkey"),
        (F.col("l_partkey") % 7).alias("l_partkey"),
        "l_returnflag",
        "l_linestatus",
        (F.col("l_orderkey") % 500 * 10 + F.col("l_linenumber")).alias("source_row"),
    )
    return split_duplicates(line).rows


@query(
    "a3_duplicate_log",
    """select o_orderkey as source_row, 'DUPLICATE_REMOVED' as issue_type, 'Exact duplicate row removed' as detail
       from orders qualify row_number() over (partition by o_orderstatus, o_orderpriority, o_custkey order by o_orderkey) > 1""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("source_row"), "o_orderstatus", "o_orderpriority", "o_custkey"
    )
    return split_duplicates(rows).issues


@query("a4_issue_breakdown", JUDGED + "select verdict as issue_type, count(*) as count from judged where verdict <> 'KEPT' group by 1")
def _(spark, sf_dir):
    return issue_breakdown(_split(spark, sf_dir).issues)


_NULLS = " + ".join(f"sum(cast({c} is null as int))" for c in CELLS)


@query("a5_input_totals", f"select count(*) as input_rows, cast({_NULLS} as bigint) as null_cells_in_source from dirty_orders")
def _(spark, sf_dir):
    return input_totals(view(spark, sf_dir, "dirty_orders"), CELLS)


_COUNT = lambda verdict: f"count(*) filter (verdict = '{verdict}')"
_SUMMARY = JUDGED + f"""
, nulls as (select cast({_NULLS} as bigint) as n from dirty_orders),
summary as (select cast(7 as bigint) as job_id, 'dirty_orders' as source_file, count(*) as input_rows, {_COUNT('KEPT')} as output_rows,
       {_COUNT('NULL_ROW_REMOVED')} as rows_removed_null, {_COUNT('DUPLICATE_REMOVED')} as rows_removed_duplicate,
       {_COUNT('AGGREGATE_ROW')} as rows_removed_aggregate, cast(0 as bigint) as rows_flagged_invalid_period,
       count(*) - {_COUNT('KEPT')} as total_rows_removed_or_flagged,
       round({_COUNT('KEPT')} / count(*) * 100, 2) as net_reconciliation_pct,
       (select n from nulls) as null_cells_in_source, count(*) - {_COUNT('KEPT')} as total_issues_logged from judged)
"""


def _summary(spark, sf_dir, split=None):
    source = view(spark, sf_dir, "dirty_orders")
    split = split or _split(spark, sf_dir)
    return reconciliation(input_totals(source, CELLS), split.rows, split.issues, 7, "dirty_orders")


@query("a6_reconciliation", _SUMMARY + "select * from summary")
def _(spark, sf_dir):
    return _summary(spark, sf_dir).drop("issue_breakdown")


METRIC_ROWS = _SUMMARY + " union all ".join(
    [f"select 'Metric' as section, '{m}' as metric, cast({m} as varchar) as value from summary" for m in METRICS]
    + ["select 'Issue type', verdict, cast(count(*) as varchar) from judged where verdict <> 'KEPT' group by verdict"]
)


@query("a6_metric_rows", METRIC_ROWS)
def _(spark, sf_dir):
    return metric_rows(_summary(spark, sf_dir))


_PROFILE = {
    "id": "bigint", "filename": "string", "engine": "string", "status": "string", "row_count": "bigint",
    "output_rows": "bigint", "null_count": "bigint", "issue_count": "bigint", "confidence": "double",
}


@query(
    "a7_column_profile",
    " union all ".join(
        f"select {i} as position, '{n}' as name, '{t}' as dtype, count(*) - count({n}) as null_count, count(*) as row_count from job_runs"
        for i, (n, t) in enumerate(_PROFILE.items(), 1)
    ),
)
def _(spark, sf_dir):
    return column_profile(view(spark, sf_dir, "job_runs"))


@query("a7_sample_rows", "select * from job_runs order by id limit 8")
def _(spark, sf_dir):
    return head(view(spark, sf_dir, "job_runs"), 8, "id")


_IS_NUMBER = "coalesce(regexp_matches(trim(X), '^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)$'), false)"


@query(
    "a12_numeric_share",
    " union all ".join(
        f"select '{c}' as name, avg(cast({_IS_NUMBER.replace('X', c)} as int)) as numeric_share from dirty_orders" for c in CELLS
    ),
)
def _(spark, sf_dir):
    return numeric_share(view(spark, sf_dir, "dirty_orders"), CELLS)


@query("l2_head", "select * from dirty_orders order by source_row limit 12")
def _(spark, sf_dir):
    return head(view(spark, sf_dir, "dirty_orders"), 12, "source_row")


@query(
    "u2_issue_union",
    JUDGED + f"""select source_row, verdict as issue_type, {_DETAIL} as detail from judged where verdict <> 'KEPT'
       union all select source_row, 'INVALID_PERIOD', 'Could not parse year/period' from shipments_long where periodo = 'P13'""",
)
def _(spark, sf_dir):
    invalid = issue_log(view(spark, sf_dir, "shipments_long").where("periodo = 'P13'"), INVALID_PERIOD)
    return _split(spark, sf_dir).issues.unionByName(invalid)
