"""Target projection, wide and long-period reshape, unions, and full runs."""

from pyspark.sql import functions as F

from checks.cleaning import cleaned_sql
from checks.fixtures import WIDE_HEADERS, table, view
from checks.registry import query
from checks.scalars import LONG_PERIOD_SQL
from tablesmith.functions.text import collapse_whitespace
from tablesmith.operators.portfolio import totals_by_dimension, totals_rollup
from tablesmith.operators.reshape import (
    append_outputs,
    append_runs,
    in_source_order,
    long_to_wide,
    project_targets,
    select_periods,
    sum_by_period,
    visible,
    wide_to_long,
    wide_to_target,
)
from tablesmith.plans.transform import transform_long, transform_wide
from tablesmith.session import scratch_path
from tablesmith.sinks.tables import read_runs, write_run

PERIODS = [f"{year}-{month:02d}" for year in range(1995, 2002) for month in range(1, 13)]
MONTHS = dict(zip(WIDE_HEADERS, ["1997-01", "1997-02", "1997-03", "1997-04"]))

LONG_MAPPING = {"Country": "pais", "Region": "region", "Channel": "canal", "Category": "categoria", "Fact": "quantity"}
LONG_TARGETS = ["Country", "Region", "Channel", "Category", "Brand", "Fact"]
WIDE_MAPPING = {"Country": "pais", "Channel": "canal", "Category": "categoria", "Brand": "marca", "Fact": "period values"}


def pivot_sql(value: str, periods=PERIODS) -> str:
    return ", ".join(f"""sum({value}) filter (period = '{p}') as "{p}\"""" for p in periods)


@query(
    "p1_target_projection",
    """select cast(null as varchar) as "Brand", trim(pais) as "Country", cast(null as varchar) as "SKU", canal as "Channel",
              cast(quantity as varchar) as "Fact", source_row as _source_row,
              '{"Brand":null,"Country":"pais","SKU":"absent","Channel":"canal","Fact":"quantity"}' as _source_trace
       from shipments_long""",
)
def _(spark, sf_dir):
    rows = view(spark, sf_dir, "shipments_long").withColumn("pais", F.trim("pais"))
    mapping = {"Country": "pais", "Channel": "canal", "SKU": "absent", "Fact": "quantity"}
    return project_targets(rows, mapping, ["Brand", "Country", "Other", "SKU", "Channel", "Fact"])


_P_COLUMNS = ", ".join(f'{p} as "{m}"' for p, m in MONTHS.items())


@query("p4_period_columns", f"select source_row, {_P_COLUMNS} from shipments_wide")
def _(spark, sf_dir):
    wide = view(spark, sf_dir, "shipments_wide")
    return wide.select("source_row", *select_periods(wide))


@query(
    "p8_invalid_periods",
    f"""select source_row, 'INVALID_PERIOD' as issue_type, 'Could not parse year/period' as detail
        from shipments_long where {LONG_PERIOD_SQL} is null""",
)
def _(spark, sf_dir):
    long = view(spark, sf_dir, "shipments_long")
    return long_to_wide(long, LONG_MAPPING, "display_year", "periodo", LONG_TARGETS, periods=PERIODS).issues


@query(
    "r2_unlisted_periods",
    f"""select source_row, case when p is null then 'INVALID_PERIOD' else 'UNLISTED_PERIOD' end as issue_type,
          case when p is null then 'Could not parse year/period' else 'Period is not among the requested ones' end as detail
        from (select source_row, {LONG_PERIOD_SQL} as p from shipments_long) as t where p is null or p not between '1996-03' and '1999-10'""",
)
def _(spark, sf_dir):
    long = view(spark, sf_dir, "shipments_long")
    some = [p for p in PERIODS if "1996-03" <= p <= "1999-10"]
    return long_to_wide(long, LONG_MAPPING, "display_year", "periodo", LONG_TARGETS, periods=some).issues


_A1_KEYS = "l_returnflag, l_linestatus, l_linenumber, l_discount"


@query(
    "a1_long_period_group_sum",
    f"""select {_A1_KEYS}, {pivot_sql("l_quantity")}
        from (select *, strftime(l_shipdate, '%Y-%m') as period from lineitem) as t group by {_A1_KEYS}""",
)
def _(spark, sf_dir):
    keys = _A1_KEYS.split(", ")
    line = table(spark, sf_dir, "lineitem").select(
        *keys,
        F.date_format("l_shipdate", "yyyy-MM").alias("period"),
        F.col("l_quantity").alias("fact"),
        F.col("l_orderkey").alias("source_row"),
    )
    return sum_by_period(line, keys, PERIODS).select(*keys, *[F.col(f"`{p}`") for p in PERIODS])


_LONG = f"""
with parsed as (select source_row, {cleaned_sql("pais")} as "Country", region as "Region", canal as "Channel", categoria as "Category",
    cast(null as varchar) as "Brand", quantity, {LONG_PERIOD_SQL} as period from shipments_long),
valid as (select * from parsed where period is not null)
"""
_DIMS = '"Country", "Region", "Channel", "Category", "Brand"'


def _long_result(spark, sf_dir, **options):
    long = view(spark, sf_dir, "shipments_long").withColumn("pais", collapse_whitespace(F.col("pais")))
    return long_to_wide(long, LONG_MAPPING, "display_year", "periodo", LONG_TARGETS, **options)


@query(
    "a2_first_row_carry",
    _LONG + f"""select {_DIMS}, arg_min(coalesce(quantity, 'nan'), source_row) as "Fact", min(source_row) as _source_row from valid group by {_DIMS}""",
)
def _(spark, sf_dir):
    rows = _long_result(spark, sf_dir, periods=[]).rows
    return rows.withColumn("Fact", F.coalesce("Fact", F.lit(float("nan")))).drop("_source_trace")


_FIRST = """arg_min(struct_pack(q := quantity), source_row).q as "Fact" """


@query("r2_long_to_wide", _LONG + f"select {_DIMS}, {_FIRST}, {pivot_sql('coalesce(quantity, 0)')} from valid group by {_DIMS}")
def _(spark, sf_dir):
    return visible(_long_result(spark, sf_dir, periods=PERIODS).rows)


@query("r2_null_fact_kept", _LONG + f"select {_DIMS}, {_FIRST}, {pivot_sql('quantity')} from valid group by {_DIMS}")
def _(spark, sf_dir):
    return visible(_long_result(spark, sf_dir, periods=PERIODS, null_fact="null").rows)


@query(
    "r2_period_map",
    _LONG + f"""select {_DIMS}, {_FIRST}, string_agg(period || '=' || cast(cast(total as bigint) as varchar), ',' order by period) as periods from (
        select {_DIMS}, period, sum(coalesce(quantity, 0)) as total, min(source_row) as source_row, arg_min(struct_pack(q := quantity), source_row).q as quantity
        from valid group by {_DIMS}, period) as t group by {_DIMS}""",
)
def _(spark, sf_dir):
    """One map per group, for any number of periods; here as text, since maps cannot be compared."""
    rows = visible(_long_result(spark, sf_dir, as_map=True).rows)
    entries = F.transform(F.map_entries("periods"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("bigint").cast("string")))
    return rows.withColumn("periods", F.array_join(entries, ","))


@query(
    "r2_discovered_periods",
    _LONG + f"""select {_DIMS}, period, sum(coalesce(quantity, 0)) as value from valid group by {_DIMS}, period""",
)
def _(spark, sf_dir):
    return wide_to_long(_long_result(spark, sf_dir).rows, LONG_TARGETS[:-1])


_STRICT = r"not regexp_matches(concat_ws(' ', pais, canal, categoria, marca), '(?i)\b(Result|Subtotal|Total)\b')"
_WIDE_TARGETS = """pais as "Country", cast(null as varchar) as "Region", canal as "Channel", cast(null as varchar) as "City/State",
   categoria as "Category", marca as "Brand", cast(null as varchar) as "SKU", cast(null as varchar) as "Fact" """


@query("r1_wide_to_target", f"select {_WIDE_TARGETS}, source_row as _source_row, {_P_COLUMNS} from shipments_wide where {_STRICT}")
def _(spark, sf_dir):
    return wide_to_target(view(spark, sf_dir, "shipments_wide"), WIDE_MAPPING).rows.drop("_source_trace")


@query(
    "r1_wide_issues",
    f"""select source_row, 'AGGREGATE_ROW' as issue_type, 'Subtotal/Result/Total row excluded' as detail
        from shipments_wide where not ({_STRICT})""",
)
def _(spark, sf_dir):
    return wide_to_target(view(spark, sf_dir, "shipments_wide"), WIDE_MAPPING).issues


@query(
    "r4_wide_to_long",
    " union all ".join(f"select source_row, pais, '{m}' as period, {p} as value from shipments_wide where {p} is not null" for p, m in MONTHS.items()),
)
def _(spark, sf_dir):
    wide = view(spark, sf_dir, "shipments_wide")
    return wide_to_long(wide.select("source_row", "pais", *select_periods(wide)), ["source_row", "pais"])


_SUMS = ", ".join(f'sum({p}) as "{m}"' for p, m in MONTHS.items())


@query(
    "a11_totals_by_dimension",
    " union all ".join(
        f"""select '{t}' as dimension, {c} as name, count(*) as row_count, {_SUMS} from shipments_wide where {_STRICT} group by {c}"""
        for t, c in [("Category", "categoria"), ("Brand", "marca"), ("Channel", "canal")]
    ),
)
def _(spark, sf_dir):
    rows = wide_to_target(view(spark, sf_dir, "shipments_wide"), WIDE_MAPPING).rows
    totals = [
        totals_by_dimension(rows, t, list(MONTHS.values())).withColumnRenamed(t, "name").select(F.lit(t).alias("dimension"), "*")
        for t in ("Category", "Brand", "Channel")
    ]
    return append_outputs(totals)


@query("l5_source_order", _LONG + f"""select {_DIMS}, min(source_row) as _source_row from valid group by {_DIMS} order by _source_row""")
def _(spark, sf_dir):
    rows = in_source_order(_long_result(spark, sf_dir, periods=[]).rows)
    return rows.drop("Fact", "_source_trace")


@query(
    "a11_rollup",
    f"""select canal as "Channel", categoria as "Category", marca as "Brand", cast(3 - bit_count(grouping_id(canal, categoria, marca)) as int) as _level,
        count(*) as row_count, {_SUMS} from (select * replace (case when categoria = '1-URGENT' then null else categoria end as categoria) from shipments_wide where {_STRICT}) as t
        group by rollup (canal, categoria, marca)""",
)
def _(spark, sf_dir):
    """Sub-totals next to rows whose category is null in the data."""
    rows = wide_to_target(view(spark, sf_dir, "shipments_wide"), WIDE_MAPPING).rows
    rows = rows.withColumn("Category", F.when(F.col("Category") != "1-URGENT", F.col("Category")))
    return totals_rollup(rows, ["Channel", "Category", "Brand"], list(MONTHS.values()))


_TWO_SHEETS = f"""
select 'North' as sheet, pais as "Country", canal as "Channel", p1 as "1997-01", p2 as "1997-02", cast(null as double) as "1997-03" from shipments_wide
union all select 'South', pais, cast(null as varchar), cast(null as double), p2, p3 from shipments_wide
"""


def _two_sheets(spark, sf_dir):
    wide = view(spark, sf_dir, "shipments_wide")
    country, channel = F.col("pais").alias("Country"), F.col("canal").alias("Channel")
    month = lambda p: F.col(f"`{WIDE_HEADERS[p]}`").alias(MONTHS[p])
    north = wide.select(F.lit("North").alias("sheet"), country, channel, month("p1"), month("p2"))
    return north, wide.select(F.lit("South").alias("sheet"), country, month("p2"), month("p3"))


@query("u1_append_sheets", _TWO_SHEETS)
def _(spark, sf_dir):
    return append_outputs(_two_sheets(spark, sf_dir))


@query("u3_append_runs", f"select cast(case sheet when 'North' then 11 else 12 end as bigint) as job_id, * from ({_TWO_SHEETS}) as t")
def _(spark, sf_dir):
    north, south = _two_sheets(spark, sf_dir)
    return append_runs({11: north, 12: south})


@query("u3_runs_dataset", f"select cast(case sheet when 'North' then 11 else 12 end as bigint) as job_id, * from ({_TWO_SHEETS}) as t")
def _(spark, sf_dir):
    """Runs written one by one into one dataset; the first is written twice."""
    folder, (north, south) = scratch_path(spark, "u3"), _two_sheets(spark, sf_dir)
    for job, rows in ((11, south), (12, south), (11, north)):
        write_run(rows, folder, job)
    return read_runs(spark, folder)


_DISTINCT = "qualify row_number() over (partition by pais, region, canal, categoria, display_year, periodo, quantity order by source_row) = 1"
_RUN = f"""
with cleaned as (select * replace ({cleaned_sql("pais")} as pais) from shipments_long),
kept as (select * from cleaned {_DISTINCT}),
parsed as (select source_row, pais as "Country", region as "Region", canal as "Channel", categoria as "Category",
    cast(null as varchar) as "Brand", quantity, {LONG_PERIOD_SQL} as period from kept),
titled as (select * replace (case "Channel" when 'RETAIL' then 'Retail' when 'HORECA' then 'Horeca' when 'E-COMMERCE' then 'E-Commerce' else "Channel" end as "Channel",
    case when "Category" = '5-LOW' then '5-Low' when "Category" = '4-NOT SPECIFIED' then '4-Not Specified' when "Category" = '3-MEDIUM' then '3-Medium'
    when "Category" = '2-HIGH' then '2-High' when "Category" = '1-URGENT' then '1-Urgent' else "Category" end as "Category",
    case when "Region" = 'MIDDLE EAST' then 'Middle East' else "Region"[1] || lower("Region"[2:]) end as "Region",
    'Nation ' || "Country"[8:] as "Country") from parsed),
valid as (select * from titled where period is not null)
"""


def run_long(spark, sf_dir):
    """The whole run over a long-period table: clean, de-duplicate, normalize, pivot, reconcile."""
    source = view(spark, sf_dir, "shipments_long")
    return transform_long(
        source, LONG_MAPPING, "display_year", "periodo", LONG_TARGETS, PERIODS, job_id=1, source_file="shipments_long"
    )


@query("e1_transform_long", _RUN + f"select {_DIMS}, {_FIRST}, min(source_row) as _source_row, {pivot_sql('coalesce(quantity, 0)')} from valid group by {_DIMS}")
def _(spark, sf_dir):
    return run_long(spark, sf_dir).rows.drop("_source_trace")


@query(
    "e1_transform_long_summary",
    _RUN + f""", counts as (select (select count(*) from shipments_long) as input_rows, (select count(*) from (select distinct {_DIMS} from valid) as t) as output_rows,
        cast(0 as bigint) as rows_removed_null, (select count(*) from shipments_long) - (select count(*) from kept) as rows_removed_duplicate,
        cast(0 as bigint) as rows_removed_aggregate, (select count(*) from parsed where period is null) as rows_flagged_invalid_period,
        (select count(*) from shipments_long where quantity is null) as null_cells_in_source)
        select cast(1 as bigint) as job_id, 'shipments_long' as source_file, *,
          rows_removed_duplicate + rows_flagged_invalid_period as total_rows_removed_or_flagged,
          round(output_rows / input_rows * 100, 2) as net_reconciliation_pct,
          rows_removed_duplicate + rows_flagged_invalid_period as total_issues_logged from counts""",
)
def _(spark, sf_dir):
    return run_long(spark, sf_dir).summary.drop("issue_breakdown")


_UNIQUE = "qualify row_number() over (partition by pais, canal, categoria, marca, p1, p2, p3, p4 order by source_row) = 1"
_TITLED = r"""case when X = upper(X) and X <> lower(X) and length(X) > 3
  then list_aggregate(list_transform(regexp_extract_all(X, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '') else X end"""


@query(
    "e1_transform_wide",
    f"""with kept as (select * from shipments_wide {_UNIQUE})
        select {_TITLED.replace("X", "pais")} as "Country", {_TITLED.replace("X", "canal")} as "Channel",
               {_TITLED.replace("X", "categoria")} as "Category", marca as "Brand", source_row as _source_row, {_P_COLUMNS}
        from kept where {_STRICT}""",
)
def _(spark, sf_dir):
    run = transform_wide(view(spark, sf_dir, "shipments_wide"), WIDE_MAPPING, ["Country", "Channel", "Category", "Brand"])
    return run.rows.drop("_source_trace")
