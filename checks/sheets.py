"""Cell tables: header detection, records, and the matrix reshape."""

from pyspark.sql import functions as F

from checks.fixtures import table, view
from checks.registry import query
from checks.scalars import period_sql
from tablesmith.operators.matrix import (
    channel_headers,
    is_result_row,
    looks_like_matrix,
    matrix_to_target,
    matrix_to_wide,
    row_dimensions,
    value_cells,
)
from tablesmith.operators.lookup import lookup_join
from tablesmith.plans.transform import transform_matrix, transform_sheets
from tablesmith.sources.cells import (
    HEADER_WORDS,
    cells_from_lines,
    data_sheets,
    header_names,
    header_rows,
    sheet_records,
    sheet_union,
)

PERIODS = [f"{year}-{month:02d}" for year in range(1995, 2002) for month in range(1, 13)]


@query(
    "s6_cell_scan",
    """select 'orders' as sheet, o_orderkey + 1 as row_idx, unnest([0, 1, 2, 3]) as col_idx,
              unnest([cast(o_orderkey as varchar), cast(o_custkey as varchar), '', o_orderpriority]) as value from orders""",
)
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("sheet"),
        (F.col("o_orderkey") + 1).alias("row_idx"),
        F.concat_ws("\t", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.lit(""), "o_orderpriority").alias("line"),
    )
    return cells_from_lines(lines)


_KG = ["Date", "Category", "Brand", "Segment", "Format", "Retail", "Retail_2", "Column_8", "Retail_3"]
_KG_COLUMNS = ", ".join(f"""max(value) filter (col_idx = {i}) as "{n}\"""" for i, n in enumerate(_KG))


@query(
    "s7_sheet_records",
    f"select cast(row_idx - 4 as bigint) as source_row, {_KG_COLUMNS} from cells where sheet = 'KG' and row_idx > 4 group by row_idx",
)
def _(spark, sf_dir):
    return sheet_records(view(spark, sf_dir, "cells"), "KG", 4)


# A position's name: its header cell, else its number; a taken name gets the least free number.
_TAKEN = "list_contains(list_transform(acc, lambda a: lower(a)), lower({}))"
_NAMES = f"""
select sheet, header_row, unnest(range(len(names))) as col_idx, unnest(names) as name from (
  select sheet, header_row, list_reduce(bases, lambda acc, b: list_append(acc, case when not {_TAKEN.format("b")} then b
      else b || '_' || list_min(list_filter(range(2, len(acc) + 3), lambda n: not {_TAKEN.format("b || '_' || n")})) end),
      ['sheet', 'source_row'])[3:] as names from (
    select p.sheet, p.header_row, list(coalesce(nullif(trim(c.value), ''), 'Column_' || (p.col_idx + 1)) order by p.col_idx) as bases
    from (select sheet, header_row, unnest(range(width)) as col_idx from (
      select sheet, header_row, max(col_idx) + 1 as width from cells join ({{rows}}) as r using (sheet) group by all) as w) as p
    left join cells as c on c.sheet = p.sheet and c.row_idx = p.header_row and c.col_idx = p.col_idx group by all) as b) as n
"""
_FOURTH = "select distinct sheet, cast(4 as int) as header_row from cells"


@query("s8_header_names", f"select sheet, header_row, cast(col_idx as int) as col_idx, name from ({_NAMES.format(rows=_FOURTH)}) as t")
def _(spark, sf_dir):
    return header_names(view(spark, sf_dir, "cells"), 4)


_SCORES = f"""
scores as (select sheet, row_idx, 3 * ({" + ".join(f"cast(contains(t, '{w}') as int)" for w in HEADER_WORDS)}) + n as score from (
  select sheet, row_idx, coalesce(lower(string_agg(trim(value), ' ' order by col_idx) filter (value <> '')), '') as t,
         count(*) filter (value <> '') as n from cells where row_idx <= 12 group by all) as rows_text),
best as (select sheet, row_idx as header_row, score from scores qualify row_number() over (partition by sheet order by score desc, row_idx) = 1)
"""


@query("s12_header_rows", f"with {_SCORES} select * from best")
def _(spark, sf_dir):
    return header_rows(view(spark, sf_dir, "cells"))


@query(
    "s12_detected_header_names",
    f"with {_SCORES} select sheet, header_row, cast(col_idx as int) as col_idx, name from ({_NAMES.format(rows='select sheet, header_row from best')}) as t",
)
def _(spark, sf_dir):
    cells = view(spark, sf_dir, "cells")
    return header_names(cells, header_rows(cells))


# The names of each sheet's columns by the rule for header cells, and for blanks, repeats
# and reserved names.
_SHEETS = {
    "KG": _KG,
    "un": ["Period", "Categoria", "Marca", "Column_4", "Column_5", "Column_6", "Column_7", "Column_8", "Column_9"],
    "LIT": ["Calendar Date", "Brand", "brand_2", "Column_4", "Column_4_2", "Column_6", "Column_7", "Column_8", "Column_9"],
    "Cases": ["Year", "SKU", "SKU_2", "SKU_2_2", "source_row_2", "Sheet_2", "Column_7", "Column_8", "Column_9"],
}
_UNION_NAMES = sorted({n for names in _SHEETS.values() for n in names})
_UNION = ", ".join(
    "max(value) filter ("
    + " or ".join(f"(sheet = '{s}' and col_idx = {names.index(n)})" for s, names in _SHEETS.items() if n in names)
    + f') as "{n}"'
    for n in _UNION_NAMES
)
_SHEET_ROWS = f"""select sheet, cast(row_idx - 4 as bigint) as source_row, {_UNION}
    from cells where lower(sheet) <> 'guide' and row_idx > 4 group by sheet, row_idx"""


@query("s9_sheet_union", _SHEET_ROWS)
def _(spark, sf_dir):
    return sheet_union(view(spark, sf_dir, "cells"), 4)


@query(
    "s9_cells_kept",
    "select sheet, count(value) as cells, count(distinct row_idx) as row_count from cells where lower(sheet) <> 'guide' and row_idx > 4 group by sheet",
)
def _(spark, sf_dir):
    """Every cell below the header is in the result."""
    rows = sheet_union(view(spark, sf_dir, "cells"), 4)
    cells = [F.col(f"`{n}`").isNotNull().cast("bigint") for n in rows.columns if n not in ("sheet", "source_row")]
    return rows.groupBy("sheet").agg(F.sum(sum(cells[1:], cells[0])).alias("cells"), F.count("*").alias("row_count"))


_KG_SOUTH = ["Date", "Category", "Marke", *_KG[3:]]


@query(
    "s7_sheet_records_workbooks",
    f"""select file, cast(row_idx - 4 as bigint) as source_row,
        {", ".join(f"""max(value) filter (col_idx = {i} and file = 'north.xlsx') as "{n}\"""" if n == "Brand" else f"""max(value) filter (col_idx = {i}) as "{n}\"""" for i, n in enumerate(_KG))},
        max(value) filter (col_idx = 2 and file = 'south.xlsx') as "Marke"
        from book_cells where sheet = 'KG' and row_idx > 4 group by file, row_idx""",
)
def _(spark, sf_dir):
    return sheet_records(view(spark, sf_dir, "book_cells"), "KG", 4)


_LATE = ", ".join(f"""coalesce(nullif(trim(max(value) filter (row_idx = 20 and col_idx = {i})), ''), 'Column_{i + 1}') as n{i}""" for i in range(5))


@query(
    "s8_late_header_names",
    f"""select sheet, 20 as header_row, unnest(range(5))::int as col_idx, unnest([n0, n1, n2, n3, n4]) as name from (
        select sheet, {_LATE} from cells where lower(sheet) <> 'guide' group by sheet) as t""",
)
def _(spark, sf_dir):
    """A table of header rows beyond the rows that are searched for one."""
    cells = data_sheets(view(spark, sf_dir, "cells")).where("col_idx < 5")
    return header_names(cells, cells.select("sheet").distinct().withColumn("header_row", F.lit(20)))


def _blank(name: str) -> str:
    return f"""nullif(trim(regexp_replace("{name}", '\\s+', ' ', 'g')), '')"""


_FILLED = " + ".join(f'cast("{n}" is not null as int)' for n in _UNION_NAMES)
_ALL = ", ".join(f'"{n}"' for n in _UNION_NAMES)
# Rows of all sheets with their verdicts: the sheet takes part in the duplicate test only.
_SHEET_RUN = f"""
with plain as ({_SHEET_ROWS}),
clean as (select sheet, source_row, {", ".join(f'{_blank(n)} as "{n}"' for n in _UNION_NAMES)} from plain),
tagged as (select *, case when {_FILLED} = 0 then 'NULL_ROW_REMOVED' when {_FILLED} <= {max(2, len(_UNION_NAMES) // 3)}
    and regexp_matches(concat_ws(' ', {_ALL}), '(?i)\\b(Result|Subtotal|Grand Total|Total)\\b') then 'AGGREGATE_ROW' end as tag from clean),
judged as (select *, coalesce(tag, case when row_number() over (partition by sheet, tag, {_ALL} order by source_row) > 1 then 'DUPLICATE_REMOVED'
    when regexp_matches(concat_ws(' ', {_ALL}), '(?i)\\b(Result|Subtotal|Total)\\b') then 'AGGREGATE_ROW' else 'KEPT' end) as verdict from tagged)
"""
_SHEET_MAPPING = {"Category": "Category", "Brand": "Brand", "SKU": "SKU"}


def _run_sheets(spark, sf_dir):
    """Orders without their own numbers repeat, so that sheets have equal rows."""
    return transform_sheets(view(spark, sf_dir, "cells"), _SHEET_MAPPING, 4, required=["Brand"], field_kinds={n: "as_is" for n in _UNION_NAMES})


@query("e1_transform_sheets", _SHEET_RUN + """select sheet as _sheet, source_row as _source_row, "Brand" from judged where verdict = 'KEPT'""")
def _(spark, sf_dir):
    return _run_sheets(spark, sf_dir).rows.drop("_source_trace")


@query("e1_transform_sheets_issues", _SHEET_RUN + "select sheet, source_row, verdict as issue_type from judged where verdict <> 'KEPT'")
def _(spark, sf_dir):
    return _run_sheets(spark, sf_dir).issues.drop("detail")


@query(
    "e1_transform_sheets_balance",
    _SHEET_RUN + """select count(*) as input_rows, count(*) filter (verdict = 'KEPT') as kept, count(*) filter (verdict <> 'KEPT') as removed,
        true as balanced from judged""",
)
def _(spark, sf_dir):
    run = _run_sheets(spark, sf_dir)
    counts = run.summary.select("input_rows", F.col("output_rows").alias("kept"), F.col("total_rows_removed_or_flagged").alias("removed"))
    return counts.withColumn("balanced", F.expr("kept + removed = input_rows"))


_BOOK_SHEETS = {
    **{("north.xlsx", sheet): names for sheet, names in _SHEETS.items()},
    ("south.xlsx", "KG"): _KG_SOUTH,
    ("south.xlsx", "un"): ["Marke" if n == "Marca" else n for n in _SHEETS["un"]],
}
_BOOK_NAMES = sorted({n for names in _BOOK_SHEETS.values() for n in names})
_BOOK_UNION = ", ".join(
    "max(value) filter ("
    + " or ".join(f"(file = '{f}' and sheet = '{s}' and col_idx = {names.index(n)})" for (f, s), names in _BOOK_SHEETS.items() if n in names)
    + f') as "{n}"'
    for n in _BOOK_NAMES
)
_BOOK_FILLED = " + ".join(f'cast("{n}" is not null as int)' for n in _BOOK_NAMES)
_BOOK_ALL = ", ".join(f'"{n}"' for n in _BOOK_NAMES)
_BOOK_RUN = f"""
with plain as (select file, sheet, cast(row_idx - 4 as bigint) as source_row, {_BOOK_UNION}
    from book_cells where lower(sheet) <> 'guide' and row_idx > 4 group by file, sheet, row_idx),
clean as (select file, sheet, source_row, {", ".join(f'{_blank(n)} as "{n}"' for n in _BOOK_NAMES)} from plain),
tagged as (select *, case when {_BOOK_FILLED} = 0 then 'NULL_ROW_REMOVED' when {_BOOK_FILLED} <= {max(2, len(_BOOK_NAMES) // 3)}
    and regexp_matches(concat_ws(' ', {_BOOK_ALL}), '(?i)\\b(Result|Subtotal|Grand Total|Total)\\b') then 'AGGREGATE_ROW' end as tag from clean),
judged as (select *, coalesce(tag, case when row_number() over (partition by file, sheet, tag, {_BOOK_ALL} order by source_row) > 1 then 'DUPLICATE_REMOVED'
    when regexp_matches(concat_ws(' ', {_BOOK_ALL}), '(?i)\\b(Result|Subtotal|Total)\\b') then 'AGGREGATE_ROW' else 'KEPT' end) as verdict from tagged)
"""


def _run_books(spark, sf_dir):
    kinds = {n: "as_is" for n in _BOOK_NAMES}
    return transform_sheets(view(spark, sf_dir, "book_cells"), _SHEET_MAPPING, 4, required=["Category", "Brand"], field_kinds=kinds)


@query("e1_transform_workbooks", _BOOK_RUN + """select file as _file, sheet as _sheet, source_row as _source_row, "Category", "Brand" from judged where verdict = 'KEPT'""")
def _(spark, sf_dir):
    return _run_books(spark, sf_dir).rows.drop("_source_trace")


@query(
    "e1_transform_workbooks_issues",
    _BOOK_RUN + """select file, sheet, source_row, verdict as issue_type, case verdict when 'NULL_ROW_REMOVED' then 'Entirely blank row removed'
        when 'DUPLICATE_REMOVED' then 'Exact duplicate row removed' else 'Subtotal/Result/Total row excluded' end as detail from judged where verdict <> 'KEPT'""",
)
def _(spark, sf_dir):
    return _run_books(spark, sf_dir).issues


@query(
    "e1_transform_workbooks_balance",
    _BOOK_RUN + """select count(*) as input_rows, count(*) filter (verdict = 'KEPT') as kept, count(*) filter (verdict <> 'KEPT') as issues,
        true as balanced from judged""",
)
def _(spark, sf_dir):
    """Each row of each workbook is kept or logged, once."""
    run = _run_books(spark, sf_dir)
    counts = run.summary.select("input_rows", F.col("output_rows").alias("kept"), F.col("total_issues_logged").alias("issues"))
    return counts.withColumn("balanced", F.expr("kept + issues = input_rows"))


_ROWS = f"""
dims as (select sheet, row_idx, max(value) filter (col_idx = 0) as date_text, max(value) filter (col_idx = 1) as category,
   max(value) filter (col_idx = 2) as brand, max(value) filter (col_idx = 3) as segment, max(value) filter (col_idx = 4) as format
   from cells where lower(sheet) <> 'guide' and row_idx >= 5 group by all),
dated as (select *, {period_sql("date_text")} as period from dims where lower(trim(category)) <> 'result' and date_text <> ''),
heads as (select sheet, col_idx, nullif(trim(value), '') as channel from cells where row_idx = 1),
filled as (select * from cells where lower(sheet) <> 'guide' and row_idx >= 5 and col_idx >= 5 and value <> '')
"""


_MATRIX_ISSUES = f"""with {_ROWS} select sheet, cast(row_idx as bigint) as source_row, 'AGGREGATE_ROW' as issue_type, 'Result row excluded from atomic output' as detail
        from dims where lower(trim(category)) = 'result'
        union all select f.sheet, f.row_idx, 'INVALID_FACT', 'Could not parse a number' from filled as f join dated as d using (sheet, row_idx)
        where try_cast(f.value as double) is null"""


@query(
    "p9_result_rows",
    _MATRIX_ISSUES,
)
def _(spark, sf_dir):
    return matrix_to_target(view(spark, sf_dir, "cells")).issues


@query("p9_kept_rows", f"with {_ROWS} select * exclude (period) from dated")
def _(spark, sf_dir):
    rows = row_dimensions(data_sheets(view(spark, sf_dir, "cells")))
    return rows.where(~is_result_row(F.col("category")) & (F.col("date_text") != ""))


@query("p10_filled_values", f"with {_ROWS} select * from filled")
def _(spark, sf_dir):
    return value_cells(data_sheets(view(spark, sf_dir, "cells")))


@query(
    "j1_header_lookup",
    f"""with {_ROWS} select f.sheet, f.row_idx, f.col_idx, f.value, h.channel, d.category, d.brand
        from filled as f join dims as d using (sheet, row_idx) left join heads as h using (sheet, col_idx)""",
)
def _(spark, sf_dir):
    cells = data_sheets(view(spark, sf_dir, "cells"))
    rows = row_dimensions(cells).select("sheet", "row_idx", "category", "brand")
    values = value_cells(cells).join(rows, ["sheet", "row_idx"])
    return lookup_join(values, channel_headers(cells), ["sheet", "col_idx"], F.col("row_idx"), "left")


@query(
    "j1_header_lookup_salted",
    """with channels as materialized (select sheet, col_idx, nullif(trim(max(value)), '') as channel from cells where row_idx = 1 group by sheet, col_idx),
        values_ as materialized (select sheet, row_idx, col_idx, value from cells where lower(sheet) <> 'guide' and row_idx >= 5 and col_idx >= 5 and value <> '')
        select v.sheet, v.row_idx, v.col_idx, v.value, c.channel
        from values_ as v left join channels as c on c.sheet = v.sheet and c.col_idx = v.col_idx""",
)
def _(spark, sf_dir):
    cells = data_sheets(view(spark, sf_dir, "cells"))
    return lookup_join(value_cells(cells), channel_headers(cells), ["sheet", "col_idx"], F.col("row_idx"), "left", max_bytes=0)


_TARGET = """f.sheet, cast(null as varchar) as "Country", cast(null as varchar) as "Region", channel as "Channel", cast(null as varchar) as "City/State",
   category as "Category", brand as "Brand", coalesce(nullif(format, ''), segment) as "SKU",
   case upper(f.sheet) when 'KG' then 'KG' when 'UN' then 'UN' when 'LIT' then 'LT' else f.sheet end as "Fact" """
_TRACE = """'{"Category":"B","Brand":"C","SKU":"' || case when nullif(format, '') is null then 'D' else 'E' end || '","Channel":"' || chr(cast(65 + f.col_idx as int))
   || ' header rows 1","Fact":"' || case upper(f.sheet) when 'KG' then 'KG' when 'UN' then 'UN' when 'LIT' then 'LT' else f.sheet end || ' sheet"}' as _source_trace"""
_FROM = "from filled as f join dated as d using (sheet, row_idx) left join heads as h using (sheet, col_idx)"


@query(
    "r3_matrix_to_target",
    f"""with {_ROWS} select {_TARGET}, period, try_cast(value as double) as value, cast(f.row_idx as bigint) as _source_row, f.col_idx as _source_column, {_TRACE} {_FROM}""",
)
def _(spark, sf_dir):
    return matrix_to_target(view(spark, sf_dir, "cells")).rows


_BOOK_ROWS = _ROWS.replace("from cells", "from book_cells").replace("select sheet,", "select file, sheet,")
_BOOK_FROM = "from filled as f join dated as d using (file, sheet, row_idx) left join heads as h using (file, sheet, col_idx)"


@query(
    "r3_two_workbooks",
    f"""with {_BOOK_ROWS} select f.file, {_TARGET}, period, try_cast(value as double) as value, cast(f.row_idx as bigint) as _source_row, f.col_idx as _source_column, {_TRACE} {_BOOK_FROM}""",
)
def _(spark, sf_dir):
    return matrix_to_target(view(spark, sf_dir, "book_cells")).rows


@query(
    "p9_result_rows_workbooks",
    f"""with {_BOOK_ROWS} select file, sheet, cast(row_idx as bigint) as source_row, 'AGGREGATE_ROW' as issue_type, 'Result row excluded from atomic output' as detail
        from dims where lower(trim(category)) = 'result'
        union all select f.file, f.sheet, f.row_idx, 'INVALID_FACT', 'Could not parse a number' from filled as f join dated as d using (file, sheet, row_idx)
        where try_cast(f.value as double) is null""",
)
def _(spark, sf_dir):
    return matrix_to_target(view(spark, sf_dir, "book_cells")).issues


@query(
    "e1_transform_matrix_workbooks",
    f"""with {_BOOK_ROWS} select (select cast(sum(h - 4) as bigint) from (select max(row_idx) as h from book_cells where lower(sheet) <> 'guide' group by file, sheet) as t) as input_rows,
        (select count(*) {_BOOK_FROM}) as output_rows, (select count(*) from dims where lower(trim(category)) = 'result') as rows_removed_aggregate""",
)
def _(spark, sf_dir):
    run = transform_matrix(view(spark, sf_dir, "book_cells"), periods=PERIODS)
    return run.summary.select("input_rows", "output_rows", "rows_removed_aggregate")


_WIDE = ", ".join(f"""case when period = '{p}' then try_cast(value as double) end as "{p}\"""" for p in PERIODS)


@query(
    "r3_matrix_wide",
    f"""with {_ROWS} select {_TARGET}, cast(f.row_idx as bigint) as _source_row, f.col_idx as _source_column, {_TRACE}, {_WIDE} {_FROM}""",
)
def _(spark, sf_dir):
    return matrix_to_wide(matrix_to_target(view(spark, sf_dir, "cells")).rows, PERIODS)


@query(
    "e1_transform_matrix",
    f"""with {_ROWS} select {_TARGET}, cast(f.row_idx as bigint) as _source_row, f.col_idx as _source_column, {_TRACE}, {_WIDE} {_FROM}""",
)
def _(spark, sf_dir):
    return transform_matrix(view(spark, sf_dir, "cells"), periods=PERIODS).rows


_SOME = PERIODS[: len(PERIODS) // 2]


@query(
    "e1_transform_matrix_issues",
    _MATRIX_ISSUES + f""" union all select sheet, cast(f.row_idx as bigint), 'UNLISTED_PERIOD', 'Period is not among the requested ones'
        from filled as f join dated as d using (sheet, row_idx) where period not in ({", ".join(f"'{p}'" for p in _SOME)})""",
)
def _(spark, sf_dir):
    return transform_matrix(view(spark, sf_dir, "cells"), periods=_SOME).issues


@query(
    "e1_transform_matrix_summary",
    f"""with {_ROWS} select (select cast(sum(h - 4) as bigint) from (select max(row_idx) as h from cells where lower(sheet) <> 'guide' group by sheet) as t) as input_rows,
        (select count(*) {_FROM}) as output_rows, (select count(*) from dims where lower(trim(category)) = 'result') as rows_removed_aggregate""",
)
def _(spark, sf_dir):
    run = transform_matrix(view(spark, sf_dir, "cells"), periods=PERIODS)
    return run.summary.select("input_rows", "output_rows", "rows_removed_aggregate")


_TEXT_ROW = lambda r: f"(count(*) filter (row_idx = {r} and value <> '') > 0 and count(*) filter (row_idx = {r} and value <> '' and try_cast(value as double) is not null) = 0)"


MATRIX_SHEETS = f"""select sheet, max(row_idx) >= 5 and (count(*) filter (col_idx = 1 and row_idx <= 8 and lower(trim(value)) in ('result', 'total', 'subtotal')) >= 1
        or {" + ".join(f"cast({_TEXT_ROW(r)} as int)" for r in range(1, 5))} >= 3) as looks_matrix from cells group by sheet"""


@query("m8_looks_like_matrix", MATRIX_SHEETS)
def _(spark, sf_dir):
    return looks_like_matrix(view(spark, sf_dir, "cells"))
