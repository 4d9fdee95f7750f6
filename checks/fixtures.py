"""Business-like views over the driver's tables, for Spark and for DuckDB.

Most views are one SELECT that both engines read alike. They are built on whole tables:
``o_orderkey``, ``event_id`` and ``doc_id`` are unique and serve as row numbers, and their
remainders decide which kind of noise a row carries. ``nation`` and ``region`` have a fixed
number of rows whatever the scale.
"""

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablesmith.session import compute_once

NBSP, EM_SPACE, FI, WIDE_ONE = chr(0xA0), chr(0x2003), chr(0xFB01), chr(0xFF11)

_CASE = lambda expr, values: "case " + expr + " " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"
_FULL = ["", "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
FULL_MONTH = _CASE("cast(month(o_orderdate) as int)", _FULL)
SHORT_MONTH = _CASE("cast(month(o_orderdate) as int)", [m[:3] for m in _FULL])
YEAR = "cast(year(o_orderdate) as varchar(4))"
MONTH = "cast(month(o_orderdate) as varchar(2))"
DAY = "cast(day(o_orderdate) as varchar(2))"
MONTH2 = f"lpad({MONTH}, 2, '0')"
CANAL = _CASE("cast(o_custkey % 5 as int)", ["RETAIL", "HORECA", "E-COMMERCE", "Wholesale", "Club"])
KEY = "cast(o_custkey as varchar(20))"

_NATION = "join nation on n_nationkey = o_custkey % 25 join region on r_regionkey = n_regionkey"

SHIPMENTS_LONG = f"""
select o_orderkey as source_row,
       concat(case when o_orderkey % 3 = 0 then '  ' else '' end, replace(n_name, '_', '   '),
              case when o_orderkey % 4 = 1 then ' ' else '' end) as pais,
       r_name as region, {CANAL} as canal, o_orderpriority as categoria,
       cast(year(o_orderdate) as int) as display_year,
       case when o_orderkey % 50 = 7 then 'P13' else concat('P', {MONTH2}) end as periodo,
       case when o_orderkey % 50 = 8 then null
            when o_orderstatus = 'F' then 1.0e0 * (0 - o_custkey % 100) else 1.0e0 * (o_custkey % 100) end as quantity
from orders {_NATION}
"""

DIRTY_ORDERS = f"""
select o_orderkey as source_row,
       case when o_orderkey % 20 = 0 then '   ' when o_orderkey % 20 = 1 then 'Grand Total'
            when o_orderkey % 20 = 2 then 'dup' else concat('  ', n_name, ' ') end as pais,
       case when o_orderkey % 20 <= 1 then null when o_orderkey % 20 = 2 then 'WEB' else {CANAL} end as canal,
       case when o_orderkey % 20 <= 1 then '' when o_orderkey % 20 = 2 then 'dup' else o_orderpriority end as categoria,
       case when o_orderkey % 20 = 0 then null when o_orderkey % 20 = 2 then '0'
            when o_orderkey % 20 = 3 then concat('(', {KEY}, ')')
            when o_orderkey % 20 = 4 then concat(' ', {KEY}, ' ') when o_orderkey % 20 = 5 then 'n/a'
            else {KEY} end as quantity,
       case when o_orderkey % 20 <= 1 then null when o_orderkey % 20 = 2 then 'x'
            when o_orderkey % 20 = 4 then concat('U', {KEY}, '@EXAMPLE.COM ') else 'a@b.co' end as email
from orders {_NATION}
"""

CONTACTS = f"""
select o_orderkey as source_row,
       case when o_orderkey % 7 = 0 then upper(n_name) when o_orderkey % 7 = 1 then 'O''NEIL-FOODS'
            when o_orderkey % 7 = 2 then 'USA' else lower(r_name) end as cliente,
       case when o_orderkey % 9 = 0 then null
            when o_orderkey % 9 = 1 then concat('  USER', {KEY}, '@Example.COM ')
            when o_orderkey % 9 = 2 then concat('user', {KEY}) else concat('u', {KEY}, '@b.co') end as email,
       case when o_orderkey % 8 = 0 then '   ' when o_orderkey % 8 = 1 then 'none'
            else concat(' +1 (555) ', {KEY}, '-', cast(o_orderkey as varchar(20))) end as phone,
       case when o_orderkey % 6 = 0 then concat({MONTH}, '/', {DAY}, '/', {YEAR})
            when o_orderkey % 6 = 1 then concat({DAY}, '.', {MONTH}, '.', {YEAR}) when o_orderkey % 6 = 2 then 'soon'
            else concat({YEAR}, '-', {MONTH}, '-', {DAY}) end as order_date,
       case when o_orderkey % 5 = 0 then concat('(', {KEY}, ')') when o_orderkey % 5 = 1 then 'n/a'
            else {KEY} end as quantity
from orders {_NATION}
"""

SHIPMENTS_WIDE = f"""
select o_orderkey as source_row, n_name as pais, {CANAL} as canal,
       case when o_orderkey % 40 = 9 then 'Subtotal' when o_orderkey % 40 = 10 then 'Totals'
            else o_orderpriority end as categoria,
       case when o_orderkey % 30 = 11 then 'Total Fresh' else concat('Brand ', cast(o_custkey % 12 as varchar(2))) end as marca,
       case when o_orderkey % 6 = 0 then null else 1.0e0 * (o_custkey % 100) end as p1,
       case when o_orderkey % 6 = 1 then 0.0e0 else 1.0e0 * (0 - o_custkey % 70) end as p2,
       1.0e0 * (o_orderkey % 90) as p3,
       case when o_orderkey % 4 = 2 then null else 1.0e0 * (o_orderkey % 11) end as p4
from orders {_NATION}
"""
# The headers of p1 .. p4: one per style, and the month each stands for.
WIDE_HEADERS = {"p1": "c1997 Jan", "p2": "02.1997", "p3": "March/1997", "p4": "1997-4"}

PERIOD_TEXTS = f"""
select o_orderkey as id,
       case cast(o_orderkey % 18 as int)
         when 0 then concat({YEAR}, '-', {MONTH}, '-', {DAY}) when 1 then concat({MONTH2}, '/', {DAY}, '/', {YEAR})
         when 2 then concat({DAY}, '/', {MONTH}, '/', {YEAR}) when 3 then concat({DAY}, '.', {MONTH}, '.', {YEAR})
         when 4 then concat({FULL_MONTH}, '/', {YEAR}) when 5 then concat(upper({SHORT_MONTH}), ' ', {YEAR})
         when 6 then concat('c', {YEAR}, ' ', {SHORT_MONTH}) when 7 then concat({MONTH2}, '.', {YEAR})
         when 8 then concat('P', {MONTH}) when 9 then concat({YEAR}, '-', {MONTH}) when 10 then 'n/a'
         when 11 then concat({YEAR}, '/', {MONTH}) when 12 then concat(lower({FULL_MONTH}), ' ', {YEAR})
         when 13 then concat({YEAR}, '-02-31') when 14 then concat({SHORT_MONTH}, '/', {YEAR}) when 15 then {MONTH}
         when 16 then concat('c', {YEAR}, ' ', {FULL_MONTH}) when 17 then concat('13.', {YEAR}) end as s
from orders
"""

_PRICE = "cast(cast(o_totalprice as decimal(18,2)) as varchar(30))"
NUMERIC_TEXTS = f"""
select o_orderkey as id,
       case cast(o_orderkey % 20 as int)
         when 0 then concat('1,', lpad(cast(o_custkey % 1000 as varchar(3)), 3, '0'), '.50') when 1 then concat('(', {KEY}, ')')
         when 2 then concat('$-', {KEY}) when 3 then concat('-', {KEY}) when 4 then '0' when 5 then concat({KEY}, '%')
         when 6 then concat({KEY}, ')') when 7 then concat('-$', {KEY}) when 8 then concat('($', {KEY}, ')')
         when 9 then concat('$(', {KEY}, ')') when 10 then concat('(', {KEY}, ')%') when 11 then concat('.', {KEY})
         when 12 then '1e5' when 13 then ',' when 14 then '-' when 15 then 'nan' when 16 then concat(' ', {_PRICE}, ' ')
         when 17 then concat('{chr(0x20AC)} ', {_PRICE}) when 18 then concat({KEY}, ' units') else {_PRICE} end as s
from orders
"""

TEXT_NOISE = f"""
select o_orderkey as id,
       case cast(o_orderkey % 10 as int)
         when 0 then concat('  ', n_name, '   ', o_orderpriority, ' ') when 1 then concat(n_name, '{NBSP}{EM_SPACE}', r_name, '{NBSP}')
         when 2 then concat('of{FI}ce ', {KEY}) when 3 then concat('{WIDE_ONE}', {KEY}) when 4 then '    '
         when 5 then concat(n_name, chr(7), {KEY}, chr(31)) when 6 then concat(n_name, chr(9), chr(10), {KEY})
         when 7 then upper(concat(r_name, '''s best-', {KEY})) when 8 then 'USA' else concat(r_name, ' ', o_orderpriority) end as s
from orders {_NATION}
"""

JOB_RUNS = """
select event_id as id, concat(event_type, '_', cast(event_id as varchar(20)), '.csv') as filename,
       case cast(event_id % 3 as int) when 0 then 'SPARK' when 1 then '' end as engine,
       case cast(event_id % 5 as int) when 0 then 'FAILED' when 1 then 'RUNNING' else 'COMPLETED' end as status,
       cast(floor(value * 10) as bigint) as row_count,
       case when event_id % 7 = 0 then null else cast(floor(value * 9) as bigint) end as output_rows,
       cast(user_id % 13 as bigint) as null_count, cast(user_id % 17 as bigint) as issue_count,
       case when event_id % 6 = 0 then null else (event_id % 100) / 100.0e0 end as confidence
from events
"""

# Matrix data rows: one per order, spread over four sheets; the cells of a row as c0 .. c8.
_MATRIX_ROWS = f"""
select {_CASE("cast(o_orderkey % 4 as int)", ["KG", "un", "LIT", "Cases"])} as sheet,
       cast(floor(o_orderkey / 4.0e0) as int) + 5 as row_idx,
       case cast(o_orderkey % 6 as int)
         when 0 then concat('c', {YEAR}, ' ', {SHORT_MONTH}) when 1 then concat({MONTH2}, '.', {YEAR})
         when 2 then concat({FULL_MONTH}, '/', {YEAR}) when 3 then concat({YEAR}, '-', {MONTH}) when 4 then concat({YEAR}, '/', {MONTH})
         end as c0,
       case when o_orderkey % 20 = 3 then ' RESULT' else o_orderpriority end as c1,
       concat('Brand ', cast(o_custkey % 12 as varchar(2))) as c2, n_name as c3,
       case when o_orderkey % 3 = 0 then '' when o_orderkey % 3 = 1 then null else concat('Pack ', cast(o_custkey % 6 as varchar(2))) end as c4,
       cast(o_custkey % 100 as varchar(3)) as c5,
       case when o_orderkey % 11 = 0 then '' when o_orderkey % 13 = 0 then null else cast(o_custkey % 50 as varchar(3)) end as c6,
       concat('-', cast(o_custkey % 30 + 1 as varchar(3))) as c7, case when o_orderkey % 9 = 4 then 'n/a' else '0' end as c8
from orders {_NATION}
"""
_MATRIX_HEADS = """
select * from (values
  ('KG',1,1,'Market'),('KG',1,5,' Retail '),('KG',1,6,'Retail'),('KG',1,7,'Web'),('KG',1,8,''),('KG',2,5,'North'),('KG',2,6,'South'),
  ('KG',4,0,'Date'),('KG',4,1,'Category'),('KG',4,2,'Brand'),('KG',4,3,'Segment'),('KG',4,4,'Format'),('KG',4,5,'Retail'),
  ('KG',4,6,'Retail'),('KG',4,7,''),('KG',4,8,'Retail'),
  ('un',1,5,'Club'),('un',1,6,'Horeca'),('un',1,8,'Other'),('un',4,0,'Period'),('un',4,1,'Categoria'),('un',4,2,'Marca'),
  ('LIT',1,5,'Web'),('LIT',1,6,'Web'),('LIT',1,7,'Club'),('LIT',4,0,'Calendar Date'),('LIT',4,1,'Brand'),('LIT',4,2,'brand'),
  ('LIT',4,4,'Column_4'),('Cases',1,5,'Kiosk'),('Cases',1,6,'Kiosk'),('Cases',2,5,'East'),('Cases',3,6,'West'),('Cases',4,0,'Year'),
  ('Cases',4,1,'SKU'),('Cases',4,2,'SKU'),('Cases',4,3,'SKU_2'),('Cases',4,4,'source_row'),('Cases',4,5,'Sheet')
) as heads(sheet, row_idx, col_idx, value)
union all
select case when n_regionkey % 2 = 0 then 'Guide' else 'GUIDE' end, n_nationkey + 1, 0, concat('Fill in ', n_name) from nation
"""
CELL_NAMES = [f"c{i}" for i in range(9)]
CELLS = f"""
select sheet, row_idx, col_idx, value from ({_MATRIX_HEADS}) as matrix_heads
union all
select sheet, row_idx, cast(unnest(range(9)) as int) as col_idx, unnest([{", ".join(CELL_NAMES)}]) as value from ({_MATRIX_ROWS}) as matrix_rows
"""

# Two workbooks with sheets of one name, whose headers differ in one column and one channel.
BOOK_CELLS = f"""
select 'north.xlsx' as file, sheet, row_idx, col_idx, value from ({CELLS}) as north
union all
select 'south.xlsx', sheet, row_idx, col_idx,
       case when row_idx = 4 and col_idx = 2 then 'Marke' when row_idx = 1 and col_idx = 5 then 'Kiosk' else value end
from ({CELLS}) as south where sheet in ('KG', 'un')
"""

# Columns of five kinds of file, and the kind of sample values each column has.
_LAYOUTS = """
(values
  (0,0,'Pais','text'),(0,1,'Canal','text'),(0,2,'Categoria','text'),(0,3,'Marca','text'),(0,4,'Display Year','year'),
  (0,5,'Periodo','month'),(0,6,'Quantity','number'),
  (1,0,'Country Name','text'),(1,1,'Trade Channel','text'),(1,2,'Global Category','text'),(1,3,'c2025 Jan','number'),
  (1,4,'c2025 Feb','number'),(1,5,'March/2025','number'),(1,6,'P04','number'),
  (2,0,'Regn','text'),(2,1,'Citty','text'),(2,2,'Brand','text'),(2,3,'Brand','text'),(2,4,'Anything','number'),(2,5,'???','text'),
  (3,0,'Fiscal','year'),(3,1,'Cycle','month'),(3,2,'Product Description','text'),(3,3,'Total Sales','number'),(3,4,'State Region','text'),
  (4,0,'Month','month'),(4,1,'Year/Month','month'),(4,2,'Customer','text'),(4,3,'Jan 2024','number'),(4,4,'Feb_2024','number'),
  (4,5,'Market Zone','text'),(4,6,'Volume (tons)','number')
) as layouts(layout, col_pos, col_name, kind)
"""
_CATALOG_ROWS = f"""
select concat('file_', cast(doc_id as varchar(20)), '.csv') as file, 'data' as sheet, col_pos, col_name,
       case kind when 'year' then cast(1990 + doc_id % 40 as varchar(4)) when 'month' then concat('P', cast(doc_id % 12 + 1 as varchar(2)))
                 when 'number' then concat('1,', lpad(cast(doc_id % 1000 as varchar(3)), 3, '0')) else concat('Item ', lang) end as s1,
       case kind when 'year' then '2,024' when 'month' then 'p7' when 'number' then concat('$', cast(doc_id % 90 as varchar(3))) else source end as s2,
       case kind when 'year' then '2025.0' when 'month' then '11' when 'number' then '-1.5e3' else '' end as s3,
       case when doc_id % 3 = 0 then null when kind = 'number' then 'n/a' else 'x' end as s4
from documents join {_LAYOUTS} on layout = doc_id % 5
"""
COLUMN_CATALOG = f"select file, sheet, col_pos, col_name, [s1, s2, s3, s4] as sample from ({_CATALOG_ROWS}) as catalog_rows"

VIEWS = {
    "shipments_long": SHIPMENTS_LONG,
    "dirty_orders": DIRTY_ORDERS,
    "contacts": CONTACTS,
    "shipments_wide": SHIPMENTS_WIDE,
    "period_texts": PERIOD_TEXTS,
    "numeric_texts": NUMERIC_TEXTS,
    "text_noise": TEXT_NOISE,
    "job_runs": JOB_RUNS,
    "cells": CELLS,
    "book_cells": BOOK_CELLS,
    "column_catalog": COLUMN_CATALOG,
}
_TABLES = ["region", "nation", "orders", "events", "documents"]


def with_fixtures(sql: str) -> str:
    """DuckDB text with the views it names put in front."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    views = ", ".join(f"{n} as ({VIEWS[n]})" for n in used)
    body = sql.strip()
    if not views:
        return body
    if body.lower().startswith("with recursive"):
        return f"with recursive {views}, {body[len('with recursive'):]}"
    return f"with {views}, {body[4:]}" if body.lower().startswith("with") else f"with {views} {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _select(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The view's rows; its columns are computed once, as if read from a file."""
    used = {n: table(spark, sf_dir, n) for n in _TABLES if re.search(rf"\b{n}\b", sql)}
    text = re.sub(rf"\b(from|join) ({'|'.join(_TABLES)})\b", r"\1 {\2}", sql)
    df = spark.sql(text, **used)
    return compute_once(df, [F.col(n) for n in df.columns])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a Spark DataFrame."""
    if name == "cells":
        rows = _select(spark, sf_dir, _MATRIX_ROWS)
        cells = F.posexplode(F.array(*CELL_NAMES)).alias("col_idx", "value")
        return rows.select("sheet", "row_idx", cells).unionByName(_select(spark, sf_dir, _MATRIX_HEADS))
    if name == "book_cells":
        north = view(spark, sf_dir, "cells")
        marke = (F.col("row_idx") == 4) & (F.col("col_idx") == 2)
        kiosk = (F.col("row_idx") == 1) & (F.col("col_idx") == 5)
        value = F.when(marke, "Marke").when(kiosk, "Kiosk").otherwise(F.col("value"))
        south = north.where("sheet in ('KG', 'un')").withColumn("value", value)
        return north.select(F.lit("north.xlsx").alias("file"), "*").unionByName(south.select(F.lit("south.xlsx").alias("file"), "*"))
    if name == "column_catalog":
        rows = _select(spark, sf_dir, _CATALOG_ROWS)
        return rows.select("file", "sheet", "col_pos", "col_name", F.array("s1", "s2", "s3", "s4").alias("sample"))
    df = _select(spark, sf_dir, VIEWS[name])
    return df.withColumnsRenamed(WIDE_HEADERS) if name == "shipments_wide" else df
