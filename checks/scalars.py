"""Scalar rules over text views and over whole documents."""

import re

from pyspark.sql import functions as F

from checks.fixtures import EM_SPACE, FI, NBSP, WIDE_ONE, table, view
from checks.registry import query
from tablesmith.functions import dates, numbers, similarity, text
from tablesmith.operators.cleaning import clean_fields
from tablesmith.operators.matrix import unit_code
from tablesmith.operators.reshape import provenance_columns
from tablesmith.schema import TARGET_COLUMNS

WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
# The compatibility characters that the text view holds, and what they stand for.
_COMPAT = f"replace(replace(replace(replace(s, '{FI}', 'fi'), '{WIDE_ONE}', '1'), '{NBSP}', ' '), '{EM_SPACE}', ' ')"
_CLEAN = f"nullif(trim(regexp_replace(regexp_replace({_COMPAT}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '{WS}', ' ', 'g')), '')"


@query("c1_clean_value", f"select id, {_CLEAN} as cleaned from text_noise")
def _(spark, sf_dir):
    return view(spark, sf_dir, "text_noise").select("id", text.clean_value(F.col("s")).alias("cleaned"))


@query("c1_clean_value_documents", f"select doc_id, nullif(trim(regexp_replace(nfc_normalize(text), '{WS}', ' ', 'g')), '') as cleaned from documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_value(F.col("text")).alias("cleaned"))


@query("c2_nfkc", f"select id, {_COMPAT} as normalized from text_noise")
def _(spark, sf_dir):
    return view(spark, sf_dir, "text_noise").select("id", text.nfkc(F.col("s")).alias("normalized"))


@query("c3_strip_controls", r"select id, regexp_replace(s, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') as stripped from text_noise")
def _(spark, sf_dir):
    return view(spark, sf_dir, "text_noise").select("id", text.strip_controls(F.col("s")).alias("stripped"))


@query("c4_collapse_whitespace", f"select page_id, trim(regexp_replace(html, '{WS}', ' ', 'g')) as collapsed from pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.collapse_whitespace(F.col("html")).alias("collapsed"))


@query("c5_normalize_phone", "select source_row, regexp_replace(nullif(trim(phone), ''), '[^0-9+]', '', 'g') as phone from contacts")
def _(spark, sf_dir):
    return view(spark, sf_dir, "contacts").select("source_row", text.normalize_phone(F.col("phone")).alias("phone"))


@query(
    "c6_normalize_email",
    r"""select source_row, lower(trim(email)) as email,
               regexp_matches(lower(trim(email)), '^[^\s@]+@[^\s@]+\.[^\s@]+$') as email_valid from contacts""",
)
def _(spark, sf_dir):
    email = F.col("email")
    return view(spark, sf_dir, "contacts").select(
        "source_row", text.normalize_email(email).alias("email"), text.email_valid(email).alias("email_valid")
    )


_DATE_SQL = r"""
coalesce(
  strftime(case when regexp_matches(X, '^\d{4}-\d{1,2}-\d{1,2}$') then try_strptime(X, '%Y-%m-%d') end, '%Y-%m-%d'),
  strftime(case when regexp_matches(X, '^\d{1,2}/\d{1,2}/\d{4}$') then coalesce(try_strptime(X, '%m/%d/%Y'), try_strptime(X, '%d/%m/%Y')) end, '%Y-%m-%d'),
  strftime(case when regexp_matches(X, '^\d{1,2}\.\d{1,2}\.\d{4}$') then try_strptime(X, '%d.%m.%Y') end, '%Y-%m-%d'),
  strftime(case when regexp_matches(X, '^[A-Za-z]+/\d{4}$') then try_strptime(X, '%B/%Y') end, '%Y-%m-%d'),
  strftime(case when regexp_matches(X, '^[A-Za-z]+ \d{4}$') then coalesce(try_strptime(X, '%B %Y'), try_strptime(X, '%b %Y')) end, '%Y-%m-%d'),
  strftime(case when regexp_matches(X, '^c\d{4} [A-Za-z]{3}$') then try_strptime(X, 'c%Y %b') end, '%Y-%m-%d'),
  strftime(case when regexp_matches(X, '^c\d{4} [A-Za-z]+$') then try_strptime(X, 'c%Y %B') end, '%Y-%m-%d'),
  case when regexp_matches(X, '^\d{2}\.\d{4}$') then concat(X[4:7], '-', X[1:2], '-01') end,
  case when regexp_matches(X, '^P\d{1,2}$') then concat('P', lpad(X[2:], 2, '0')) end,
  X)
"""


@query("c7_normalize_date", f"select id, {_DATE_SQL.replace('X', 's')} as normalized from period_texts")
def _(spark, sf_dir):
    return view(spark, sf_dir, "period_texts").select("id", dates.normalize_date(F.col("s")).alias("normalized"))


_DAY_SHAPES = {
    0: "%m/%d/%Y 10:15", 1: "%m/%d/%Y 9:05 PM", 2: "%m-%d-%Y", 3: "%d/%b/%Y", 4: "%B %dth %Y", 5: "%a, %d %b %Y", 6: "%d %B %Y 23:59:59",
    7: "%Y-%m-%d 7:00", 8: "%Y/%m/%d",
}


@query("c7_complete_days", "select o_orderkey as id, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def _(spark, sf_dir):
    """Days written out in full, in many shapes, all read back."""
    java = {"%m": "MM", "%d": "dd", "%Y": "yyyy", "%b": "MMM", "%B": "MMMM", "%a": "EEE"}
    shapes = []
    for shape in _DAY_SHAPES.values():
        parts = re.split("(%[a-zA-Z])", shape)
        shapes.append(F.concat(*[F.date_format("o_orderdate", java[p]) if p in java else F.lit(p) for p in parts if p]))
    text = F.element_at(F.array(*shapes), (F.col("o_orderkey") % len(shapes) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), dates.normalize_date(text).alias("day"))


_NUMBER_SQL = r"""
case when regexp_matches(trim(X), '^\s*[$€£]?\s*-?\(?[\d,]+\.?\d*\)?\s*%?\s*$')
      and regexp_matches(trim(regexp_replace(trim(trim(X), '()'), '[$€£,%]', '', 'g')), '^-?\d+\.?\d*$') then
  case when starts_with(trim(X), '(') and ends_with(trim(X), ')')
       then 0 - cast(trim(regexp_replace(trim(trim(X), '()'), '[$€£,%]', '', 'g')) as double)
       else cast(regexp_replace(trim(regexp_replace(trim(trim(X), '()'), '[$€£,%]', '', 'g')), '^-(0+\.?0*)$', '\1') as double) end
end
"""


@query("c8_parse_numeric", f"select id, {_NUMBER_SQL.replace('X', 's')} as parsed from numeric_texts")
def _(spark, sf_dir):
    return view(spark, sf_dir, "numeric_texts").select("id", numbers.parse_numeric(F.col("s")).alias("parsed"))


_TITLE = r"""
case when X = upper(X) and X <> lower(X) and length(X) > 3
     then list_aggregate(list_transform(regexp_extract_all(X, '\p{L}+|[^\p{L}]+'), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '')
     else X end
"""


@query("c9_normalize_text", f"select id, {_TITLE.replace('X', 's')} as normalized from text_noise")
def _(spark, sf_dir):
    return view(spark, sf_dir, "text_noise").select("id", text.normalize_text(F.col("s")).alias("normalized"))


@query(
    "c10_clean_fields",
    f"""select source_row, {_TITLE.replace('X', 'cliente')} as cliente, lower(trim(email)) as email,
               regexp_replace(nullif(trim(phone), ''), '[^0-9+]', '', 'g') as phone,
               {_DATE_SQL.replace('X', 'order_date')} as order_date, {_NUMBER_SQL.replace('X', 'quantity')} as quantity
        from contacts""",
)
def _(spark, sf_dir):
    return clean_fields(view(spark, sf_dir, "contacts"), {"quantity": "number"}).rows


@query(
    "c10_invalid_numbers",
    """select source_row, 'INVALID_FACT' as issue_type, 'Could not parse a number: quantity' as detail
       from contacts where quantity = 'n/a'""",
)
def _(spark, sf_dir):
    return clean_fields(view(spark, sf_dir, "contacts"), {"quantity": "number"}).issues


_FULL = "january|february|march|april|may|june|july|august|september|october|november|december"
_ALL = f"{_FULL}|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"


@query(
    "f1_is_period_column",
    rf"""select id, regexp_matches(s, '(?i)^c\d{{4}}\s+[a-z]+$|^\d{{2}}\.\d{{4}}$|^({_FULL})[ /-]\d{{4}}$|^\d{{4}}[-/]\d{{1,2}}$') as strict,
                regexp_matches(s, '(?i)^c\d{{4}}\s+[a-z]+$|^\d{{2}}\.\d{{4}}$|^({_ALL})[ /_-]\d{{4}}$|^\d{{4}}[-/]\d{{1,2}}$') as abbreviated
         from period_texts""",
)
def _(spark, sf_dir):
    s = F.col("s")
    return view(spark, sf_dir, "period_texts").select(
        "id", dates.is_period_column(s, abbreviated=False).alias("strict"), dates.is_period_column(s).alias("abbreviated")
    )


_PERIOD_SQL = r"""
coalesce(
  strftime(coalesce(try_strptime(X, 'c%Y %b'), try_strptime(X, 'c%Y %B')), '%Y-%m'),
  case when regexp_matches(X, '^\d{2}\.\d{4}$') then concat(X[4:7], '-', X[1:2]) end,
  case when regexp_matches(X, '^[A-Za-z]+[ /_-]\d{4}$') then strftime(coalesce(
    try_strptime(regexp_replace(X, '[ /_-]', ' '), '%B %Y'), try_strptime(regexp_replace(X, '[ /_-]', ' '), '%b %Y')), '%Y-%m') end,
  case when regexp_matches(X, '^\d{4}[-/]\d{1,2}$') then concat(X[1:4], '-', lpad(X[6:], 2, '0')) end,
  X)
"""


def period_sql(column: str) -> str:
    return _PERIOD_SQL.replace("X", column)


@query("f2_normalize_period", f"select id, {period_sql('s')} as period from period_texts")
def _(spark, sf_dir):
    return view(spark, sf_dir, "period_texts").select("id", dates.normalize_period(F.col("s")).alias("period"))


LONG_PERIOD_SQL = r"""
case when cast(regexp_extract(periodo, '(\d{1,2})', 1) as int) between 1 and 12
     then concat(cast(display_year as varchar), '-', lpad(regexp_extract(periodo, '(\d{1,2})', 1), 2, '0')) end
"""


@query("f3_long_period", f"select source_row, {LONG_PERIOD_SQL} as period from shipments_long")
def _(spark, sf_dir):
    period = dates.long_period(F.col("display_year"), F.col("periodo"))
    return view(spark, sf_dir, "shipments_long").select("source_row", period.alias("period"))


@query(
    "f4_is_period_header",
    rf"""select id, regexp_matches(s, '(?i)^c\d{{4}}\s+[a-z]{{3,}}$|^\d{{2}}\.\d{{4}}$|^({_ALL})[ /_-]\d{{4}}$|^\d{{4}}[-/]\d{{1,2}}$|^P\d{{1,2}}$') as is_header
         from period_texts""",
)
def _(spark, sf_dir):
    return view(spark, sf_dir, "period_texts").select("id", dates.is_period_header(F.col("s")).alias("is_header"))


@query("f5_normalize_header", "select page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')) as header from pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", similarity.normalize_header(F.col("url")).alias("header"))


_IS_NUMERIC = r"coalesce(regexp_matches(trim(replace(replace(s, ',', ''), '$', '')), '^(?i)[+-]?(\d+(\.\d*)?(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|nan|inf|infinity)$'), false)"


@query("f7_is_numeric", f"select id, {_IS_NUMERIC} as numeric from numeric_texts")
def _(spark, sf_dir):
    return view(spark, sf_dir, "numeric_texts").select("id", numbers.is_numeric(F.col("s")).alias("numeric"))


@query("f8_row_text", "select source_row, concat_ws(' ', trim(pais), region, canal, categoria, periodo) as row_text from shipments_long")
def _(spark, sf_dir):
    rows = view(spark, sf_dir, "shipments_long").withColumn("pais", F.trim("pais"))
    return rows.select("source_row", text.row_text(["pais", "region", "canal", "categoria", "periodo"]).alias("row_text"))


@query(
    "f9_first_filled",
    "select sheet, row_idx, coalesce(nullif(max(case when col_idx = 4 then value end), ''), max(case when col_idx = 3 then value end)) as sku from cells where row_idx >= 5 group by all",
)
def _(spark, sf_dir):
    cell = lambda i: F.max(F.when(F.col("col_idx") == i, F.col("value")))
    rows = view(spark, sf_dir, "cells").where("row_idx >= 5").groupBy("sheet", "row_idx")
    both = rows.agg(cell(4).alias("format"), cell(3).alias("segment"))
    return both.select("sheet", "row_idx", text.first_filled(F.col("format"), F.col("segment")).alias("sku"))


@query(
    "j2_unit_code",
    "select sheet, case upper(sheet) when 'KG' then 'KG' when 'UN' then 'UN' when 'LIT' then 'LT' else sheet end as unit, count(*) as n from cells group by all",
)
def _(spark, sf_dir):
    cells = view(spark, sf_dir, "cells")
    return cells.groupBy("sheet", unit_code(F.col("sheet")).alias("unit")).agg(F.count("*").alias("n"))


_MAPPING = {"Country": "pais", "Region": None, "Fact": "quantity"}


@query(
    "p3_provenance",
    """select source_row as _source_row, '{"Country":"pais","Region":null,"Channel":null,"City/State":null,"Category":null,"Brand":null,"SKU":null,"Fact":"quantity"}' as _source_trace
       from shipments_long""",
)
def _(spark, sf_dir):
    return view(spark, sf_dir, "shipments_long").select(*provenance_columns(_MAPPING, TARGET_COLUMNS))
