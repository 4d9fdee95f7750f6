"""Matrix sheets: dimensions in the first columns, one value column per channel."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from tablesmith.functions.dates import normalize_period
from tablesmith.functions.numbers import parse_numeric
from tablesmith.functions.text import first_filled, strip
from tablesmith.operators.cleaning import Result, issue_log
from tablesmith.operators.lookup import lookup_join
from tablesmith.operators.reshape import PERIOD_MAP, SOURCE_ROW, SOURCE_TRACE, distinct_periods, selected_targets
from tablesmith.schema import AGGREGATE_ROW, INVALID_FACT, MATRIX_RESULT, ROW_ID, TARGET_COLUMNS, UNLISTED_PERIOD, quoted
from tablesmith.session import apart, compute_once, materialize
from tablesmith.sources.cells import data_sheets, filled, table_key

# Unit codes of well-known sheet names, and the layout of a matrix sheet.
UNITS = {"KG": "KG", "UN": "UN", "LIT": "LT"}
FIRST_VALUE_COLUMN = 5
FIRST_VALUE_ROW = 5
MIN_ROWS = 5
DATE_CELL, CATEGORY_CELL, BRAND_CELL, SEGMENT_CELL, FORMAT_CELL = range(5)
RESULT_WORDS = ["result", "total", "subtotal"]


def unit_code(sheet: Column) -> Column:
    """The unit a sheet name stands for, or the name itself."""
    table = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.upper(sheet)), sheet)


def _cell(position: int) -> Column:
    return F.max(F.when(F.col("col_idx") == position, F.col("value")))


def _leading_cells() -> list[Column]:
    names = ["date_text", "category", "brand", "segment", "format"]
    return [_cell(i).alias(n) for i, n in enumerate(names)]


def row_dimensions(cells: DataFrame, value_start_row: int = FIRST_VALUE_ROW) -> DataFrame:
    """One record per data row with its five leading cells."""
    lead = cells.where((F.col("row_idx") >= value_start_row) & (F.col("col_idx") < FIRST_VALUE_COLUMN))
    return lead.groupBy(*table_key(cells), "row_idx").agg(*_leading_cells())


def row_records(cells: DataFrame, value_start_row: int = FIRST_VALUE_ROW) -> DataFrame:
    """One record per data row: its five leading cells and the list of its filled value cells.

    A row's cells meet once, here; a row is as wide as its sheet.
    """
    body = data_sheets(cells).where(F.col("row_idx") >= value_start_row)
    is_value = (F.col("col_idx") >= FIRST_VALUE_COLUMN) & filled(F.col("value"))
    values = F.collect_list(F.when(is_value, F.struct("col_idx", "value"))).alias("values")
    return body.groupBy(*table_key(cells), "row_idx").agg(*_leading_cells(), values)


def column_letter(position: Column) -> Column:
    """The letters of a spreadsheet column: 0 is A, 26 is AA, 702 is AAA."""
    sign = lambda n: F.char(F.lit(65) + n % 26)
    two = F.floor(position / 26) - 1
    three = F.floor(two / 26) - 1
    return F.concat(
        F.when(position >= 702, sign(three)).otherwise(""), F.when(position >= 26, sign(two)).otherwise(""), sign(position)
    )


def is_result_row(category: Column) -> Column:
    return F.coalesce(F.lower(strip(category)) == "result", F.lit(False))


def value_cells(cells: DataFrame, value_start_row: int = FIRST_VALUE_ROW) -> DataFrame:
    """The filled cells of the data area."""
    area = (F.col("row_idx") >= value_start_row) & (F.col("col_idx") >= FIRST_VALUE_COLUMN)
    return cells.where(area & filled(F.col("value")))


def channel_headers(cells: DataFrame, header_rows: Iterable[int] = (1,)) -> DataFrame:
    """The channel of each value column: its header cells, joined by `` / `` if several."""
    rows = list(header_rows)
    head = cells.where(F.col("row_idx").isin(rows) & (F.col("col_idx") >= FIRST_VALUE_COLUMN))
    parts = [F.nullif(strip(F.max(F.when(F.col("row_idx") == r, F.col("value")))), F.lit("")) for r in rows]
    return head.groupBy(*table_key(cells), "col_idx").agg(F.nullif(F.concat_ws(" / ", *parts), F.lit("")).alias("channel"))


def _tall_sheets(cells: DataFrame, value_start_row: int, paths: list[str] | None) -> DataFrame:
    """Sheets below the least height hold no data; with the usual layout they have no data rows."""
    if value_start_row >= MIN_ROWS:
        return cells
    key = table_key(cells)
    tall = cells.groupBy(*key).agg(F.max("row_idx").alias("height")).where(F.col("height") >= MIN_ROWS)
    return lookup_join(cells, tall.select(*key), key, F.col("row_idx"), paths=paths)


def records_to_target(
    records: DataFrame, heads: DataFrame, required: Iterable[str] = TARGET_COLUMNS, header_rows: Iterable[int] = (1,),
    paths: list[str] | None = None,
) -> Result:
    """Target rows and issues from :func:`row_records` and :func:`channel_headers`.

    The few header cells, all of whose keys are hot, are a checked broadcast or a salted join.
    Sheets of several workbooks are told apart by their ``file``.
    """
    key = table_key(records)
    period = F.nullif(normalize_period(F.col("date_text")), F.lit(""))
    fact = unit_code(F.col("sheet"))
    # What the trace says of a record is written once for all its values.
    sku = F.when(F.nullif("format", F.lit("")).isNotNull(), "E").otherwise("D")
    before = F.concat(F.lit('{"Category":"B","Brand":"C","SKU":"'), sku, F.lit('","Channel":"'))
    after = F.when(fact.isNull(), "}").otherwise(F.concat(F.lit(","), F.substring(F.to_json(F.struct(F.concat(fact, F.lit(" sheet")).alias("Fact"))), 2, 2**31 - 1)))
    once = [period.alias("period"), before.alias("_before"), after.alias("_after")]
    atomic = compute_once(records.where(~is_result_row(F.col("category"))), [*[F.col(quoted(n)) for n in records.columns], *once])
    values = atomic.where("period is not null").select("*", F.inline("values")).drop("values")
    joined = lookup_join(values, heads, [*key, "col_idx"], F.col("row_idx"), "left", paths=paths)
    nothing = F.lit(None).cast("string")
    targets = {
        "Country": nothing,
        "Region": nothing,
        "Channel": F.col("channel"),
        "City/State": nothing,
        "Category": F.col("category"),
        "Brand": F.col("brand"),
        "SKU": first_filled(F.col("format"), F.col("segment")),
        "Fact": fact,
    }
    rows = ", ".join(map(str, header_rows))
    channel = F.concat(column_letter(F.col("col_idx")), F.lit(f" header rows {rows}"))
    out = joined.select(
        *key,
        *[targets[t].alias(t) for t in selected_targets(required)],
        "period",
        parse_numeric(F.col("value")).alias("value"),
        F.col("row_idx").cast("bigint").alias(SOURCE_ROW),
        F.col("col_idx").alias("_source_column"),
        F.concat("_before", channel, F.lit('"'), "_after").alias(SOURCE_TRACE),
    )
    not_numbers = values.where(parse_numeric(F.col("value")).isNull()).withColumnRenamed("row_idx", ROW_ID)
    return Result(out, result_log(records).unionByName(issue_log(not_numbers, INVALID_FACT, scope=key)))


def result_log(records: DataFrame) -> DataFrame:
    """One log entry for every sub-total row."""
    named = records.where(is_result_row(F.col("category"))).withColumnRenamed("row_idx", ROW_ID)
    return issue_log(named, AGGREGATE_ROW, F.lit(MATRIX_RESULT), scope=table_key(records))


def matrix_log(records: DataFrame, long: DataFrame) -> DataFrame:
    """The issues of :func:`records_to_target` from its stored rows: a value that is null there was no number."""
    not_numbers = long.where("value is null").withColumnRenamed(SOURCE_ROW, ROW_ID)
    return result_log(records).unionByName(issue_log(not_numbers, INVALID_FACT, scope=table_key(records)))


def matrix_to_target(
    cells: DataFrame,
    required: Iterable[str] = TARGET_COLUMNS,
    header_rows: Iterable[int] = (1,),
    value_start_row: int = FIRST_VALUE_ROW,
    paths: list[str] | None = None,
) -> Result:
    """One row per filled value cell, with its ``sheet``, ``period`` and numeric ``value``.

    The rows of all sheets are put together once and stored; rows and issues come from there.
    Rows and log name a row by its sheet and number, those of several workbooks by file, too.
    """
    cells = _tall_sheets(data_sheets(cells), value_start_row, paths)
    records = materialize(row_records(cells, value_start_row), "matrix-rows", paths)
    header_rows = list(header_rows)
    return records_to_target(records, channel_headers(cells, header_rows), required, header_rows, paths)


def matrix_to_wide(long: DataFrame, periods: list[str] | None = None, max_periods: int | None = None) -> DataFrame:
    """The same rows with a column per period, of which each row fills at most one.

    ``long`` should be a stored table if its periods are to be found; a row of a period that
    ``periods`` does not list has none filled (see :func:`unlisted_periods`).
    """
    periods = distinct_periods(long, max_periods=max_periods) if periods is None else periods
    first, *kept = [n for n in long.columns if n not in ("period", "value")]
    columns = [apart(F.col(quoted(first))).alias(first), *[F.col(quoted(n)) for n in kept]]
    return long.select(*columns, *[F.when(F.col("period") == p, F.col("value")).alias(p) for p in periods])


def matrix_to_map(long: DataFrame) -> DataFrame:
    """The same rows with a map ``periods`` from the one period of each to its value, for any number of periods.

    A value that is no number is logged by :func:`records_to_target` and gives an empty map.
    """
    kept = [F.col(quoted(n)) for n in long.columns if n not in ("period", "value")]
    entry = F.when(F.col("value").isNotNull(), F.create_map("period", "value"))
    return long.select(*kept, F.coalesce(entry, F.create_map().cast("map<string,double>")).alias(PERIOD_MAP))


def unlisted_periods(long: DataFrame, periods: list[str]) -> DataFrame:
    """One log entry for every matrix value whose period is not among ``periods``."""
    other = long.where(~F.col("period").isin(periods)).withColumnRenamed(SOURCE_ROW, ROW_ID)
    return issue_log(other, UNLISTED_PERIOD, scope=table_key(long))


def looks_like_matrix(cells: DataFrame) -> DataFrame:
    """Per sheet (and file, if the cells have one) whether it has a matrix layout.

    It needs five rows, and a sub-total word in the second column of its first eight, or
    three of the first four rows holding text only. A text grid has no cell types, so a
    cell is text if it is no number.
    """
    value = F.col("value")
    word = (F.col("col_idx") == CATEGORY_CELL) & (F.col("row_idx") <= 8) & F.lower(strip(value)).isin(RESULT_WORDS)
    per_sheet = [F.max("row_idx").alias("height"), F.count_if(word).alias("result_rows")]
    for r in range(1, 5):
        here = (F.col("row_idx") == r) & filled(value)
        per_sheet += [F.count_if(here).alias(f"n{r}"), F.count_if(here & parse_numeric(value).isNull()).alias(f"t{r}")]
    text_rows = [((F.col(f"n{r}") > 0) & (F.col(f"n{r}") == F.col(f"t{r}"))).cast("int") for r in range(1, 5)]
    stacked = sum(text_rows[1:], text_rows[0]) >= 3
    looks = (F.col("height") >= MIN_ROWS) & ((F.col("result_rows") >= 1) | stacked)
    key = table_key(cells)
    return cells.groupBy(*key).agg(*per_sheet).select(*key, looks.alias("looks_matrix"))
