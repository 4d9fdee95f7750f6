"""Worksheets as cell tables: ``(sheet, row_idx, col_idx, value)``, rows from 1, columns from 0.

Cells of several workbooks have a ``file`` column as well; a sheet is then told by both.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablesmith.functions.text import strip
from tablesmith.operators.lookup import lookup_join
from tablesmith.schema import ROW_ID, SHEET, quoted
from tablesmith.session import compute_once, materialize
from tablesmith.sources.files import unique_names

# The sheet that holds no data, how many rows are searched for a header, and
# the words that mark one.
GUIDE_SHEET = "guide"
HEADER_SCAN_ROWS = 12
HEADER_WORDS = [
    "country", "pais", "channel", "category", "categoria", "brand", "marca",
    "sku", "date", "year", "period", "calendar", "fact",
]


def table_key(cells: DataFrame) -> list[str]:
    return [n for n in ("file", SHEET) if n in cells.columns]


def cells_from_lines(lines: DataFrame, sep: str = "\t") -> DataFrame:
    """A cell table from a text grid ``(sheet, row_idx, line)``."""
    cell = F.posexplode(F.split("line", F.lit(f"\\Q{sep}\\E"), -1)).alias("col_idx", "value")
    return lines.select("sheet", "row_idx", cell)


def data_sheets(cells: DataFrame) -> DataFrame:
    """Without guide sheets."""
    # The length is seen before the letters, which are costly to compare.
    return cells.where((F.length("sheet") != len(GUIDE_SHEET)) | (F.lower("sheet") != GUIDE_SHEET))


def filled(value: Column) -> Column:
    return value.isNotNull() & (value != "")


def header_scores(cells: DataFrame) -> DataFrame:
    """Score of each of a sheet's first rows: 3 per header word found, 1 per filled cell.

    A header word holds no blank, so it is found in a row's joined text exactly if it is
    found in one of its cells: flags per cell are combined, and no row is ever assembled.
    """
    top = cells.where(F.col("row_idx") <= HEADER_SCAN_ROWS)
    text = F.lower(F.col("value"))
    found = [F.max(F.when(filled(F.col("value")) & text.contains(w), 1).otherwise(0)) for w in HEADER_WORDS]
    score = 3 * sum(found[1:], found[0]) + F.count_if(filled(F.col("value")))
    return top.groupBy(*table_key(cells), "row_idx").agg(score.alias("score"))


def header_rows(cells: DataFrame) -> DataFrame:
    """The likely header row of each sheet: the best score, the earliest row on a tie."""
    key = table_key(cells)
    best = Window.partitionBy(*key).orderBy(F.desc("score"), "row_idx")
    ranked = header_scores(cells).withColumn("_rank", F.row_number().over(best))
    return ranked.where("_rank = 1").select(*key, F.col("row_idx").alias("header_row"), "score")


def _with_header_row(cells: DataFrame, header_row: int | DataFrame, paths: list[str] | None) -> DataFrame:
    if isinstance(header_row, int):
        return cells.withColumn("header_row", F.lit(header_row))
    key = table_key(cells)
    return lookup_join(cells, header_row.select(*key, "header_row"), key, F.col("row_idx"), paths=paths)


def header_names(cells: DataFrame, header_row: int | DataFrame = 1, paths: list[str] | None = None) -> DataFrame:
    """``(sheet, header_row, col_idx, name)`` of every column position of each sheet.

    Positions go up to the greatest of any row; one without a filled header cell is
    ``Column_{position}``. Names are unique within a sheet without regard to case, and none
    is ``sheet`` or ``source_row`` (nor ``file``, if the cells have one). ``header_row`` is one
    number for all sheets, or a table of them such as the result of :func:`header_rows`. Widths
    and header cells come from one pass over the cells.
    """
    key = table_key(cells)
    head = F.when(F.col("row_idx") == F.col("header_row"), F.struct("col_idx", strip(F.col("value")).alias("value")))
    listed = _with_header_row(cells, header_row, paths).groupBy(*key, F.col("header_row").cast("int").alias("header_row")).agg(
        (F.max("col_idx") + 1).cast("int").alias("width"), F.collect_list(head).alias("given")
    )
    fields = ", ".join(f"{k} string" for k in key)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {n: [] for n in (*key, "header_row", "names")}
            for row in batch.to_pylist():
                values = {c["col_idx"]: c["value"] for c in row["given"] or []}
                for n in (*key, "header_row"):
                    out[n].append(row[n])
                out["names"].append(unique_names((values.get(i) for i in range(row["width"])), [*key, ROW_ID]))
            types = [*[pa.string()] * len(key), pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(out, types)], names=list(out))

    named = listed.mapInArrow(name, f"{fields}, header_row int, names array<string>")
    return named.select(*key, "header_row", F.posexplode("names").alias("col_idx", "name"))


def sheet_records(cells: DataFrame, sheet: str, header_row: int | DataFrame = 1, file: str | None = None) -> DataFrame:
    """The rows below a sheet's header row as a table; ``source_row`` counts them from 1.

    Of several workbooks, ``file`` names the one to read; without it the sheets of that name
    are read from all of them, by column name, and each row has its ``file``.
    """
    one = cells.where(F.col("sheet") == sheet)
    if file is not None:
        one = one.where(F.col("file") == file)
    rows = _records(one, header_row, None)
    return rows.drop(SHEET) if file is None else rows.drop(SHEET, "file")


def sheet_union(cells: DataFrame, header_row: int | DataFrame = 1, paths: list[str] | None = None) -> DataFrame:
    """Records of all sheets but guides in one table; a column that a sheet lacks is null.

    ``header_row`` is one number, or a table of one per sheet such as the result of
    :func:`header_rows`. Names that differ in case only are one column. Rows are told by
    (sheet, source_row), those of several workbooks by (file, sheet, source_row).
    """
    return _records(data_sheets(cells), header_row, paths)


def _records(data: DataFrame, header_row: int | DataFrame, paths: list[str] | None) -> DataFrame:
    """All sheets in one pass: a row is one list of its cells, which then gets the column numbers of its sheet.

    Only rows are joined with the names, not cells, and only the distinct names come to the driver,
    since they are the schema. Of several cells in one place the least filled one counts.
    """
    key = table_key(data)
    names = materialize(header_names(data, header_row, paths).withColumn("low", F.lower("name")), "names", paths)
    found = names.groupBy("low").agg(F.min(F.struct("col_idx", "name")).alias("first")).collect()
    columns = sorted(found, key=lambda r: tuple(r["first"]))
    numbers = data.sparkSession.createDataFrame([(r["low"], i) for i, r in enumerate(columns)], "low string, _column int")
    place = F.array_sort(F.collect_list(F.struct("col_idx", "_column")))
    # The positions of a sheet have no gaps, so an array tells the column of each.
    places = names.join(numbers, "low").groupBy(*key, "header_row").agg(place["_column"].alias("_columns"))
    cell = F.when(F.col("value").isNotNull(), F.struct(F.col("col_idx").cast("int").alias("col_idx"), "value"))
    # Grouped by row number first: cells lie in that order as a rule, and so need little sorting.
    rows = data.where("col_idx >= 0").groupBy("row_idx", *key).agg(F.sort_array(F.collect_list(cell)).alias("_cells"))
    rows = lookup_join(rows, places, key, F.col("row_idx"), paths=paths).where("row_idx > header_row")
    row = (F.col("row_idx") - F.col("header_row")).cast("bigint").alias(ROW_ID)
    found = F.transform("_cells.col_idx", lambda i: F.get("_columns", i)).alias("_found")
    rows = compute_once(rows, [*[F.col(n) for n in key], row, found, F.col("_cells.value").alias("_values")])
    value = lambda i: F.get("_values", (F.array_position("_found", i) - 1).cast("int"))
    return rows.select(*key, ROW_ID, *[value(i).alias(r["first"]["name"]) for i, r in enumerate(columns)])


def catalog_of(df: DataFrame, file: str, sheet: str = "data", n: int = HEADER_SCAN_ROWS) -> DataFrame:
    """The column catalog of a table: ``(file, sheet, col_pos, col_name, sample)`` from its first rows."""
    top = df.select(*[F.col(quoted(c)).cast("string").alias(f"_{i}") for i, c in enumerate(df.columns)]).limit(n)
    lists = top.agg(*[F.collect_list(F.col(f"_{i}")).alias(f"_{i}") for i in range(len(df.columns))])
    row = lambda i, c: F.struct(F.lit(i).alias("col_pos"), F.lit(c).alias("col_name"), F.col(f"_{i}").alias("sample"))
    each = F.inline(F.array(*[row(i, c) for i, c in enumerate(df.columns)]))
    return lists.select(F.lit(file).alias("file"), F.lit(sheet).alias("sheet"), each)


def catalog_of_cells(cells: DataFrame, header_row: int | DataFrame | None = None, n: int = HEADER_SCAN_ROWS) -> DataFrame:
    """The column catalog of all data sheets of a cell table with ``file``; header rows are detected."""
    data = data_sheets(cells)
    key = table_key(data)
    names = header_names(data, header_rows(data) if header_row is None else header_row)
    last = HEADER_SCAN_ROWS if header_row is None else header_row
    top = data.where(F.col("row_idx") <= last + n) if isinstance(last, int) else data
    near = top.join(names, [*key, "col_idx"]).where((F.col("row_idx") > F.col("header_row")) & (F.col("row_idx") <= F.col("header_row") + n))
    values = F.array_sort(F.collect_list(F.when(filled(F.col("value")), F.struct("row_idx", "value"))))
    samples = near.groupBy(*key, "col_idx").agg(F.transform(values, lambda v: v["value"]).alias("sample"))
    joined = names.join(samples, [*key, "col_idx"], "left")
    return joined.select(
        *key, F.col("col_idx").alias("col_pos"), F.col("name").alias("col_name"), F.coalesce("sample", F.array().cast("array<string>")).alias("sample")
    )
