"""Clean and reshape one source.

The caller says which shape the source has; ``operators.layout`` helps to find out. The
source is read once: its cleaned and tagged rows, those that are kept, and the reshaped rows
are written to the shared folder, and everything else is computed from there, so that a
lost executor costs no second reading and no second shuffle of whole rows.
"""

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from tablesmith.operators.cleaning import (
    Result,
    Scope,
    cells_of,
    clean_fields,
    clean_values,
    ragged_log,
    remove_bad_rows,
    row_issue,
    scope_names,
    strict_aggregate,
)
from tablesmith.operators.matrix import FIRST_VALUE_ROW, channel_headers, matrix_log, matrix_to_wide, records_to_target, row_records, unlisted_periods
from tablesmith.operators.reconcile import null_count, reconciliation
from tablesmith.operators.reshape import Mapping, absent_sources, long_to_wide, period_columns, selected_targets, wide_to_target
from tablesmith.schema import MISFIT, ROW_ID, TARGET_COLUMNS, quoted
from tablesmith.session import materialize, materialize_counted, release
from tablesmith.sources.cells import data_sheets, sheet_union, table_key


class Outcome(NamedTuple):
    """Target rows, issue log, and the one-row reconciliation of a run.

    ``review`` has notes on the mapping; ``paths`` are the stored tables that the frames read.
    """

    rows: DataFrame
    issues: DataFrame
    summary: DataFrame
    review: list[str]
    paths: list[str]

    def release(self) -> None:
        """Delete the stored tables once rows, issues and summary are written elsewhere."""
        release(self.rows.sparkSession, self.paths)


_STRICT = "_strict"


def clean_source(
    source: DataFrame,
    mapping: Mapping,
    field_kinds: dict[str, str] | None = None,
    unicode: bool = True,
    row_id: str = ROW_ID,
    scope: Scope = None,
    needed: Iterable[str] | None = None,
    paths: list[str] | None = None,
) -> tuple[Result, DataFrame]:
    """Cleaned rows with their issues, and the source's row and null counts, seen while writing.

    All columns take part in the tests of whole rows; field rules run over the ``needed``
    ones only, which are all that is left then, next to the flag ``_strict``: whether any
    cell of the row holds a sub-total word. Rows that did not fit their file's header are kept
    and logged with their whole text. The column mapped to the measure is a number
    unless ``field_kinds`` says otherwise.
    """
    cells = cells_of(source, row_id, scope)
    counted = source.select("*", null_count(cells).alias("_nulls"))
    cleaned = clean_values(counted, unicode, row_id, scope).select("*", row_issue(cells).alias("issue_type"))
    counts = {"input_rows": F.count("*"), "null_cells_in_source": F.sum("_nulls")}
    tagged, seen = materialize_counted(cleaned, "tagged", paths, **counts)
    totals = source.sparkSession.createDataFrame([tuple(seen.values())], ", ".join(f"{n} bigint" for n in seen))
    split = remove_bad_rows(tagged.drop("_nulls"), row_id, True, scope, paths)
    fact = mapping.get("Fact")
    kinds = ({fact: "number"} if fact in cells else {}) | (field_kinds or {})
    kept = split.rows
    if needed is not None:
        wanted = {*needed, row_id, *scope_names(scope)}
        strict = strict_aggregate(cells).alias(_STRICT)
        kept = kept.select(*[F.col(quoted(n)) for n in kept.columns if n in wanted], strict)
        kinds = {n: k for n, k in kinds.items() if n in wanted} | {_STRICT: "as_is"}
    fields = clean_fields(kept, kinds, row_id, scope)
    issues = split.issues.unionByName(fields.issues)
    issues = issues.unionByName(ragged_log(tagged, row_id, scope)) if MISFIT in source.columns else issues
    return Result(fields.rows.drop(MISFIT), issues), totals


def _sources(source: DataFrame, mapping: Mapping, required: list[str]) -> set[str]:
    return {mapping[t] for t in selected_targets(required) if mapping.get(t)}


def transform_wide(
    source: DataFrame,
    mapping: Mapping,
    required: Iterable[str] = TARGET_COLUMNS,
    field_kinds: dict[str, str] | None = None,
    unicode: bool = True,
    job_id: int | None = None,
    source_file: str | None = None,
    row_id: str = ROW_ID,
    scope: Scope = None,
) -> Outcome:
    """A normal table, or one with a column per period.

    ``scope`` names the columns of the sheet or file a row number belongs to, if numbers
    restart there.
    """
    required, paths = list(required), []
    needed = _sources(source, mapping, required) | set(period_columns(cells_of(source, row_id, scope)).values())
    cleaned, totals = clean_source(source, mapping, field_kinds, unicode, row_id, scope, needed, paths)
    shaped = wide_to_target(cleaned.rows, mapping, required, row_id=row_id, scope=scope, flag=_STRICT)
    rows, seen = materialize_counted(shaped.rows, "rows", paths, output_rows=F.count("*"))
    issues = cleaned.issues.unionByName(shaped.issues)
    summary = reconciliation(totals, seen["output_rows"], issues, job_id, source_file)
    return Outcome(rows, issues, summary, absent_sources(source, mapping, required), paths)


def transform_long(
    source: DataFrame,
    mapping: Mapping,
    year_column: str,
    period_column: str,
    required: Iterable[str] = TARGET_COLUMNS,
    periods: list[str] | None = None,
    null_fact: str = "zero",
    field_kinds: dict[str, str] | None = None,
    unicode: bool = True,
    job_id: int | None = None,
    source_file: str | None = None,
    row_id: str = ROW_ID,
    scope: Scope = None,
    as_map: bool = False,
) -> Outcome:
    """A table with a row per period, named by a year and a period column.

    ``as_map`` keeps the periods of a row in one map, so that there may be any number of them.
    """
    required, paths = list(required), []
    needed = _sources(source, mapping, [*required, "Fact"]) | {year_column, period_column}
    cleaned, totals = clean_source(source, mapping, field_kinds, unicode, row_id, scope, needed, paths)
    shaped = long_to_wide(cleaned.rows, mapping, year_column, period_column, required, periods, null_fact, row_id, scope, as_map=as_map)
    rows, seen = materialize_counted(shaped.rows, "rows", paths, output_rows=F.count("*"))
    issues = cleaned.issues.unionByName(shaped.issues)
    summary = reconciliation(totals, seen["output_rows"], issues, job_id, source_file)
    return Outcome(rows, issues, summary, absent_sources(source, mapping, required), paths)


def transform_sheets(
    cells: DataFrame,
    mapping: Mapping,
    header_row: int | DataFrame = 1,
    year_column: str | None = None,
    period_column: str | None = None,
    **options,
) -> Outcome:
    """The sheets of one or more workbooks as one run, each cleaned and reshaped on its own.

    ``header_row`` may be the result of :func:`tablesmith.sources.cells.header_rows`. Equal
    rows of two sheets are no duplicates, and the log names a row by sheet and number, with
    cells of several workbooks by file, sheet and number. With a year and a period column the
    sheets are long tables, else normal or wide ones.
    """
    paths: list[str] = []
    source, scope = sheet_union(cells, header_row, paths), table_key(cells)
    if year_column and period_column:
        run = transform_long(source, mapping, year_column, period_column, scope=scope, **options)
    else:
        run = transform_wide(source, mapping, scope=scope, **options)
    return run._replace(paths=[*paths, *run.paths])


def transform_matrix(
    cells: DataFrame,
    required: Iterable[str] = TARGET_COLUMNS,
    periods: list[str] | None = None,
    header_rows: Iterable[int] = (1,),
    job_id: int | None = None,
    source_file: str | None = None,
) -> Outcome:
    """Matrix worksheets as a cell table; blank, sub-total and duplicate rules do not apply.

    Two passes over the cells: one puts rows together, one reads the header cells.
    """
    header_rows, paths = list(header_rows), []
    records = materialize(row_records(cells), "matrix-rows", paths)
    shaped = records_to_target(records, channel_headers(data_sheets(cells), header_rows), required, header_rows, paths)
    long, seen = materialize_counted(shaped.rows, "matrix-values", paths, output_rows=F.count("*"))
    rows = matrix_to_wide(long, periods)
    logged = matrix_log(records, long)
    issues = logged if periods is None else logged.unionByName(unlisted_periods(long, periods))
    heights = records.groupBy(*table_key(records)).agg((F.max("row_idx") - (FIRST_VALUE_ROW - 1)).alias("below"))
    totals = heights.agg(
        F.coalesce(F.sum("below"), F.lit(0)).alias("input_rows"), F.lit(0).cast("bigint").alias("null_cells_in_source")
    )
    return Outcome(rows, issues, reconciliation(totals, seen["output_rows"], issues, job_id, source_file), [], paths)
