"""From cleaned source rows to the target table: wide, long-period, and back to long form."""

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablesmith.functions.dates import header_is_period, header_period, long_period
from tablesmith.functions.numbers import parse_numeric
from tablesmith.functions.text import trace_json
from tablesmith.operators.cleaning import Result, Scope, cells_of, invalid_numbers, issue_log, row_key, scope_names, strict_aggregate
from tablesmith.schema import AGGREGATE_ROW, DETAILS, INVALID_PERIOD, ROW_ID, TARGET_COLUMNS, UNLISTED_PERIOD, quoted
from tablesmith.session import compute_once

SOURCE_ROW = "_source_row"
SOURCE_TRACE = "_source_trace"
# A table has one column per period; by default more than this is taken for a wrong period
# column. Tables of any number of periods have them in one column of maps instead.
MAX_PERIODS = 10_000
PERIOD_MAP = "periods"

Mapping = dict[str, str | None]


def source_names(scope: Scope) -> list[str]:
    """The output columns that say where a row comes from: ``_file``, ``_sheet``."""
    return [f"_{n}" for n in scope_names(scope)]


def _source_columns(scope: Scope) -> list[Column]:
    return [F.col(quoted(n)).alias(f"_{n}") for n in scope_names(scope)]


def selected_targets(required: Iterable[str] = TARGET_COLUMNS) -> list[str]:
    """The requested columns that are targets, in the caller's order; others are ignored."""
    return [t for t in required if t in TARGET_COLUMNS]


def _source(df: DataFrame, mapping: Mapping, target: str) -> Column | None:
    name = mapping.get(target)
    return F.col(quoted(name)) if name and name in df.columns else None


def _as_number(df: DataFrame, name: str) -> Column:
    c = F.col(quoted(name))
    return parse_numeric(c) if isinstance(df.schema[name].dataType, T.StringType) else c.cast("double")


def absent_sources(df: DataFrame, mapping: Mapping, required: Iterable[str] = TARGET_COLUMNS) -> list[str]:
    """Review notes on mapped columns that the table does not have; their targets are null."""
    missing = {t: mapping.get(t) for t in selected_targets(required) if mapping.get(t) and _source(df, mapping, t) is None}
    return [f"Column '{name}' mapped to '{target}' is not in the source." for target, name in missing.items()]


def target_columns(df: DataFrame, mapping: Mapping, required: Iterable[str] = TARGET_COLUMNS) -> list[Column]:
    """Each target from its mapped column as text; null where unmapped or absent."""
    nothing = F.lit(None)
    sources = {t: _source(df, mapping, t) for t in selected_targets(required)}
    return [(nothing if c is None else c).cast("string").alias(t) for t, c in sources.items()]


def provenance_columns(
    mapping: Mapping, required: Iterable[str] = TARGET_COLUMNS, row_id: str = ROW_ID, scope: Scope = None
) -> list[Column]:
    """File and sheet if there are several, the source row number, and the constant target -> source map."""
    trace = {t: mapping.get(t) for t in selected_targets(required)}
    return [*_source_columns(scope), F.col(quoted(row_id)).alias(SOURCE_ROW), trace_json(trace).alias(SOURCE_TRACE)]


def project_targets(
    df: DataFrame, mapping: Mapping, required: Iterable[str] = TARGET_COLUMNS, row_id: str = ROW_ID
) -> DataFrame:
    return df.select(*target_columns(df, mapping, required), *provenance_columns(mapping, required, row_id))


def period_columns(columns: Iterable[str]) -> dict[str, str]:
    """Normalized period -> source column; if two headers mean the same, the last wins."""
    return {header_period(n): n for n in columns if header_is_period(n)}


def select_periods(df: DataFrame) -> list[Column]:
    return [F.col(quoted(source)).alias(p) for p, source in period_columns(df.columns).items()]


def wide_to_target(
    df: DataFrame,
    mapping: Mapping,
    required: Iterable[str] = TARGET_COLUMNS,
    strict: bool = True,
    row_id: str = ROW_ID,
    scope: Scope = None,
    flag: str | None = None,
) -> Result:
    """Normal and wide tables: drop sub-total rows, project targets, keep period columns.

    ``flag`` names a boolean column that already says which rows are sub-totals, for tables
    that no longer have all their columns.
    """
    required = list(required)
    cells = [n for n in cells_of(df, row_id, scope) if n != flag]
    bad = F.col(quoted(flag)) if flag else strict_aggregate(cells) if strict else F.lit(False)
    rows = df.where(~bad).select(
        *target_columns(df, mapping, required),
        *provenance_columns(mapping, required, row_id, scope),
        *select_periods(df),
    )
    return Result(rows, issue_log(df.where(bad), AGGREGATE_ROW, row_id=row_id, scope=scope))


def distinct_periods(df: DataFrame, column: str = "period", max_periods: int | None = None) -> list[str]:
    """The period columns a table will have; a job of its own, like any pivot without a list."""
    most = MAX_PERIODS if max_periods is None else max_periods
    found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} periods: check the year and period columns, or ask for a map of periods")
    return sorted(row[0] for row in found)


def sum_by_period(
    df: DataFrame, keys: list[str], periods: list[str] | None = None, null_fact: str = "zero", as_map: bool = False
) -> DataFrame:
    """Group by ``keys`` and sum ``fact`` into one column per ``period``, or into one map of them.

    ``df`` has the keys, ``period``, ``fact`` and a unique ``source_row``; the first row's
    fact and number are carried along. The first aggregate works on (keys, period) and
    combines on the map side, so a hot key never travels row by row; the second only sees
    one record per group and period, whatever the number of periods. Rows of a period that
    ``periods`` does not list still make up groups; ``long_to_wide`` logs them.
    """
    names = [F.col(quoted(k)) for k in keys]
    periods = distinct_periods(df) if periods is None and not as_map else periods
    fact = F.coalesce("fact", F.lit(0.0)) if null_fact == "zero" else F.col("fact")
    cells = df.groupBy(*names, "period").agg(
        F.sum(fact).alias("total"), F.min(ROW_ID).alias("first_row"), F.min_by("fact", ROW_ID).alias("first_fact")
    )
    filled = F.col("period").isNotNull() & F.col("total").isNotNull()
    listed = filled if periods is None else filled & F.col("period").isin(periods)
    as_one = F.map_from_entries(F.array_sort(F.collect_list(F.when(listed, F.struct("period", "total"))))).alias(PERIOD_MAP)
    return cells.groupBy(*names).agg(
        F.min_by("first_fact", "first_row").alias("Fact"),
        F.min("first_row").alias(SOURCE_ROW),
        *[as_one] if as_map else [F.max(F.when(F.col("period") == p, F.col("total"))).alias(p) for p in periods],
    )


def _long_period(year_column: str, period_column: str) -> Column:
    return long_period(F.col(quoted(year_column)), F.col(quoted(period_column))).alias("period")


def long_rows(
    df: DataFrame,
    mapping: Mapping,
    year_column: str,
    period_column: str,
    required: Iterable[str] = TARGET_COLUMNS,
    row_id: str = ROW_ID,
    scope: Scope = None,
) -> DataFrame:
    """Target dimensions, ``period`` (null if invalid), numeric ``fact`` and ``source_row``."""
    dimensions = [t for t in selected_targets(required) if t != "Fact"]
    fact = mapping.get("Fact")
    columns = [
        *target_columns(df, mapping, dimensions),
        _long_period(year_column, period_column),
        (_as_number(df, fact) if fact in df.columns else F.lit(None).cast("double")).alias("fact"),
        F.col(quoted(row_id)).alias(ROW_ID),
        *_source_columns(scope),
    ]
    return compute_once(df, columns)


def period_issues(
    df: DataFrame, period: Column, periods: list[str] | None = None, row_id: str = ROW_ID, scope: Scope = None
) -> DataFrame:
    """One log entry for every row without a period, or with one that ``periods`` does not list.

    The period is computed once per row.
    """
    names = [F.col(quoted(n)) for n in row_key(row_id, scope)]
    read = compute_once(df, [*names, period.alias("_period")])
    kind = F.when(F.col("_period").isNull(), INVALID_PERIOD)
    kind = kind if periods is None else kind.when(~F.col("_period").isin(periods), UNLISTED_PERIOD)
    tagged = compute_once(read, [*names, kind.alias("issue_type")]).where("issue_type is not null")
    detail = F.when(F.col("issue_type") == INVALID_PERIOD, DETAILS[INVALID_PERIOD]).otherwise(DETAILS[UNLISTED_PERIOD])
    own = [F.col(quoted(n)) for n in scope_names(scope)]
    return tagged.select(*own, F.col(quoted(row_id)).cast("bigint").alias(ROW_ID), "issue_type", detail.alias("detail"))


def long_to_wide(
    df: DataFrame,
    mapping: Mapping,
    year_column: str,
    period_column: str,
    required: Iterable[str] = TARGET_COLUMNS,
    periods: list[str] | None = None,
    null_fact: str = "zero",
    row_id: str = ROW_ID,
    scope: Scope = None,
    max_periods: int | None = None,
    as_map: bool = False,
) -> Result:
    """Long tables (one row per period) to one row per group with a column per period.

    ``as_map`` gives one column ``periods`` instead, a map from period to sum, for any number of
    periods; nothing is read beforehand to find them.

    Rows without a valid period are logged and left out. Rows of a period that ``periods``
    does not list are logged; they count for their group's first row only. A null fact counts as 0, or as missing with
    ``null_fact="null"``; a fact that is text but no number is logged, too. With ``scope``
    each sheet has groups of its own.
    """
    required = list(required)
    targets = selected_targets(required)
    period = _long_period(year_column, period_column)
    listed = periods is not None
    if periods is None and not as_map:
        periods = distinct_periods(df.select(period), max_periods=max_periods)
    valid = long_rows(df, mapping, year_column, period_column, required, row_id, scope).where("period is not null")
    keys = [*source_names(scope), *[t for t in targets if t != "Fact"]]
    wide = sum_by_period(valid, keys, periods, null_fact, as_map)
    fixed = {*targets, "Fact", SOURCE_ROW, *source_names(scope)}
    trace = trace_json({t: mapping.get(t) for t in targets}).alias(SOURCE_TRACE)
    out = wide.select(
        *[F.col(quoted(t)) for t in targets],
        *source_names(scope),
        SOURCE_ROW,
        trace,
        *[F.col(quoted(n)) for n in wide.columns if n not in fixed],
    )
    fact = mapping.get("Fact")
    text_fact = fact in df.columns and isinstance(df.schema[fact].dataType, T.StringType)
    issues = period_issues(df, period, periods if listed else None, row_id, scope)
    return Result(out, issues.unionByName(invalid_numbers(df, [fact], row_id, scope)) if text_fact else issues)


def wide_to_long(df: DataFrame, ids: list[str], periods: list[str] | None = None, value: str = "value") -> DataFrame:
    """One row per filled period cell; all period columns become DOUBLE."""
    periods = list(period_columns(df.columns)) if periods is None else periods
    numbers = [_as_number(df, p).alias(p) for p in periods]
    flat = df.select(*[F.col(quoted(n)) for n in ids], *numbers)
    long = flat.unpivot([F.col(quoted(n)) for n in ids], [F.col(quoted(p)) for p in periods], "period", value)
    return long.where(F.col(value).isNotNull())


def append_outputs(frames: Iterable[DataFrame]) -> DataFrame:
    """Append outputs of several sheets or runs; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def append_runs(frames: dict[int, DataFrame]) -> DataFrame:
    """Append the outputs of several runs, each marked with its ``job_id`` (see ``sinks.tables.write_run``)."""
    return append_outputs([df.select(F.lit(job).cast("bigint").alias("job_id"), "*") for job, df in frames.items()])


def in_source_order(df: DataFrame) -> DataFrame:
    """Rows in the order in which their groups were first seen."""
    return df.orderBy(SOURCE_ROW)


def visible(df: DataFrame) -> DataFrame:
    """Without the provenance columns."""
    return df.drop(*[n for n in df.columns if n.startswith("_")])
