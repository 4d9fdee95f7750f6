"""Row and field cleaning with an issue log.

Rows are judged in a fixed order: blank, then sparse sub-total, then exact duplicate, so
that duplicates are looked for among the surviving rows only.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablesmith.functions.dates import date_text, header_is_period, normalize_date
from tablesmith.functions.numbers import parse_numeric
from tablesmith.functions.text import (
    clean_value,
    joined_cells,
    nfkc_cells,
    normalize_email,
    normalize_phone,
    normalize_text,
    row_text,
    untidy_cells,
)
from tablesmith.schema import AGGREGATE_ROW, DETAILS, DUPLICATE, INVALID_FACT, MISFIT, NULL_ROW, RAGGED_ROW, ROW_ID, quoted
from tablesmith.session import compute_once, materialize

# Words that mark a sub-total row, and header parts that decide a field's rule.
AGGREGATE_WORDS = r"(?iU)\b(Result|Subtotal|Grand Total|Total)\b"
STRICT_AGGREGATE_WORDS = r"(?iU)\b(Result|Subtotal|Total)\b"
EMAIL_HEADERS = ["email"]
PHONE_HEADERS = ["phone", "mobile", "tel"]
DATE_HEADERS = ["date", "period", "month", "year/month", "calendar"]


class Result(NamedTuple):
    """The rows an operator keeps, and the log of the rows it removed or flagged."""

    rows: DataFrame
    issues: DataFrame


# Columns in which row numbers restart: one name, or several (``file`` and ``sheet``).
Scope = str | list[str] | None


def scope_names(scope: Scope) -> list[str]:
    return [scope] if isinstance(scope, str) else list(scope or [])


def cells_of(df: DataFrame, row_id: str = ROW_ID, scope: Scope = None) -> list[str]:
    """The columns that hold data: not the row number, the scope of its numbering or the text of ragged rows."""
    return [n for n in df.columns if n not in (row_id, *scope_names(scope), MISFIT)]


def row_key(row_id: str = ROW_ID, scope: Scope = None) -> list[str]:
    """What names a row: its number, and where numbers restart (``sheet``, ``file`` or both) that too."""
    return [*scope_names(scope), row_id]


def issue_log(
    df: DataFrame, issue_type: str, detail: Column | None = None, row_id: str = ROW_ID, scope: Scope = None
) -> DataFrame:
    """One log entry for every row of ``df``, with its ``scope`` if row numbers restart there."""
    return df.select(
        *[F.col(quoted(n)) for n in scope_names(scope)],
        F.col(quoted(row_id)).cast("bigint").alias(ROW_ID),
        F.lit(issue_type).alias("issue_type"),
        (F.lit(DETAILS[issue_type]) if detail is None else detail).alias("detail"),
    )


def ragged_log(df: DataFrame, row_id: str = ROW_ID, scope: Scope = None) -> DataFrame:
    """One log entry with the whole text of every row that did not fit its file's header."""
    if MISFIT not in df.columns:
        return issue_log(df.where(F.lit(False)), RAGGED_ROW, row_id=row_id, scope=scope)
    detail = F.concat(F.lit(DETAILS[RAGGED_ROW] + ": "), F.col(MISFIT))
    return issue_log(df.where(F.col(MISFIT).isNotNull()), RAGGED_ROW, detail, row_id, scope)


def clean_values(df: DataFrame, unicode: bool = True, row_id: str = ROW_ID, scope: Scope = None) -> DataFrame:
    """Apply ``clean_value`` to every text column, once per cell.

    The text cells of a row are one array, so that the plan has the rule once however many
    columns there are. One test of all cells together finds the rows that are clean already.
    The ``explode`` of a single element keeps later filters from being pushed below it,
    which would repeat the rule.
    """
    is_text = lambda f: isinstance(f.dataType, T.StringType) and f.name not in (*row_key(row_id, scope), MISFIT)
    text = [f.name for f in df.schema.fields if is_text(f)]
    if not text:
        return df
    others = [F.col(quoted(n)) for n in df.columns if n not in text]
    # Empty texts become null in any case.
    rows = compute_once(df, [*others, F.array(*[F.nullif(F.col(quoted(n)), F.lit("")) for n in text]).alias("_text")])
    cells = nfkc_cells(F.col("_text")) if unicode else F.col("_text")
    rows = rows.select(*others, cells.alias("_text"))
    rows = compute_once(rows, [*others, F.col("_text"), joined_cells(F.col("_text")).alias("_joined")])
    cleaned = F.transform("_text", lambda c: clean_value(c, unicode=False))
    cleaned = F.when(untidy_cells(F.col("_joined")), cleaned).otherwise(F.col("_text"))
    rows = rows.select(*others, F.explode(F.array(cleaned)).alias("_text"))
    return rows.select(*[F.col("_text")[text.index(n)].alias(n) if n in text else F.col(quoted(n)) for n in df.columns])


def filled_cells(columns: list[str]) -> Column:
    """How many cells of a row are neither null nor empty."""
    filled = [F.when(F.col(quoted(n)).cast("string") != "", 1).otherwise(0) for n in columns]
    return sum(filled[1:], filled[0])


def row_issue(columns: list[str]) -> Column:
    """The issue that can be seen from one row alone: blank or sparse sub-total, else null."""
    filled = filled_cells(columns)
    sparse = filled <= max(2, len(columns) // 3)
    return (
        F.when(filled == 0, NULL_ROW)
        .when(sparse & row_text(columns).rlike(AGGREGATE_WORDS), AGGREGATE_ROW)
    )


def tag_rows(df: DataFrame, row_id: str = ROW_ID, scope: Scope = None) -> DataFrame:
    """Add ``issue_type``, null for rows that pass the row-local rules. No shuffle."""
    return df.select("*", row_issue(cells_of(df, row_id, scope)).alias("issue_type"))


def split_duplicates(
    df: DataFrame, row_id: str = ROW_ID, store: bool = False, scope: Scope = None, paths: list[str] | None = None
) -> Result:
    """Keep the first of each group of equal rows and log the others.

    Copies collapse in the map-side half of the aggregate, so a row that makes up a third
    of the table still sends one record per task. The log is an anti-join on the unique row
    key, which spreads evenly whatever the rows look like; rows of different scopes are never
    equal. ``store`` writes the kept rows to the shared folder, so that rows and log together
    shuffle the whole rows only once.
    """
    cells, key = [n for n in df.columns if n != row_id], row_key(row_id, scope)
    kept = df.groupBy(*[F.col(quoted(n)) for n in cells]).agg(F.min(quoted(row_id)).alias(row_id))
    kept = kept.select(*[F.col(quoted(n)) for n in df.columns])
    kept = materialize(kept, "kept", paths) if store else kept
    names = [F.col(quoted(n)) for n in key]
    removed = df.select(*names).join(kept.select(*names), key, "left_anti")
    return Result(kept, issue_log(removed, DUPLICATE, row_id=row_id, scope=scope))


def remove_bad_rows(
    tagged: DataFrame, row_id: str = ROW_ID, store: bool = False, scope: Scope = None, paths: list[str] | None = None
) -> Result:
    """Split rows tagged by :func:`tag_rows` and remove duplicates among the good ones.

    Rows and issues together read ``tagged`` three times, so it should be a stored table.
    """
    good = tagged.where("issue_type is null").drop("issue_type")
    bad = tagged.where("issue_type is not null")
    detail = F.when(F.col("issue_type") == NULL_ROW, DETAILS[NULL_ROW]).otherwise(DETAILS[AGGREGATE_ROW])
    named = [*[F.col(quoted(n)) for n in scope_names(scope)], F.col(quoted(row_id)).cast("bigint").alias(ROW_ID)]
    log = bad.select(*named, "issue_type", detail.alias("detail"))
    unique = split_duplicates(good, row_id, store, scope, paths)
    return Result(unique.rows, log.unionByName(unique.issues))


def strict_aggregate(columns: list[str]) -> Column:
    """Whether any cell of a row holds a sub-total word, however full the row is."""
    return row_text(columns).rlike(STRICT_AGGREGATE_WORDS)


def field_kind(name: str) -> str:
    """The rule for a column, chosen by its header; the first match wins."""
    low = name.lower()
    for kind, parts in (("email", EMAIL_HEADERS), ("phone", PHONE_HEADERS), ("date", DATE_HEADERS)):
        if any(p in low for p in parts):
            return kind
    return "number" if header_is_period(name) else "text"


def _field(df: DataFrame, name: str, kind: str) -> Column:
    c, dtype = F.col(quoted(name)), df.schema[name].dataType
    typed_day = isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))
    is_text = isinstance(dtype, T.StringType)
    rules = {
        "email": lambda: normalize_email(c.cast("string")),
        "phone": lambda: normalize_phone(c.cast("string")),
        "date": lambda: date_text(c) if typed_day else normalize_date(c) if is_text else c,
        "number": lambda: parse_numeric(c) if is_text else c.cast("double"),
        "text": lambda: normalize_text(c) if is_text else c,
        "as_is": lambda: c,
    }
    return rules[kind]().alias(name)


def clean_fields(
    df: DataFrame, field_kinds: dict[str, str] | None = None, row_id: str = ROW_ID, scope: Scope = None
) -> Result:
    """Normalize every column by its rule; cells that should be numbers but are not are logged.

    ``field_kinds`` overrides the rule of a column: ``email``, ``phone``, ``date``,
    ``number``, ``text`` or ``as_is``. Codes stay text unless declared ``number``.
    """
    kinds = {n: field_kind(n) for n in cells_of(df, row_id, scope)} | (field_kinds or {})
    rows = compute_once(df, [_field(df, n, kinds[n]) if n in kinds else F.col(quoted(n)) for n in df.columns])
    number_text = [
        n for n, k in kinds.items() if k == "number" and n in df.columns and isinstance(df.schema[n].dataType, T.StringType)
    ]
    return Result(rows, invalid_numbers(df, number_text, row_id, scope))


def invalid_numbers(df: DataFrame, columns: list[str], row_id: str = ROW_ID, scope: Scope = None) -> DataFrame:
    """Log the rows where a non-empty cell of ``columns`` is not a number, with their names."""
    bad = [
        F.when((F.col(quoted(n)) != "") & parse_numeric(F.col(quoted(n))).isNull(), F.lit(n)) for n in columns
    ]
    names = F.concat_ws(", ", *bad) if bad else F.lit("")
    detail = F.concat(F.lit(DETAILS[INVALID_FACT] + ": "), names)
    flagged = df.where(names != "") if bad else df.where(F.lit(False))
    return issue_log(flagged, INVALID_FACT, detail, row_id, scope)


def clean_rows(
    df: DataFrame,
    field_kinds: dict[str, str] | None = None,
    unicode: bool = True,
    row_id: str = ROW_ID,
    scope: Scope = None,
    paths: list[str] | None = None,
) -> Result:
    """The whole cleaning pass: values, bad rows, duplicates, then fields by header; ragged rows are logged.

    ``row_id`` must name a row, or do so together with ``scope``, one or more columns that take no
    part in the row tests but keep equal rows of different sheets or files apart. The source is
    read once and the whole rows are shuffled once: the tagged rows and the kept rows are
    both stored in the shared folder.
    """
    tagged = materialize(tag_rows(clean_values(df, unicode, row_id, scope), row_id, scope), "tagged", paths)
    split = remove_bad_rows(tagged, row_id, True, scope, paths)
    fields = clean_fields(split.rows, field_kinds, row_id, scope)
    issues = split.issues.unionByName(fields.issues)
    # A table that no text file can have filled has no ragged rows to look for.
    issues = issues.unionByName(ragged_log(tagged, row_id, scope)) if MISFIT in df.columns else issues
    return Result(fields.rows.drop(MISFIT), issues)
