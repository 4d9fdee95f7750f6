"""Row rules, reshape, reconciliation and skew on small tables."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tablesmith.functions.text import clean_value
from tablesmith.operators.cleaning import clean_fields, clean_rows, clean_values, field_kind, remove_bad_rows, split_duplicates, tag_rows
from tablesmith.operators.lookup import lookup_join, salts_for
from tablesmith.operators.matrix import column_letter, matrix_to_map, matrix_to_target, matrix_to_wide
from tablesmith.operators.portfolio import totals_rollup
from tablesmith.operators.reconcile import column_profile, metric_rows
from tablesmith.operators.reshape import (
    absent_sources,
    distinct_periods,
    long_to_wide,
    period_columns,
    project_targets,
    selected_targets,
    visible,
    wide_to_long,
    wide_to_target,
)
from tablesmith.plans.transform import transform_long, transform_matrix, transform_sheets, transform_wide
from tablesmith.sinks.tables import read_runs, write_run
from tablesmith.sources.cells import header_names, header_rows, sheet_records, sheet_union

COLUMNS = [f"c{i}" for i in range(9)]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def make(spark, rows, schema):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], f"source_row bigint, {schema}")


def test_cleaning_pass(spark):
    shop, twin = ("  Corner   Shop", "Orders@Corner.test ", "0049-30/901820"), ("Corner Shop ", "Orders@Corner.test", " 0049-30/901820")
    rows = [(" ", None, "\t"), shop, ("Kiosk 9", "none", "ext. 12"), twin, shop]
    out = clean_rows(make(spark, rows, "Client string, Email string, Mobile string"))
    assert rows_of(out.rows, "source_row", "Client", "Email", "Mobile") == [
        (2, "Corner Shop", "orders@corner.test", "004930901820"), (3, "Kiosk 9", "none", "12"),
    ]
    assert rows_of(out.issues, "source_row", "issue_type") == [(1, "NULL_ROW_REMOVED"), (4, "DUPLICATE_REMOVED"), (5, "DUPLICATE_REMOVED")]


def nine(*cells):
    return tuple(cells) + (None,) * (9 - len(cells))


def test_aggregate_rows_must_be_sparse(spark):
    rows = [nine("Total", "1", "2"), nine("Total", "1", "2", "3"), nine("Totals", "1"), nine("x", "grand total"), nine("Totally", "y")]
    tagged = tag_rows(make(spark, rows, ", ".join(f"{c} string" for c in COLUMNS)))
    assert rows_of(tagged, "source_row", "issue_type") == [(1, "AGGREGATE_ROW"), (2, None), (3, None), (4, "AGGREGATE_ROW"), (5, None)]


def test_strict_rule_ignores_how_full_a_row_is(spark):
    rows = [nine("Total", "1", "2", "3"), nine("Totals", "1"), nine("subtotal")]
    wide = wide_to_target(make(spark, rows, ", ".join(f"{c} string" for c in COLUMNS)), {"Country": "c0"}, ["Country"])
    assert rows_of(wide.rows, "Country") == [("Totals",)]
    assert rows_of(wide.issues, "source_row", "issue_type") == [(1, "AGGREGATE_ROW"), (3, "AGGREGATE_ROW")]


def test_repeated_total_row_is_never_a_duplicate(spark):
    rows = [nine("Total", "5"), nine("Total", "5"), nine("a", "1"), nine("a", "1"), nine("a", "1")]
    split = remove_bad_rows(tag_rows(make(spark, rows, ", ".join(f"{c} string" for c in COLUMNS))))
    assert rows_of(split.issues, "source_row", "issue_type") == [
        (1, "AGGREGATE_ROW"), (2, "AGGREGATE_ROW"), (4, "DUPLICATE_REMOVED"), (5, "DUPLICATE_REMOVED"),
    ]
    assert split.rows.count() + split.issues.count() == len(rows)


def test_duplicates_are_typed_and_null_safe(spark):
    rows = [(None, "x"), ("None", "x"), (None, "x")]
    split = split_duplicates(make(spark, rows, "a string, b string"))
    assert rows_of(split.rows, "source_row") == [(1,), (2,)]


def test_one_row_may_be_a_third_of_the_table(spark):
    df = spark.range(30_000).select(
        (F.col("id") + 1).alias("source_row"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("a")
    )
    split = split_duplicates(df)
    assert split.rows.count() == 20_001
    assert split.rows.where("a = 'hot'").first()["source_row"] == 1
    assert split.issues.count() == 9_999


def test_field_rules_by_header():
    kinds = {n: field_kind(n) for n in ["E-mail Email", "Mobile", "Hotel", "Year/Month", "c2025 Jan", "01.2020", "Brand"]}
    assert list(kinds.values()) == ["email", "phone", "phone", "date", "number", "number", "text"]


def test_clean_fields_logs_text_in_number_columns(spark):
    df = make(spark, [("007", "(1,200)", "x"), ("008", "n/a", ""), ("009", None, "5%")], "`Code.No` string, `01.2020` string, `c2020 Feb` string")
    out = clean_fields(df)
    assert rows_of(out.rows, "`Code.No`", "`01.2020`", "`c2020 Feb`") == [("007", -1200.0, None), ("008", None, None), ("009", None, 5.0)]
    assert rows_of(out.issues, "source_row", "detail") == [
        (1, "Could not parse a number: c2020 Feb"), (2, "Could not parse a number: 01.2020"),
    ]


def test_targets_keep_the_callers_order(spark):
    assert selected_targets(["SKU", "Other", "Country"]) == ["SKU", "Country"]
    df = make(spark, [("1", "b")], "`L1,2 - Division` string, `a.b` string")
    out = project_targets(df, {"Region": "L1,2 - Division", "Brand": "a.b", "Fact": "no such column"}, ["Brand", "Fact", "Region"])
    assert out.columns[:3] == ["Brand", "Fact", "Region"]
    assert tuple(out.first())[:3] == ("b", None, "1")
    assert absent_sources(df, {"Brand": "a.b", "Fact": "no such column"}) == ["Column 'no such column' mapped to 'Fact' is not in the source."]


def test_last_of_two_headers_for_a_period_wins():
    assert period_columns(["x", "c2024 Jan", "01.2024", "2024-2"]) == {"2024-01": "01.2024", "2024-02": "2024-2"}


LONG = "pais string, anio string, periodo string, qty string"
LONG_ROWS = [
    ("A", "2024", "P01", "5"), ("A", "2024.0", "p1", None), ("A", "2024", "P02", "x"), (None, "2024", "P01", "1"),
    (None, "2024", "P01", "2"), ("B", "2024", "P13", "9"), ("B", None, "P01", "9"),
]


def test_long_to_wide(spark):
    out = long_to_wide(make(spark, LONG_ROWS, LONG), {"Country": "pais", "Fact": "qty"}, "anio", "periodo", ["Country", "Fact", "SKU"])
    assert out.rows.columns == ["Country", "Fact", "SKU", "_source_row", "_source_trace", "2024-01", "2024-02"]
    assert rows_of(out.rows, "Country", "Fact", "SKU", "_source_row", "2024-01", "2024-02") == [
        ("A", 5.0, None, 1, 5.0, 0.0), (None, 1.0, None, 4, 3.0, None),
    ]
    assert rows_of(out.issues, "source_row", "issue_type") == [(3, "INVALID_FACT"), (6, "INVALID_PERIOD"), (7, "INVALID_PERIOD")]


def test_null_fact_can_stay_null(spark):
    out = long_to_wide(make(spark, LONG_ROWS, LONG), {"Country": "pais", "Fact": "qty"}, "anio", "periodo", ["Country"], null_fact="null")
    assert rows_of(out.rows, "Country", "2024-01", "2024-02") == [("A", 5.0, None), (None, 3.0, None)]


def test_fact_sum_survives_reshaping(spark):
    df = make(spark, [("A", "2024", f"P{m:02d}", str(m * v)) for m in range(1, 13) for v in range(4)], LONG)
    out = long_to_wide(df, {"Country": "pais", "Fact": "qty"}, "anio", "periodo", ["Country", "Fact"])
    long = wide_to_long(out.rows, ["Country"])
    assert long.agg(F.sum("value")).first()[0] == sum(m * v for m in range(1, 13) for v in range(4))
    assert long.count() == 12


def test_too_many_periods_is_an_error(spark, monkeypatch):
    monkeypatch.setattr("tablesmith.operators.reshape.MAX_PERIODS", 3)
    with pytest.raises(ValueError, match="more than 3 periods"):
        distinct_periods(spark.range(10).select(F.col("id").cast("string").alias("period")))


def test_visible_hides_provenance(spark):
    assert visible(spark.sql("select 1 as a, 2 as _source_row")).columns == ["a"]


@pytest.mark.parametrize("max_bytes", [0, 10_000])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_is_the_same_either_way(spark, how, max_bytes):
    big = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = lookup_join(big, small, ["k"], F.col("id"), how, max_bytes)
    assert sorted(map(tuple, got.select("id", "k", "v").collect())) == sorted(map(tuple, big.join(small, "k", how).select("id", "k", "v").collect()), key=lambda r: r[0])


def test_salts_follow_the_hot_key(spark):
    big = spark.range(3200).select("id", F.lit(1).alias("k"))
    assert salts_for(big, ["k"]) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert salts_for(spark.range(3200).withColumnRenamed("id", "k"), ["k"]) == 1
    assert salts_for(big.limit(0), ["k"]) == 1
    small = spark.createDataFrame([(1, "v")], "k int, v string")
    assert lookup_join(big, small, ["k"], F.col("id"), max_bytes=0).count() == 3200


def sheet(spark, grids):
    cells = [(s, r, c, v) for s, grid in grids.items() for r, line in enumerate(grid, 1) for c, v in enumerate(line) if v is not None]
    return spark.createDataFrame(cells, "sheet string, row_idx int, col_idx int, value string")


GRID = [
    [None, None, None, None, None, "Retail ", " Web", ""],
    [None, None, None, None, None, "North", "South", "East"],
    [None],
    ["Date", "Category", "Brand", "Segment", "Format", "KG", "KG", "KG"],
    ["c2025 Jan", "Food", "B1", "S1", "F1", "10", "", "3"],
    ["c2025 Feb", " Result ", "B1", None, None, "10", "1", "3"],
    [None, "Food", "B1", None, None, "10", "1", "3"],
    ["01.2025", "Food", "B2", "S2", None, "0", "x", None],
]


def test_matrix(spark):
    cells = sheet(spark, {"LIT": GRID, "Guide": GRID, "short": GRID[:4]})
    out = matrix_to_target(cells)
    assert rows_of(out.rows, "Channel", "Category", "Brand", "SKU", "Fact", "period", "value", "_source_row") == [
        ("Retail", "Food", "B1", "F1", "LT", "2025-01", 10.0, 5),
        ("Retail", "Food", "B2", "S2", "LT", "2025-01", 0.0, 8),
        ("Web", "Food", "B2", "S2", "LT", "2025-01", None, 8),
        (None, "Food", "B1", "F1", "LT", "2025-01", 3.0, 5),
    ]
    assert rows_of(out.issues, "sheet", "source_row", "issue_type", "detail") == [
        ("LIT", 6, "AGGREGATE_ROW", "Result row excluded from atomic output"), ("LIT", 8, "INVALID_FACT", "Could not parse a number"),
    ]
    trace = out.rows.where("Channel = 'Web'").first()["_source_trace"]
    assert trace == '{"Category":"B","Brand":"C","SKU":"D","Channel":"G header rows 1","Fact":"LT sheet"}'
    wide = matrix_to_wide(out.rows)
    assert "2025-01" in wide.columns and wide.count() == 4


def test_matrix_header_rows_and_early_data(spark):
    both = matrix_to_target(sheet(spark, {"KG": GRID}), header_rows=[1, 2]).rows
    assert {r[0] for r in both.select("Channel").collect()} == {"Retail / North", "Web / South", "East"}
    early = matrix_to_target(sheet(spark, {"KG": [GRID[0], GRID[4]], "UN": [GRID[0], *[GRID[4]] * 4]}), value_start_row=2).rows
    assert {r[0] for r in early.select("sheet").collect()} == {"UN"}


def test_reconciliation(spark):
    out = transform_long(
        make(spark, [*LONG_ROWS, ("A", "2024", "P01", "5"), (None, " ", "", None)], LONG),
        {"Country": "pais", "Fact": "qty"}, "anio", "periodo", ["Country", "Fact"], job_id=3, source_file="f.csv",
    )
    row = out.summary.first().asDict()
    assert (row["input_rows"], row["output_rows"], row["rows_removed_null"], row["rows_removed_duplicate"]) == (9, 2, 1, 1)
    assert (row["rows_flagged_invalid_period"], row["total_rows_removed_or_flagged"], row["null_cells_in_source"]) == (2, 4, 6)
    assert row["net_reconciliation_pct"] == 22.22
    assert row["issue_breakdown"] == {"NULL_ROW_REMOVED": 1, "DUPLICATE_REMOVED": 1, "INVALID_PERIOD": 2, "INVALID_FACT": 1}
    sections = [r["section"] for r in metric_rows(out.summary).collect()]
    assert sections.count("Metric") == 12 and sections.count("Issue type") == 4


def test_empty_input(spark):
    empty = make(spark, [("a", "2024", "P01", "1")], LONG).where("false")
    out = transform_long(empty, {"Country": "pais", "Fact": "qty"}, "anio", "periodo", ["Country", "Fact"])
    assert out.rows.count() == 0 and out.issues.count() == 0
    row = out.summary.first()
    assert (row["input_rows"], row["output_rows"], row["net_reconciliation_pct"]) == (0, 0, 0.0)


def test_wide_run(spark):
    df = make(spark, [("ACME", "1", "(2)"), ("ACME", "1", "(2)"), ("Total", None, None), ("SUBTOTAL ROW", "4", "5")], "Brand string, `c2024 Jan` string, `02.2024` string")
    out = transform_wide(df, {"Brand": "Brand"}, ["Brand"])
    assert rows_of(out.rows, "Brand", "2024-01", "2024-02", "_source_row") == [("Acme", 1.0, -2.0, 1)]
    assert rows_of(out.issues, "source_row", "issue_type") == [(2, "DUPLICATE_REMOVED"), (3, "AGGREGATE_ROW"), (4, "AGGREGATE_ROW")]
    assert {r["_source_row"] for r in out.rows.collect()} <= {1, 2, 3, 4}


def test_matrix_run(spark):
    out = transform_matrix(sheet(spark, {"KG": GRID, "Guide": GRID}))
    row = out.summary.first()
    assert (row["input_rows"], row["output_rows"], row["rows_removed_aggregate"]) == (4, 4, 1)


def test_matrix_values_of_unlisted_periods_are_logged(spark):
    out = transform_matrix(sheet(spark, {"KG": GRID}), periods=["2024-12"])
    assert rows_of(out.issues.where("issue_type = 'UNLISTED_PERIOD'"), "sheet", "source_row") == [("KG", 5), ("KG", 5), ("KG", 8), ("KG", 8)]


def test_unlisted_periods_are_logged(spark):
    rows = [("A", "2024", "P01", "5"), ("A", "2025", "P01", "7")]
    out = transform_long(make(spark, rows, LONG), {"Country": "pais", "Fact": "qty"}, "anio", "periodo", ["Country", "Fact"], periods=["2024-01"])
    assert rows_of(out.rows, "Country", "2024-01") == [("A", 5.0)]
    assert rows_of(out.issues, "source_row", "issue_type") == [(2, "UNLISTED_PERIOD")]


def test_column_letters(spark):
    got = [r[0] for r in spark.createDataFrame([(i,) for i in (0, 25, 26, 701, 702, 18277)], "i int").select(column_letter(F.col("i"))).collect()]
    assert got == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ"]


def test_sheets_keep_their_own_rows(spark):
    """Blank and equal rows are judged within a sheet, and every row is kept or logged."""
    grid = [["Brand", "Qty"], ["a", "1"], ["", None], ["a", "1"], ["b", "2"]]
    cells = sheet(spark, {"North": grid, "South": [["report"], *grid, ["Total", ""]], "Guide": grid})
    out = transform_sheets(cells, {"Brand": "Brand"}, header_rows(cells), required=["Brand"])
    assert rows_of(out.rows, "_sheet", "_source_row", "Brand") == [("North", 1, "a"), ("North", 4, "b"), ("South", 1, "a"), ("South", 4, "b")]
    assert rows_of(out.issues, "sheet", "source_row", "issue_type") == [
        ("North", 2, "NULL_ROW_REMOVED"), ("North", 3, "DUPLICATE_REMOVED"), ("South", 2, "NULL_ROW_REMOVED"),
        ("South", 3, "DUPLICATE_REMOVED"), ("South", 5, "AGGREGATE_ROW"),
    ]
    row = out.summary.first()
    assert row["input_rows"] == row["output_rows"] + row["total_rows_removed_or_flagged"] == 9
    long = [["Brand", "Year", "Month", "Qty"], ["a", "2024", "P1", "3"], ["a", "2024", "P1", "4"]]
    both = transform_sheets(sheet(spark, {"x": long, "y": long}), {"Brand": "Brand", "Fact": "Qty"}, 1, "Year", "Month", required=["Brand", "Fact"])
    assert rows_of(both.rows, "_sheet", "Brand", "2024-01") == [("x", "a", 7.0), ("y", "a", 7.0)]


def test_release_removes_what_a_run_stored(spark):
    out = transform_wide(make(spark, [("x",)], "Brand string"), {"Brand": "Brand", "SKU": "none"}, ["Brand", "SKU"])
    paths = [p.removeprefix("file:") for p in out.paths]
    assert len(paths) == 3 and all(os.path.isdir(p) for p in paths)
    assert out.review == ["Column 'none' mapped to 'SKU' is not in the source."]
    out.release()
    assert out.paths == [] and not any(os.path.exists(p) for p in paths)


def test_cleaning_twice_changes_nothing(spark):
    df = make(spark, [(" A  B ", "1"), ("x", " ")], "a string, b string")
    once = clean_values(df)
    assert rows_of(clean_values(once), "*") == rows_of(once, "*")


def test_profile(spark):
    out = column_profile(spark.sql("select 1 as `a.b`, cast(null as string) as c union all select 2, 'x'"))
    assert rows_of(out, "name", "dtype", "null_count", "row_count") == [("a.b", "int", 0, 2), ("c", "string", 1, 2)]


def books(spark, files):
    """A cell table of several workbooks from ``{file: {sheet: grid}}``."""
    from functools import reduce

    frames = [sheet(spark, grids).select(F.lit(file).alias("file"), "*") for file, grids in files.items()]
    return reduce(lambda a, b: a.unionByName(b), frames)


def test_workbooks_keep_their_own_rows(spark):
    """Sheets of one name in two files: own headers, own blanks, own duplicates, own row numbers."""
    north = [["Brand", "Pack"], ["a", "x"], ["", ""], ["a", "x"], ["b", "y"]]
    south = [["Pack", "brand", "file"], ["x", "a", "q"], ["", "", ""], ["x", "a", "q"]]
    cells = books(spark, {"n": {"S": north}, "s": {"S": south}})
    out = transform_sheets(cells, {"Brand": "Brand", "SKU": "Pack"}, 1, required=["Brand", "SKU"], field_kinds={"Brand": "as_is", "Pack": "as_is"})
    assert rows_of(out.rows, "_file", "_sheet", "_source_row", "Brand", "SKU") == [
        ("n", "S", 1, "a", "x"), ("n", "S", 4, "b", "y"), ("s", "S", 1, "a", "x"),
    ]
    assert rows_of(out.issues, "file", "sheet", "source_row", "issue_type") == [
        ("n", "S", 2, "NULL_ROW_REMOVED"), ("n", "S", 3, "DUPLICATE_REMOVED"),
        ("s", "S", 2, "NULL_ROW_REMOVED"), ("s", "S", 3, "DUPLICATE_REMOVED"),
    ]
    totals = out.summary.first()
    assert totals["output_rows"] + totals["total_issues_logged"] == totals["input_rows"] == 7
    out.release()
    long = [["Brand", "Year", "Month", "Qty"], ["a", "2024", "P01", "7"]]
    both = transform_sheets(books(spark, {"n": {"S": long}, "s": {"S": long}}), {"Brand": "Brand", "Fact": "Qty"}, 1, "Year", "Month", required=["Brand", "Fact"])
    assert rows_of(both.rows, "_file", "_sheet", "Brand", "2024-01") == [("n", "S", "a", 7.0), ("s", "S", "a", 7.0)]


def test_matrix_workbooks_are_not_mixed(spark):
    grid = lambda category, channel: [["", "", "", "", "", channel], *[[""]] * 3, ["2024-01", category, "B", "S", "F", "5"], ["2024-01", "Result", "", "", "", "9"]]
    cells = books(spark, {"n": {"KG": grid("Cata", "Cha")}, "s": {"KG": grid("Catb", "Chb")}})
    out = transform_matrix(cells)
    assert rows_of(out.rows, "file", "sheet", "Category", "Channel", "2024-01") == [("n", "KG", "Cata", "Cha", 5.0), ("s", "KG", "Catb", "Chb", 5.0)]
    assert rows_of(out.issues, "file", "sheet", "source_row") == [("n", "KG", 6), ("s", "KG", 6)]
    totals = out.summary.first()
    assert (totals["input_rows"], totals["output_rows"]) == (4, 2)


def test_records_of_one_workbook_or_all(spark):
    cells = books(spark, {"n": {"S": [["A"], ["1"]]}, "s": {"S": [["B", "a"], ["2", "3"]]}})
    assert rows_of(sheet_records(cells, "S", file="s"), "source_row", "B", "a") == [(1, "2", "3")]
    both = sheet_records(cells, "S")
    assert both.columns == ["file", "source_row", "A", "B"]
    assert rows_of(both, "file", "source_row", "A", "B") == [("n", 1, "1", None), ("s", 1, "3", "2")]


def test_wide_sheets_and_late_headers(spark):
    """A header row beyond those that are searched, thousands of columns, cells given twice."""
    rows = [("S", 20, i, f"c{i}") for i in range(3_000)] + [("S", 21, i, str(i)) for i in range(3_000)] + [("S", 21, 7, "0"), ("T", 1, 0, "Brand"), ("T", 2, 0, "z")]
    cells = spark.createDataFrame(rows, "sheet string, row_idx int, col_idx int, value string")
    heads = spark.createDataFrame([("S", 20), ("T", 1)], "sheet string, header_row int")
    out = sheet_union(cells, heads)
    assert len(out.columns) == 3_003
    first = out.where("sheet = 'S'").first()
    assert first["c2999"] == "2999" and first["c7"] == "0" and first["Brand"] is None
    assert rows_of(header_names(cells, heads).where("sheet = 'T' or col_idx = 5"), "sheet", "header_row", "col_idx", "name") == [("S", 20, 5, "c5"), ("T", 1, 0, "Brand")]


def test_period_map_has_no_limit(spark):
    rows = spark.range(10_002).select(
        (F.col("id") + 1).alias("source_row"), F.lit("a").alias("Brand"), (F.floor(F.col("id") / 12)).cast("string").alias("year"),
        F.concat(F.lit("P"), F.col("id") % 12 + 1).alias("month"), F.lit(2.0).alias("qty"),
    )
    run = transform_long(rows, {"Brand": "Brand", "Fact": "qty"}, "year", "month", required=["Brand", "Fact"], as_map=True)
    row = run.rows.first()
    assert len(row["periods"]) == 10_002 and set(row["periods"].values()) == {2.0} and row["periods"]["0833-06"] == 2.0
    run.release()
    few = transform_long(rows, {"Brand": "Brand", "Fact": "qty"}, "year", "month", required=["Brand"], periods=["0001-02"], as_map=True)
    assert few.rows.first()["periods"] == {"0001-02": 2.0}
    assert few.issues.where("issue_type = 'UNLISTED_PERIOD'").count() == 10_001


def test_matrix_as_map(spark):
    long = matrix_to_target(sheet(spark, {"KG": GRID})).rows
    wide, maps = matrix_to_wide(long), matrix_to_map(long)
    filled = lambda r: {k: v for k, v in r.items() if k[:2] == "20" and v is not None}
    place = lambda r: (r["_source_row"], r["_source_column"])
    assert {place(r): filled(r.asDict()) for r in wide.collect()} == {place(r): r["periods"] for r in maps.collect()}


def test_rollup_tells_nulls_from_totals(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", "x", 2.0), (None, "x", 4.0)], "Channel string, Brand string, `2024-01` double")
    got = rows_of(totals_rollup(df, ["Channel", "Brand"], ["2024-01"]), "_level", "Channel", "Brand", "row_count", "2024-01")
    assert got == [
        (0, None, None, 3, 7.0), (1, "a", None, 2, 3.0), (1, None, None, 1, 4.0),
        (2, "a", "x", 1, 2.0), (2, "a", None, 1, 1.0), (2, None, "x", 1, 4.0),
    ]


def test_runs_as_one_dataset(spark, tmp_path):
    folder = str(tmp_path / "runs")
    run = lambda brand, column: spark.createDataFrame([(brand, 1.0, 1)], f"Brand string, `{column}` double, _source_row bigint")
    write_run(run("old", "2024-01"), folder, 1)
    write_run(run("b", "2024-02"), folder, 2)
    kept = sorted(p.name for p in (tmp_path / "runs" / "job_id=2").glob("*.parquet"))
    write_run(run("new", "2024-01"), folder, 1)
    assert sorted(p.name for p in (tmp_path / "runs" / "job_id=2").glob("*.parquet")) == kept
    runs = read_runs(spark, folder)
    assert rows_of(runs, "job_id", "Brand", "2024-01", "2024-02") == [(1, "new", 1.0, None), (2, "b", None, 1.0)]
    plan = runs.where("job_id = 2")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(job_id" in plan


def test_summary_counts_come_from_the_writes(spark):
    """The summary reads neither the source nor the stored output again; empty runs count 0."""
    df = make(spark, [("a", "1"), (None, None), ("a", "1"), ("b", "x")], "Brand string, Qty string")
    run = transform_wide(df, {"Brand": "Brand", "Fact": "Qty"}, required=["Brand"])
    totals = run.summary.first()
    assert (totals["input_rows"], totals["output_rows"], totals["null_cells_in_source"]) == (4, 2, 2)
    plan = run.summary._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    rows_path = next(p for p in run.paths if "/rows-" in p).rsplit("/", 1)[1]
    assert rows_path not in plan
    empty = transform_wide(df.where("source_row < 0"), {"Brand": "Brand"}, required=["Brand"]).summary.first()
    assert (empty["input_rows"], empty["output_rows"], empty["total_issues_logged"]) == (0, 0, 0)
    nothing = spark.createDataFrame([], "source_row bigint, Brand string, Qty string")
    assert transform_wide(nothing, {"Brand": "Brand"}, required=["Brand"]).summary.first()["input_rows"] == 0


def test_counts_of_a_write_that_runs_again(spark):
    from tablesmith.session import materialize_counted

    rows = spark.range(0, 1_000, 1, 7).withColumn("k", F.col("id") % 5)
    stored, seen = materialize_counted(rows.groupBy("k").agg(F.sum("id").alias("s")), "counted", n=F.count("*"), total=F.sum("s"))
    assert stored.count() == seen["n"] == 5 and seen["total"] == 499_500
    stored.collect()
    assert seen == {"n": 5, "total": 499_500}


def test_many_periods_are_not_one_generated_method(spark):
    """A projection of a column per period stays out of the method of its stage, which the JVM would not compile."""
    periods = [f"{y}-{m:02d}" for y in range(2000, 2007) for m in range(1, 13)]
    long = spark.createDataFrame([("KG", p, float(i)) for i, p in enumerate(periods)], "sheet string, period string, value double")
    wide = matrix_to_wide(long, periods)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert next(line for line in plan.splitlines() if "2000-01" in line).lstrip(" +-:").startswith("Project")
    got = [tuple(r) for r in wide.collect()]
    assert sorted(got, key=lambda r: [v is None for v in r]) == [("KG", *[float(i) if i == j else None for j in range(84)]) for i in range(84)]


def test_matrix_log_reads_the_stored_values(spark):
    """Cells that are no numbers are logged from the stored rows: no value is parsed twice. Names are escaped in the trace."""
    rows = [("B", 1, 5, "Web"), ("B", 5, 0, "2024-01"), ("B", 5, 1, "Dry"), ("B", 5, 3, "S"), ("B", 5, 5, "n/a"), ("B", 5, 6, "2"), ("B", 6, 1, "Result")]
    cells = spark.createDataFrame([(f'a"{s}', r, c, v) for s, r, c, v in rows], "sheet string, row_idx int, col_idx int, value string")
    run = transform_matrix(cells, periods=["2024-01"])
    assert "Generate" not in run.issues._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["source_row"], r["issue_type"]) for r in run.issues.collect()) == [(5, "INVALID_FACT"), (6, "AGGREGATE_ROW")]
    traces = {r["_source_column"]: json.loads(r["_source_trace"]) for r in run.rows.collect()}
    assert traces[6] == {"Category": "B", "Brand": "C", "SKU": "D", "Channel": "G header rows 1", "Fact": 'a"B sheet'}
    run.release()


def test_text_cells_travel_as_one(spark):
    """One Arrow column for all text cells of a row, and each cell as the rule has it, whatever its neighbours hold."""
    odd = ["ok", "", None, " a", "a ", "a  b", "a\tb", "\x00", "|", "| x |", "x ", "ﬁ", "e\x00́", "́", "１", '"\\', "[]"]
    rows = [(i, odd[i], odd[i * 7 % len(odd)], "plain", odd[(i * 5 + 3) % len(odd)]) for i in range(len(odd))]
    df = spark.createDataFrame(rows, "source_row bigint, a string, b string, c string, d string")
    out = clean_values(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [normalize(") == 1 and plan.count("normalize(") == 1
    each = df.select("source_row", *[clean_value(F.col(n)).alias(n) for n in "abcd"])
    assert rows_of(out, "source_row", "a", "b", "c", "d") == rows_of(each, "source_row", "a", "b", "c", "d")


def test_rows_of_sheets_meet_names_not_cells(spark):
    """The names are joined with whole rows; cells given twice, without a place or without a value change nothing else."""
    rows = [("S", 1, 0, "A"), ("S", 1, 2, "C"), ("S", 2, 2, "z"), ("S", 2, 0, "b"), ("S", 2, 0, "a"), ("S", 2, 0, None), ("S", 3, 1, None), ("S", 4, None, "lost")]
    out = sheet_union(spark.createDataFrame(rows, "sheet string, row_idx int, col_idx int, value string"))
    assert rows_of(out, "source_row", "A", "Column_2", "C") == [(1, "a", None, "z"), (2, None, None, None)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")
