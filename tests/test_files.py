"""File scans and sinks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from checks.files import _write_lines
from tablesmith.operators.cleaning import clean_rows, issue_log
from tablesmith.operators.reconcile import reconciliation
from tablesmith.sinks.tables import run_report, write_csv, write_issue_log, write_report
from tablesmith.sources.cells import catalog_of, catalog_of_cells, header_names, header_rows, sheet_records, sheet_union
from tablesmith.session import release
from tablesmith.sources.delimited import catalog_of_files, read_numbered
from tablesmith.sources.files import (
    header_kinds,
    read_csv,
    read_delimited,
    read_json,
    read_table,
    read_tsv,
    read_xml,
    sample,
    sample_file,
    unique_names,
)
from tablesmith.sources.json_lists import TASKS_PER_CORE, json_lines
from tablesmith.sources.numbering import number_parquet_rows, number_text_rows, repeated_ids

from tests.test_tables import sheet


def test_unique_names():
    assert unique_names(["A", "A", None, "A", " a ", "City/State", "01.2020"]) == ["A", "A_2", "Column_3", "A_3", "a_4", "City/State", "01.2020"]
    assert unique_names(["A", "A_2", "A"]) == ["A", "A_2", "A_3"]
    assert unique_names(["A", "A", "A_2", "Sheet", "a"], ["sheet"]) == ["A", "A_2", "A_2_2", "Sheet_2", "a_3"]


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Code,Brand,Brand,\n007,"x, ""y""",b,1\n,,,\n')
    df = read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["Code", "Brand", "Brand_2", "Column_4", "_misfit"]
    assert [tuple(r) for r in df.collect()][0] == ("007", 'x, "y"', "b", "1", None)
    (tmp_path / "a.txt").write_text("a,b\n1,2\n")
    assert read_table(spark, str(tmp_path / "a.txt"), misfit=None).columns == ["a", "b"]
    (tmp_path / "a.tsv").write_text("a\tb.c\n1\t2\n")
    assert [tuple(r) for r in read_tsv(spark, str(tmp_path / "a.tsv"), misfit=None).collect()] == [("1", "2")]
    assert read_delimited(spark, str(tmp_path / "a.txt"), header=False).columns == ["Column_1", "Column_2", "_misfit"]
    assert sample(df, 1).count() == 1
    (tmp_path / "b.csv").write_text('a,b\n"1\n2",3\n')
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "b.csv"), multi_line=True).collect()] == [("1\n2", "3", None)]


def test_json_shapes(spark, tmp_path):
    texts = {
        "list": '[{"a": "007", "b": 1}, {"a": "x", "b": null}]', "data": '{"n": 2, "data": [{"a": "007", "b": 1}, {"a": "x"}]}',
        "rows": '{"rows": [{"a": "007", "b": 1}, {"a": "x"}]}', "lines": '{"a": "007", "b": 1}\n{"a": "x"}\n',
    }
    for name, content in texts.items():
        path = tmp_path / f"{name}.json"
        path.write_text(content)
        df = read_json(spark, str(path), lines=name == "lines")
        assert sorted(map(tuple, df.select("a", "b").collect())) == [("007", "1"), ("x", None)], name
    (tmp_path / "one.json").write_text('{"a": "x", "b": 2}')
    assert [tuple(r) for r in read_json(spark, str(tmp_path / "one.json")).collect()] == [("x", "2")]


def test_json_loses_nothing(spark, tmp_path):
    texts = {
        "own": '[{"a": 1, "data": [{"q": 1}]}, {"a": 2}]', "case": '[{"Brand": 1, "brand": 2}]',
        "deep": '{"a": {"b": [1, 2]}, "c": "x"}', "lines": '{"a": 1, "data": [{"q": 1}]}\n{"a": 2}\n',
    }
    for name, content in texts.items():
        (tmp_path / f"{name}.json").write_text(content)
    rows = lambda name, **options: sorted(map(tuple, read_json(spark, str(tmp_path / f"{name}.json"), **options).collect()))
    assert rows("own") == [("1", '[{"q":"1"}]'), ("2", None)]
    assert read_json(spark, str(tmp_path / "case.json")).columns == ["Brand", "brand_2"] and rows("case") == [("1", "2")]
    assert rows("deep") == [('{"b":["1","2"]}', "x")]
    assert rows("lines", lines=True) == [("1", '[{"q":"1"}]'), ("2", None)]
    assert rows("lines", lines=True, schema="a string") == [("1",), ("2",)]
    (tmp_path / "mixed").mkdir()
    for i, content in enumerate(['{"data": [{"q": 1}]}', '[{"data": [{"q": 2}]}]']):
        (tmp_path / "mixed" / f"{i}.json").write_text(content)
    with pytest.raises(ValueError, match="some files are lists"):
        read_json(spark, str(tmp_path / "mixed"))


def test_files_with_different_headers(spark, tmp_path):
    """Cells go by name, whatever the order, case or number of columns of a file."""
    (tmp_path / "a.csv").write_text("Pais,Marca\nx,y\n")
    (tmp_path / "b.csv").write_text("\n\ufeffmarca,PAIS,Extra\ny1,x1,z\n")
    (tmp_path / "c.csv").write_text("Pais,Marca\nx2,y2\n")
    (tmp_path / "d.csv").write_text("")
    df = read_csv(spark, str(tmp_path))
    assert df.columns == ["Pais", "Marca", "Extra", "_misfit"]
    assert sorted(map(tuple, df.collect())) == [("x", "y", None, None), ("x1", "y1", "z", None), ("x2", "y2", None, None)]
    assert header_kinds(spark, str(tmp_path)).keys() == {"Pais,Marca", "marca,PAIS,Extra"}
    numbered = read_numbered(spark, str(tmp_path))
    assert sorted(map(tuple, numbered.collect())) == [(1, "x", "y", None, None), (2, "x1", "y1", "z", None), (3, "x2", "y2", None, None)]
    each = read_numbered(spark, str(tmp_path), across_files=False)
    assert sorted((r["source_row"], r["file"][-5:]) for r in each.collect()) == [(1, "a.csv"), (1, "b.csv"), (1, "c.csv")]


def test_surplus_cells_are_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n1,2,3\n\n4\n")
    rows = [("1", "2", "1,2,3"), ("1", "2", None), ("4", None, "4")]
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "a.csv")).collect()), key=str) == rows
    assert read_csv(spark, str(tmp_path / "a.csv"), misfit="rest").columns == ["a", "b", "rest"]
    source = number_text_rows(read_csv(spark, str(tmp_path / "a.csv")))
    out = clean_rows(source)
    assert out.rows.columns == ["source_row", "a", "b"]
    assert sorted((r["source_row"], r["detail"].split(": ")[1]) for r in out.issues.where("issue_type = 'RAGGED_ROW'").collect()) == [(2, "1,2,3"), (3, "4")]


def test_numbers_follow_the_lines(spark, tmp_path):
    """Blank lines count, over many splits and several files; headers do not."""
    lines = [["", " "][i % 2] if i % 7 == 3 else f'{i},"{"x" * (i % 60)},"' for i in range(1, 20_001)]
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text("\n".join(["", "n,text", *lines]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    paths = []
    try:
        rows = {r["source_row"]: r["n"] for r in read_numbered(spark, str(tmp_path), paths=paths).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows == {i + k * 20_000: None if i % 7 == 3 else str(i) for i in range(1, 20_001) for k in (0, 1)}
    assert len(paths) >= 3
    release(spark, paths)
    assert not list((tmp_path / "none").glob("*"))


def test_blank_lines_are_logged(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Brand,Qty\n\nx,1\n  \nx,1\ny,2,z\n")
    out = clean_rows(read_numbered(spark, str(tmp_path / "a.csv")), {"Qty": "number"})
    log = sorted((r["source_row"], r["issue_type"]) for r in out.issues.collect())
    assert log == [(1, "NULL_ROW_REMOVED"), (3, "NULL_ROW_REMOVED"), (4, "DUPLICATE_REMOVED"), (5, "RAGGED_ROW")]
    assert sorted(map(tuple, out.rows.collect())) == [(2, "x", 1.0), (5, "y", 2.0)]


def test_numbered_files_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n \n")
    (tmp_path / "b.csv").write_text("a,a\n")
    assert read_numbered(spark, str(tmp_path / "a.csv")).collect() == []
    empty = read_numbered(spark, str(tmp_path / "b.csv"))
    assert empty.columns == ["source_row", "a", "a_2", "_misfit"] and empty.collect() == []
    (tmp_path / "c.csv").write_text("1;2\n\n3;4")
    got = read_numbered(spark, str(tmp_path / "c.csv"), sep=";", header=False).collect()
    assert sorted(map(tuple, got)) == [(1, "1", "2", None), (2, None, None, None), (3, "3", "4", None)]


def test_sample_without_a_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,x\n1,2\n")
    (tmp_path / "b.csv").write_text("x,y\n1,2\n3,4\n")
    assert [tuple(r) for r in sample_file(spark, str(tmp_path / "a.csv")).collect()] == [("x", "x"), ("1", "2")]
    assert [tuple(r) for r in sample_file(spark, str(tmp_path / "b.csv"), n=1).collect()] == [("1", "2")]


def test_log_over_two_files_is_complete(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Brand,Qty\nx,1\nx,1\ny,2\n")
    (tmp_path / "b.csv").write_text("Brand,Qty\ny,2\nz,3\n")
    source = number_text_rows(read_csv(spark, str(tmp_path)))
    out = clean_rows(source, {"Qty": "number"})
    assert out.rows.count() + out.issues.count() == 5
    assert sorted(r["source_row"] for r in out.issues.collect()) == [2, 4]
    assert repeated_ids(source, ["source_row"]).count() == 0
    assert repeated_ids(number_text_rows(read_csv(spark, str(tmp_path)), across_files=False), ["source_row"]).count() == 2


def test_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<t xmlns:n="u"><row id="1"><n:Code>007</n:Code><Qty>1.50</Qty></row><row><n:Code>x</n:Code></row></t>')
    df = read_xml(spark, str(tmp_path / "a.xml"), "row")
    assert sorted(df.columns) == ["Code", "Qty"]
    assert sorted(map(tuple, df.select("Code", "Qty").collect())) == [("007", "1.50"), ("x", None)]


def test_text_row_numbers_follow_the_file(spark, tmp_path):
    path = str(tmp_path / "big.csv")
    with open(path, "w") as f:
        f.write("n,text\n" + "".join(f"{i},{'x' * (i % 70)}\n" for i in range(1, 20001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        df = read_csv(spark, path)
        assert df.rdd.getNumPartitions() > 3
        numbered = number_text_rows(df)
        assert numbered.where("source_row <> cast(n as bigint)").count() == 0
        assert numbered.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_row_numbers_over_several_files(spark, tmp_path):
    for i, count in enumerate([3, 2, 4]):
        (tmp_path / f"part{i}.csv").write_text("n\n" + "".join(f"{i}{j}\n" for j in range(count)))
    path = str(tmp_path / "*.csv")
    each = number_text_rows(read_csv(spark, path), across_files=False)
    assert sorted(r[0] for r in each.select("source_row").collect()) == [1, 1, 1, 2, 2, 2, 3, 3, 4]
    all_rows = number_text_rows(read_csv(spark, path), across_files=True)
    assert [tuple(r)[:2] for r in all_rows.orderBy("source_row").collect()] == list(zip(range(1, 10), ["00", "01", "02", "10", "11", "20", "21", "22", "23"]))


def test_parquet_row_numbers(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(100).repartitionByRange(4, "id").sortWithinPartitions("id").write.parquet(path)
    numbered = number_parquet_rows(spark.read.parquet(path), across_files=True)
    assert numbered.where("source_row <> id + 1").count() == 0
    assert number_parquet_rows(spark.read.parquet(path), across_files=False).agg({"source_row": "max"}).first()[0] < 100


def test_clean_run_still_has_a_log_header(spark, tmp_path):
    issues = issue_log(spark.range(1).withColumnRenamed("id", "source_row").where("source_row < 0"), "AGGREGATE_ROW")
    write_issue_log(issues, str(tmp_path / "log"))
    df = read_csv(spark, str(tmp_path / "log"))
    assert df.columns == ["source_row", "issue_type", "detail", "_misfit"] and df.count() == 0


def test_empty_output_keeps_its_columns(spark, tmp_path):
    write_csv(spark.sql("select 'a' as Brand, 1 as `2024-01`, 1 as _source_row").where("Brand = ''"), str(tmp_path / "out"))
    assert read_csv(spark, str(tmp_path / "out"), misfit=None).columns == ["Brand", "2024-01"]


def test_header_detection_on_a_short_sheet(spark):
    cells = sheet(spark, {"s": [["Report", None], ["Country", "Brand"], ["x", "y"]], "empty": [["", ""]]})
    assert sorted(map(tuple, header_rows(cells).collect())) == [("empty", 1, 0), ("s", 2, 8)]
    assert sorted(map(tuple, header_names(cells, header_rows(cells)).where("sheet = 's'").collect())) == [("s", 2, 0, "Country"), ("s", 2, 1, "Brand")]


def test_sheet_records(spark):
    cells = sheet(spark, {"s": [["title"], ["A", "A", "", "A"], ["1", None, "3", "4"], ["5"]]})
    for header in (2, header_rows(cells).selectExpr("sheet", "2 as header_row", "score")):
        df = sheet_records(cells, "s", header)
        assert df.columns == ["source_row", "A", "A_2", "Column_3", "A_3"]
        assert sorted(map(tuple, df.collect())) == [(1, "1", None, "3", "4"), (2, "5", None, None, None)]


def test_no_cell_of_a_sheet_is_lost(spark):
    grid = [["Brand", "Brand", "Brand_2"], ["x", "y", "z", "beyond"], [None, None, None, "alone"]]
    other = [["note"], ["brand", "source_row", "sheet"], ["p", "q", "r"]]
    cells = sheet(spark, {"a": grid, "b": other})
    df = sheet_union(cells, header_rows(cells).selectExpr("sheet", "if(sheet = 'a', 1, 2) as header_row", "score"))
    rows = {(r["sheet"], r["source_row"]): [v for v in r[2:] if v is not None] for r in df.collect()}
    assert {k: sorted(v) for k, v in rows.items()} == {("a", 1): ["beyond", "x", "y", "z"], ("a", 2): ["alone"], ("b", 1): ["p", "q", "r"]}
    assert sorted(n.lower() for n in df.columns) == sorted({n.lower() for n in df.columns})
    assert sheet_records(cells, "a", 1).columns == ["source_row", "Brand", "Brand_2", "Brand_2_2", "Column_4"]


def test_catalogs(spark):
    df = spark.sql("select 'x' as Pais, 2024 as `Display Year` union all select null, 2025")
    got = {r["col_name"]: (r["file"], r["sheet"], r["col_pos"], sorted(r["sample"])) for r in catalog_of(df, "f.csv").collect()}
    assert got == {"Pais": ("f.csv", "data", 0, ["x"]), "Display Year": ("f.csv", "data", 1, ["2024", "2025"])}
    cells = sheet(spark, {"s": [["Report"], ["Country", "Brand", ""], ["x", "y", "1"], ["z", "", "2"]], "Guide": [["Brand"]]})
    rows = catalog_of_cells(cells.selectExpr("'w.xlsx' as file", "*")).collect()
    assert sorted((r["file"], r["sheet"], r["col_pos"], r["col_name"], r["sample"]) for r in rows) == [
        ("w.xlsx", "s", 0, "Country", ["x", "z"]), ("w.xlsx", "s", 1, "Brand", ["y"]), ("w.xlsx", "s", 2, "Column_3", ["1", "2"]),
    ]


def test_report(spark, tmp_path):
    summary = metric_summary(spark)
    report = run_report(summary, {"Brand": "marca"}, ["Brand", "SKU"], "wide_period", ["look"], 1.5)
    write_report(report, str(tmp_path / "r"))
    line = json.loads(spark.read.text(str(tmp_path / "r")).first()[0])
    assert line["mapping"] == {"Brand": "marca", "SKU": None} and line["review"] == ["look"] and line["input_rows"] == 2


def metric_summary(spark):
    rows = spark.sql("select 1 as source_row, 'x' as Brand union all select 2, 'x'")
    totals = spark.sql("select 2L as input_rows, 0L as null_cells_in_source")
    return reconciliation(totals, rows, issue_log(rows, "DUPLICATE_REMOVED"), 1, "f")


def test_catalog_of_many_files_is_one_job(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"{i:03}.csv").write_text(f'Brand,"Qty, {i % 2}",brand\n\n' + "".join(f'b{j},{j},"x ""{i}"""\n' for j in range(20)))
    (tmp_path / "empty.csv").write_text("\n")
    spark.sparkContext.setJobGroup("catalog", "catalog")
    try:
        got = catalog_of_files(spark, str(tmp_path), n=3).collect()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("catalog")) <= 2
    finally:
        spark.sparkContext.setJobGroup("", "")
    one = {r["col_pos"]: (r["col_name"], r["sample"]) for r in got if r["file"].endswith("/007.csv")}
    assert len(got) == 900 and one == {0: ("Brand", ["b0", "b1", "b2"]), 1: ("Qty, 1", ["0", "1", "2"]), 2: ("brand_2", ['x "7"'] * 3)}


@pytest.mark.parametrize("split_bytes", [60, 700, 10**9])
def test_json_lists_over_many_splits(spark, tmp_path, split_bytes):
    """The same rows as one task reads, wherever the file is cut: in strings, escapes, nested objects, between rows."""
    dice = random.Random(11)
    odd = ['plain', 'a } brace', '{ "quoted" }', 'back\\slash', 'end\\', '"', '\\"}', 'é {日本} 😀', '', 'two\nlines', '}{][,']
    rows = [
        {"a": str(i), "b": dice.choice(odd), "c": {"d": dice.choice(odd), "e": [{"f": dice.choice(odd)}] * dice.randint(0, 2)}, dice.choice(odd[:3]): "x"}
        for i in range(24)
    ]
    for name, layout in (("a", {"indent": 2}), ("b", {"separators": (",", ":"), "ensure_ascii": False})):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows if name == "a" else rows[::-1], **layout))
    (tmp_path / "c.json").write_text(" [ ]\n")
    (tmp_path / "d.json").write_text("[1, {}, [2]]")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    paths = []
    try:
        assert split_bytes > 100 or spark.read.text(str(tmp_path / "a.json")).rdd.getNumPartitions() > 20
        got = [json.loads(r[0]) for r in spark.read.text(json_lines(spark, str(tmp_path), paths=paths)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    key = lambda r: json.dumps(r, sort_keys=True)
    assert sorted(map(key, got)) == sorted(map(key, [*rows, *rows, {}]))
    release(spark, paths)


def test_json_list_as_a_table(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": "007", "b": 1, "c": {"x": "}"}},\n {"a": null, "B": 2}]')
    whole, cut = read_json(spark, str(tmp_path / "a.json")), read_json(spark, str(tmp_path / "a.json"), split=True)
    assert whole.columns == cut.columns and sorted(map(tuple, cut.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_many_small_splits_share_tasks(spark, tmp_path):
    """So many splits that a task each would mostly start tasks: several are read by one."""
    (tmp_path / "a.json").write_text(json.dumps([{"a": str(i), "b": "}{"} for i in range(3000)], indent=1))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    paths = []
    try:
        splits = spark.read.text(str(tmp_path / "a.json")).rdd.getNumPartitions()
        got = spark.read.text(json_lines(spark, str(tmp_path), paths=paths)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    stored = next(p for p in paths if "json-objects" in p)
    assert sorted(json.loads(r[0])["a"] for r in got) == sorted(map(str, range(3000)))
    assert splits > 400 and len(spark.read.parquet(stored).inputFiles()) <= TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    release(spark, paths)


def test_fixture_lines_are_written_by_ranges(spark, tmp_path):
    """Files in the order of the keys, each with its own header and footer: no task sorts the whole table."""
    lines = spark.range(4000, -1, -1).select(F.col("id").alias("key"), F.col("id").cast("string").alias("line"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _write_lines(lines, str(tmp_path / "rows"), "[", "]", ", ")
        _write_lines(lines.where("key < 0"), str(tmp_path / "none"), "[", "]", ", ")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    texts = [json.loads(f.read_text()) for f in sorted((tmp_path / "rows").glob("part-*"))]
    assert len(texts) > 1 and max(map(len, texts)) < 2000
    assert [n for text in texts for n in text] == list(range(4001))
    assert all(json.loads(f.read_text()) == [] for f in (tmp_path / "none").glob("part-*"))
