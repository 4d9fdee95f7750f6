"""Delimited files line by line: every row knows its place in the file, blank lines included."""

import csv

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablesmith.operators.lookup import lookup_join
from tablesmith.schema import MISFIT, ROW_ID, quoted
from tablesmith.session import compute_once, materialize
from tablesmith.sources.files import unique_names
from tablesmith.sources.numbering import piece_offsets

BOM = "﻿"


def _parsed(value: Column, names: list[str], columns: list[str], sep: str, misfit: str) -> Column:
    """A line as a struct of ``columns``; those that its header lacks are null, and all are on a blank line."""
    options = {"sep": sep, "escape": '"', "columnNameOfCorruptRecord": misfit}
    fields = ", ".join(f"{quoted(n)} STRING" for n in [*names, misfit])
    row = F.from_csv(F.when(F.trim(value, F.lit(" \t")) != "", value), fields, options)
    own = {n.lower(): n for n in names}
    cell = lambda n: row[own[n.lower()]] if n.lower() in own else F.lit(None).cast("string")
    return F.struct(*[cell(n).alias(n) for n in columns], row[misfit].alias(misfit))


def read_numbered(
    spark: SparkSession,
    path: str | list[str],
    sep: str = ",",
    encoding: str = "UTF-8",
    header: bool = True,
    misfit: str = MISFIT,
    row_id: str = ROW_ID,
    across_files: bool = True,
    paths: list[str] | None = None,
) -> DataFrame:
    """Delimited files as text columns with ``source_row``: the rows' places after the header, from 1.

    A blank line is a row of nulls with a number of its own, so the numbers of all others agree
    with the file. Numbers run on over the files in path order; without ``across_files`` they
    restart in each, and the column ``file`` names it. A file's header is its first line that
    is not blank; files of different headers are put together by column name, without regard
    to case. ``misfit`` has the whole text of rows with more or fewer cells than their header.

    The text is read once and stored line by line with file, split and position; passes over
    that find the row counts of the splits and the headers, and rows are parsed from there, so files
    of any size are split over tasks and lost executors change no number. Cells with line
    breaks in them need :func:`tablesmith.sources.files.read_delimited`.
    """
    text = spark.read.option("encoding", encoding).text(path)
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    lines = text.select(*place, F.monotonically_increasing_id().alias("_at"), "value")
    lines = materialize(lines.withColumn("_piece", F.xxhash64("_file", "_block")), "lines", paths)
    filled = F.trim("value", F.lit(f" \t{BOM}")) != ""
    # Only places are compared here: a least text would have every task sort its lines.
    head = F.min(F.when((F.col("_block") == 0) & filled, F.col("_at")))
    pieces = lines.groupBy("_piece", "_file", "_block").agg(F.min("_at").alias("_from"), F.max("_at").alias("_to"), head.alias("_at"))
    # The first row of a file stands below its header.
    first = F.when(F.col("_block") == 0, F.coalesce(F.col("_at"), F.col("_to")) + 1) if header else F.lit(None)
    pieces = pieces.withColumn("_first", F.coalesce(first, "_from")).withColumn("_rows", F.col("_to") - F.col("_first") + 1)
    pieces = materialize(pieces, "pieces", paths)
    starts = lines.where("_block = 0").select("_piece", "_at", F.ltrim("value", F.lit(BOM)).alias("_head"))
    heads = lookup_join(starts, pieces.where("_at is not null").select("_piece", "_file", "_at"), ["_piece", "_at"], F.col("_at"), paths=paths)
    heads = materialize(heads.select("_file", "_head"), "heads", paths)
    found = [r["_head"] for r in heads.groupBy("_head").agg(F.min("_file").alias("f")).orderBy("f").collect()]
    names = [unique_names(cells if header else [None] * len(cells), [misfit, row_id, "file"]) for cells in csv.reader(found, delimiter=sep)]
    first_of: dict[str, str] = {}
    for name in (n for own in names for n in own):
        first_of.setdefault(name.lower(), name)
    columns = list(first_of.values())
    if not found:
        empty = "".join(f", {quoted(n)} string" for n in ([] if across_files else ["file"]) + [misfit])
        return spark.createDataFrame([], f"{quoted(row_id)} bigint{empty}")
    kinds = spark.createDataFrame([(h, i) for i, h in enumerate(found)], "_head string, _kind int")
    files = heads.join(F.broadcast(kinds), "_head").select("_file", "_kind")
    placed = piece_offsets(pieces, ["_file", "_block"], across_files, paths).join(pieces.select("_piece", "_file"), "_piece").join(files, "_file")
    rows = lookup_join(lines.drop("_file"), placed, ["_piece"], F.col("_at"), paths=paths).where(F.col("_at") >= F.col("_first"))
    parsed = [F.when(F.col("_kind") == i, _parsed(F.col("value"), own, columns, sep, misfit)) for i, own in enumerate(names)]
    number = (F.col("_at") - F.col("_first") + F.col("_offset") + 1).alias(row_id)
    source = [] if across_files else [F.col("_file").alias("file")]
    out = compute_once(rows, [number, *source, F.coalesce(*parsed).alias("_row")])
    return out.select(row_id, *([] if across_files else ["file"]), *[F.col("_row")[n].alias(n) for n in [*columns, misfit]])


def catalog_of_files(spark: SparkSession, path: str | list[str], sep: str = ",", encoding: str = "UTF-8", n: int = 12, sheet: str = "data") -> DataFrame:
    """The column catalog of all files at once: ``(file, sheet, col_pos, col_name, sample)``.

    One job takes the first lines of every file that are not blank: its header and ``n`` rows.
    The limit per file is applied before anything is shuffled. Empty files have no columns.
    """
    text = spark.read.option("encoding", encoding).text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")]
    # A file's first lines are in its first split, or, if lines are very long, in the next ones.
    filled = text.select(*place, "value").where(F.trim("value", F.lit(f" \t{BOM}")) != "")
    order = Window.partitionBy("file").orderBy("_block", "_at")
    first = filled.withColumn("_row", F.row_number().over(order)).where(F.col("_row") <= n + 1)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_row", "value"))), lambda r: r["value"]).alias("lines")

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for file, own in zip(batch["file"].to_pylist(), batch["lines"].to_pylist()):
                header, *rows = csv.reader([own[0].lstrip(BOM), *own[1:]], delimiter=sep)
                for i, name in enumerate(unique_names(header)):
                    out.append((file, i, name, [r[i] if i < len(r) and r[i] != "" else None for r in rows]))
            types = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.string())]
            fields = ["file", "col_pos", "col_name", "sample"]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names=fields)

    found = first.groupBy("file").agg(lines).mapInArrow(columns, "file string, col_pos int, col_name string, sample array<string>")
    return found.select("file", F.lit(sheet).alias("sheet"), "col_pos", "col_name", F.array_compact("sample").alias("sample"))
