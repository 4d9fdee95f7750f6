"""Source row numbers: the 1-based position of every row in its file, or over all files.

The CSV scan skips blank lines, so ``number_text_rows`` counts its records;
``tablesmith.sources.delimited.read_numbered`` counts blank lines as well.
"""

from pyspark.sql import DataFrame, Window, functions as F

from tablesmith.operators.lookup import lookup_join
from tablesmith.schema import ROW_ID, quoted
from tablesmith.session import materialize


def piece_offsets(pieces: DataFrame, order: list[str], across: bool, paths: list[str] | None = None) -> DataFrame:
    """``_piece, _first, _offset``: how many rows come before each piece (a file or a split of one).

    ``pieces`` is stored and has ``_piece`` (a 64-bit hash of ``order``, which must name a piece),
    ``_first`` and ``_rows``. Over all files the sums are taken within ranges of the sorted
    pieces; one number per range reaches the driver.
    """
    if not pieces.groupBy("_piece").count().where("count > 1").isEmpty():
        raise ValueError("two pieces of the input have one hash; number the files in two parts")
    before = lambda w: F.coalesce(F.sum("_rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if not across:
        inside = Window.partitionBy(order[0]).orderBy(*order)
        return pieces.select("_piece", "_first", before(inside).alias("_offset"))
    ranged = pieces.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "ranges", paths)
    sums = ranged.groupBy("_range").agg(F.sum("_rows").alias("n")).orderBy("_range").collect()
    bases, total = [], 0
    for row in sums:
        bases.append((row["_range"], total))
        total += row["n"]
    base = pieces.sparkSession.createDataFrame(bases, "_range int, _base bigint")
    inside = Window.partitionBy("_range").orderBy(*order)
    counted = ranged.withColumn("_inside", before(inside)).join(F.broadcast(base), "_range")
    return counted.select("_piece", "_first", (F.col("_inside") + F.col("_base")).alias("_offset"))


def _follow_on(placed: DataFrame, order: list[str], across: bool, row_id: str, paths: list[str] | None) -> DataFrame:
    """Turn positions ``_at`` within pieces into running positions.

    A piece is named by a 64-bit number, so the small side has three numbers per piece.
    """
    placed = placed.withColumn("_piece", F.xxhash64(*order))
    pieces = placed.groupBy("_piece", *order).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    pieces = materialize(pieces, "pieces", paths)
    joined = lookup_join(placed, piece_offsets(pieces, order, across, paths), ["_piece"], F.col("_at"), paths=paths)
    return joined.withColumn(row_id, F.col("_at") - F.col("_first") + F.col("_offset") + 1)


def number_parquet_rows(df: DataFrame, row_id: str = ROW_ID, across_files: bool = True, paths: list[str] | None = None) -> DataFrame:
    """Number the rows of a Parquet scan; the reader knows each row's position in its file.

    Numbers run on over the files in path order, so that they are unique; those of a single
    file come from the reader alone. Without ``across_files`` they restart in every file and only name a row together with its file.
    """
    if not across_files or len(df.inputFiles()) == 1:
        return df.select((F.col("_metadata.row_index") + 1).alias(row_id), "*")
    placed = df.select(F.col("_metadata.row_index").alias("_at"), F.col("_metadata.file_path").alias("_file"), "*")
    return _follow_on(placed, ["_file"], True, row_id, paths).select(row_id, *[F.col(quoted(n)) for n in df.columns])


def number_text_rows(df: DataFrame, row_id: str = ROW_ID, across_files: bool = True, paths: list[str] | None = None) -> DataFrame:
    """Number the rows of a CSV, TSV or JSON Lines scan in file order, over all files by default.

    The scan is written once to the shared folder with each row's file, split and position
    in its task. Row numbers are then sums over the splits; how a later run cuts the text
    into tasks, or whether an executor is lost, can no longer change them. Stored tables are
    added to ``paths``, for ``release``.
    """
    placed = df.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        "*",
    )
    placed = materialize(placed, "numbered", paths)
    numbered = _follow_on(placed, ["_file", "_block"], across_files, row_id, paths)
    return numbered.select(row_id, *[F.col(quoted(n)) for n in df.columns])


def repeated_ids(df: DataFrame, key: list[str]) -> DataFrame:
    """Row keys that occur more than once; cleaning needs them to be unique. Moves the keys only."""
    names = [F.col(quoted(k)) for k in key]
    return df.groupBy(*names).agg(F.count("*").alias("count")).where("count > 1")
