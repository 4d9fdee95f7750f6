"""File scans. Every reader yields text columns with unique, case-insensitively distinct names."""

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablesmith.schema import MISFIT, quoted
from tablesmith.session import materialize
from tablesmith.sources.json_lists import json_lines


def unique_names(headers: Iterable[str | None], reserved: Iterable[str] = ()) -> list[str]:
    """Strip, name blanks ``Column_{position}``, number a taken name with the least free ``_2``, ``_3``...

    Names are told apart without regard to case, as Spark resolves them that way; they are
    never equal to a ``reserved`` one.
    """
    taken = {r.lower() for r in reserved}
    names = []
    for position, header in enumerate(headers, 1):
        base = (header or "").strip() or f"Column_{position}"
        name, n = base, 2
        while name.lower() in taken:
            name, n = f"{base}_{n}", n + 1
        taken.add(name.lower())
        names.append(name)
    return names


def _reader(spark: SparkSession, sep: str, encoding: str, multi_line: bool):
    options = {"sep": sep, "encoding": encoding, "escape": '"', "multiLine": multi_line}
    return spark.read.options(**options)


def _is_line() -> Column:
    return F.trim("value", F.lit(" \t\ufeff")) != ""


def header_kinds(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> dict[str, list[str]]:
    """The files of each header line (the first line that is not blank), found by one job that reads the text twice.

    The header lines are few, since they are the schema; the file names are those that the
    driver lists for any scan.
    """
    text = spark.read.option("encoding", encoding).text(path)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    # Only the places are compared: a least text would have every task sort its lines.
    first = lines.where(_is_line()).groupBy("file").agg(F.min("at").alias("at"))
    heads = lines.join(F.broadcast(first), ["file", "at"]).select("file", F.col("value").alias("head"))
    kinds = heads.groupBy(F.ltrim("head", F.lit("\ufeff")).alias("head")).agg(F.sort_array(F.collect_list("file")).alias("files"))
    return {r["head"]: r["files"] for r in kinds.orderBy(F.col("files")[0]).collect()}


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    sep: str = ",",
    encoding: str = "UTF-8",
    header: bool = True,
    multi_line: bool = False,
    same_header: bool = False,
    misfit: str | None = MISFIT,
) -> DataFrame:
    """Delimited files; all columns are text, so codes keep their zeros.

    Files with different header lines are read kind by kind and put together by column name; a
    column that a file lacks is null. ``same_header`` skips the job that looks at the headers
    of several files. The column ``misfit`` has the whole text of rows with more or fewer cells
    than their header, so that no cell is lost; with None it is left out, and surplus cells are
    not read. Blank lines are no rows (``read_numbered`` counts them). Without a header row the
    columns are ``Column_1``, ``Column_2``... ``multi_line`` is for quoted cells that hold line
    breaks; such a file cannot be split over tasks.
    """
    many = header and not same_header and len(spark.read.text(path).inputFiles()) > 1
    kinds = list(header_kinds(spark, path, encoding).values()) if many and not multi_line else []
    if len(kinds) > 1:
        parts = [read_delimited(spark, files, sep, encoding, same_header=True, misfit=misfit) for files in kinds]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return rows.select(*[F.col(quoted(n)) for n in rows.columns if n != misfit], *([misfit] if misfit else []))
    first = _reader(spark, sep, encoding, multi_line).csv(path).first()
    headers = list(first) if first else []
    # The header as it stands in the file: Spark would rename repeated names its own way.
    names = unique_names(headers if header else [None] * len(headers), [misfit] if misfit else [])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, *([misfit] if misfit else [])]])
    reader = _reader(spark, sep, encoding, multi_line).schema(schema).option("header", header)
    return (reader.option("columnNameOfCorruptRecord", misfit) if misfit else reader).csv(path)


def read_csv(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Comma-separated text (``.csv`` and ``.txt``)."""
    return read_delimited(spark, path, ",", **options)


def read_tsv(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    return read_delimited(spark, path, "\t", **options)


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Parquet keeps its column types."""
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def _flat(df: DataFrame, names: list[str]) -> DataFrame:
    """Unique names, and nested values as JSON text."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    text = [F.to_json(F.col(f"_{i}")) if isinstance(f.dataType, nested) else F.col(f"_{i}") for i, f in enumerate(df.schema)]
    named = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return named.select(*[c.alias(n) for c, n in zip(text, unique_names(names))])


def _is_records(df: DataFrame, name: str) -> bool:
    dtype = df.schema[name].dataType if name in df.columns else None
    return isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType)


def read_json(
    spark: SparkSession,
    path: str | list[str],
    lines: bool = False,
    records: str | None = None,
    schema: T.StructType | str | None = None,
    split: bool = False,
    paths: list[str] | None = None,
) -> DataFrame:
    """JSON records as text columns: a list of objects, or one object, or an object with a
    ``data`` or ``rows`` list of objects, which is then the table.

    ``lines`` reads one object per line, the form that Spark can split over tasks. ``split`` is
    for large files that are one list of objects: they are cut over tasks, too, and stored as
    lines first. Any other file is read by one task. ``records`` names the list
    to unfold in each line; a line without it is a row of nulls. Nested values become JSON
    text, and names that differ in case only are numbered (such a table is stored once). With ``schema`` the input is not
    read first to find its columns.
    """
    if split:
        return read_json(spark, json_lines(spark, path, paths=paths), True, records, schema)
    reader = spark.read.option("primitivesAsString", True).option("multiLine", not lines)
    old = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = (reader.schema(schema) if schema is not None else reader).json(path)
        if not lines and any(_is_records(df, n) for n in ("data", "rows")):
            signs = spark.read.option("wholetext", True).text(path).select(F.substring(F.regexp_extract("value", r"\S", 0), 1, 1))
            starts = {r[0] for r in signs.distinct().collect()}
            if starts == {"{"}:
                records = next(n for n in ("data", "rows") if _is_records(df, n))
            elif "{" in starts:
                raise ValueError("some files are lists and some are objects; read each kind on its own")
        if records is not None:
            df = df.select(F.inline_outer(quoted(records)) if lines else F.inline(quoted(records)))
        if len({n.lower() for n in df.columns}) < len(df.columns):
            # Spark would refuse such a scan later, when names are compared without case again.
            stored = materialize(df.toDF(*[f"_{i}" for i in range(len(df.columns))]), "json")
            return _flat(stored, df.columns)
        return _flat(df, df.columns)
    finally:
        spark.conf.set("spark.sql.caseSensitive", old)


def read_xml(
    spark: SparkSession, path: str | list[str], row_tag: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """XML records: each ``row_tag`` element is a row, its children are text columns.

    With ``schema`` the input is not read first to find its columns.
    """
    options = {"rowTag": row_tag, "inferSchema": False, "excludeAttribute": True}
    reader = spark.read.format("xml").options(**options)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    return df.toDF(*unique_names(n.split(":")[-1] for n in df.columns))


_READERS = {"csv": read_csv, "txt": read_csv, "tsv": read_tsv, "parquet": read_parquet, "json": read_json}


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Read by format, or by file extension if no format is given."""
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if fmt == "xml":
        return read_xml(spark, path, **options)
    if fmt not in _READERS:
        raise ValueError(f"unsupported format {fmt!r}; worksheets are read as cell tables")
    return _READERS[fmt](spark, path, **options)


def sample(df: DataFrame, n: int = 12) -> DataFrame:
    """The first rows, for a look at the layout."""
    return df.limit(n)


def sample_file(spark: SparkSession, path: str, fmt: str | None = None, n: int = 12, **options) -> DataFrame:
    """The first rows of a file; a delimited one whose first row has repeated or blank names
    is read again without a header, since that row is then no header."""
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    options = {"misfit": None, **options} if fmt in ("csv", "txt", "tsv") else options
    df = read_table(spark, path, fmt, **options)
    if fmt in ("csv", "txt", "tsv") and options.get("header", True):
        sep = options.get("sep", "\t" if fmt == "tsv" else ",")
        first = _reader(spark, sep, options.get("encoding", "UTF-8"), options.get("multi_line", False)).csv(path).first()
        names = [(h or "").strip() for h in first or []]
        if len(set(names)) < len(names) or "" in names:
            df = read_table(spark, path, fmt, **(options | {"header": False}))
    return sample(df, n)
