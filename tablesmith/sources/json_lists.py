"""Large JSON lists of objects, cut over tasks wherever a split of the file happens to end.

The text is read in chunks that end at a closing brace, which Spark splits like lines. Whether
a chunk starts inside a string, and in how many open braces, depends on all that comes before
it, but only through two numbers; each split says what it does to them, so that every split can
be read on its own once those before it are summed up.
"""

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablesmith.session import materialize, scratch_path

# Splits are read by so many tasks a core at most, several one after the other if they are small.
# A task passes its text on as it reads, so its memory does not depend on how many splits it has.
TASKS_PER_CORE = 8
_SPLIT = "file string, block bigint"
_EFFECT = "quoted int, delta int, delta_quoted int, closes string, closes_quoted string"


def _chunks(spark: SparkSession, path: str | list[str], encoding: str) -> DataFrame:
    """``file, block, value`` and how many braces a chunk opens if it starts outside or inside a string."""
    text = spark.read.option("lineSep", "}").option("encoding", encoding).text(path)
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    outside = lambda c: F.regexp_replace(c, r'"[^"]*+("|$)', "")
    opened = lambda c: (F.length(c) - F.length(F.replace(c, F.lit("{")))).cast("int")
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"')))
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value",
        (quotes % 2).cast("int").alias("odd"), opened(outside(plain)).alias("opens"),
        opened(outside(F.concat(F.lit('"'), plain))).alias("opens_quoted"),
    ).coalesce(tasks)


def _by_split(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, Iterable[tuple]]]:
    """The rows of each split; a task reads its splits one after the other."""
    rows = ((f, b, *rest) for batch in batches for f, b, *rest in zip(*(batch[c].to_pylist() for c in ("file", "block", *columns))))
    return ((key, (r[2:] for r in own)) for key, own in groupby(rows, key=lambda r: r[:2]))


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each split does to a state outside and inside a string.

    ``closes`` counts the objects that end, by the depth they end at as seen from the start.
    """
    for (file, block), rows in _by_split(batches, ["odd", "opens", "opens_quoted"]):
        inside, depth, closes = [0, 1], [0, 0], [Counter(), Counter()]
        for odd, *opens in rows:
            for start in (0, 1):
                depth[start] += opens[inside[start]]
                inside[start] ^= odd
                if not inside[start]:
                    depth[start] -= 1
                    if depth[start] <= 0:
                        closes[start][depth[start]] += 1
        texts = [",".join(f"{d}:{n}" for d, n in c.items()) for c in closes]
        yield pa.RecordBatch.from_pydict(
            {"file": [file], "block": [block], "quoted": pa.array([inside[0]], pa.int32()), "delta": pa.array([depth[0]], pa.int32()),
             "delta_quoted": pa.array([depth[1]], pa.int32()), "closes": [texts[0]], "closes_quoted": [texts[1]]}
        )


def _starts(table: pa.Table) -> pa.Table:
    """The state each split of one file starts in: inside a string or not, depth, objects so far."""
    out, quoted, depth, done = [], 0, 0, 0
    for r in sorted(table.to_pylist(), key=lambda r: r["block"]):
        out.append({"file": r["file"], "block": r["block"], "quoted": quoted, "depth": depth, "done": done})
        closes = r["closes_quoted" if quoted else "closes"]
        done += sum(int(n) for d, n in (c.split(":") for c in closes.split(",") if c) if int(d) == -depth)
        depth += r["delta_quoted" if quoted else "delta"]
        quoted ^= r["quoted"]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    return pa.table([pa.array([o[k] for o in out], t) for k, t in zip(out[0], types)], names=list(out[0]))


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file, object, block, whole, value``: objects, and the parts of those that run over a split's end."""
    columns = ["value", "odd", "opens", "opens_quoted", "quoted", "depth", "done"]
    held: list[tuple] = []

    def pack() -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        names = ["file", "object", "block", "whole", "value"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    size = 0
    for (file, block), rows in _by_split(batches, columns):
        inside = depth = done = None
        parts: list[str] = []
        for value, odd, opens, opens_quoted, *start in rows:
            if inside is None:
                inside, depth, done = start
                whole = depth == 0
            depth += opens_quoted if inside else opens
            inside ^= odd
            depth -= not inside
            parts.append(value)
            if not inside and depth == 0:
                text = "}".join([*parts, ""])
                held.append((file, done, block, whole, text[text.index("{") :] if whole else text))
                size += len(text)
                parts, whole, done = [], True, done + 1
                if size > 4_000_000:
                    yield pack()
                    held, size = [], 0
        if parts and depth > 0:
            text = "}".join([*parts, ""])
            held.append((file, done, block, False, text[text.index("{") :] if whole else text))
    if held:
        yield pack()


def json_lines(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", paths: list[str] | None = None) -> str:
    """Write the objects of JSON list files one per line, and return the folder they are in.

    Files are lists of objects in any layout; list elements that are no objects are left out.
    Both passes over the text are split over tasks. Between them goes one row per split: what it
    does to the state, which is summed up file by file; it is three numbers for each split, so
    that those of 100 TB are some 20 MB. Only the objects that a split cuts in two are shuffled.
    """
    chunks = _chunks(spark, path, encoding)
    effects = chunks.mapInArrow(_effects, f"{_SPLIT}, {_EFFECT}")
    starts = effects.groupBy("file").applyInArrow(_starts, f"{_SPLIT}, quoted int, depth int, done bigint")
    starts = materialize(starts, "json-splits", paths)
    # The broadcast join leaves the rows of a split in their order.
    placed = chunks.join(F.broadcast(starts), ["file", "block"])
    found = placed.mapInArrow(_objects, "file string, object bigint, block bigint, whole boolean, value string")
    found = materialize(found, "json-objects", paths)
    cut = found.where("not whole").groupBy("file", "object").agg(F.array_sort(F.collect_list(F.struct("block", "value"))).alias("parts"))
    joined = cut.select(F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("value"))
    folder = scratch_path(spark, "json-lines")
    if paths is not None:
        paths.append(folder)
    # A line break can only stand between the parts of an object, not inside its strings.
    found.where("whole").select("value").unionByName(joined).select(F.translate("value", "\r\n", "  ").alias("value")).write.text(folder)
    return folder
