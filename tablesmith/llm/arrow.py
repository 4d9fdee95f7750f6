"""Arrow batches in and out of Python functions, a few megabytes of text at a time."""

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Texts handed to a function at once; one longer text is handed over alone.
SLICE_BYTES = 4_000_000


def field(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column, or a field of a struct column as ``column.field``."""
    first, *inner = name.split(".")
    return pc.struct_field(batch.column(first), inner) if inner else batch.column(first)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut so that each part holds about ``most`` bytes of ``column``."""
    sizes = pc.binary_length(field(batch, column)).fill_null(0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size + 16
    if start < len(sizes):
        yield batch.slice(start)


def map_texts(df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str, column: str = "text") -> DataFrame:
    """Apply ``function`` to slices of ``df``; it returns the output columns by name."""
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                out = function(part)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in fields], schema=fields)

    return df.mapInArrow(run, schema)
