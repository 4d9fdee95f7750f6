"""Names shared by all operators: target columns, issue types, issue schema."""

from pyspark.sql import types as T

# The target dimensions and the measure, in output order.
TARGET_COLUMNS = ["Country", "Region", "Channel", "City/State", "Category", "Brand", "SKU", "Fact"]

# Issue types and the detail text that goes with each of them.
NULL_ROW = "NULL_ROW_REMOVED"
AGGREGATE_ROW = "AGGREGATE_ROW"
DUPLICATE = "DUPLICATE_REMOVED"
INVALID_PERIOD = "INVALID_PERIOD"
INVALID_FACT = "INVALID_FACT"
UNLISTED_PERIOD = "UNLISTED_PERIOD"
RAGGED_ROW = "RAGGED_ROW"
DETAILS = {
    NULL_ROW: "Entirely blank row removed",
    AGGREGATE_ROW: "Subtotal/Result/Total row excluded",
    DUPLICATE: "Exact duplicate row removed",
    INVALID_PERIOD: "Could not parse year/period",
    INVALID_FACT: "Could not parse a number",
    UNLISTED_PERIOD: "Period is not among the requested ones",
    RAGGED_ROW: "Row has more or fewer cells than the header",
}
# Fixed value: the detail text of sub-total rows in matrix sheets.
MATRIX_RESULT = "Result row excluded from atomic output"

ROW_ID = "source_row"
SHEET = "sheet"
# The whole text of a delimited row that does not fit its header; it is no data column.
MISFIT = "_misfit"

ISSUE_SCHEMA = T.StructType(
    [
        T.StructField(ROW_ID, T.LongType()),
        T.StructField("issue_type", T.StringType()),
        T.StructField("detail", T.StringType()),
    ]
)


def quoted(name: str) -> str:
    """Back-quote a column name, so that dots, commas and slashes in headers are safe."""
    return "`" + name.replace("`", "``") + "`"


def same_name(a: str, b: str) -> bool:
    return a.lower() == b.lower()
