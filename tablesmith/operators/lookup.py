"""Equi-joins with a side that is small as a rule, but may not be."""

from pyspark.sql import Column, DataFrame, functions as F

from tablesmith.schema import quoted
from tablesmith.session import materialize

# A broadcast side is at most this many bytes; beyond it the join is shuffled and salted.
MAX_BROADCAST_BYTES = 64_000_000
MAX_SALTS = 1_000


def _bytes(df: DataFrame) -> int:
    """An upper bound of the bytes of a stored table: its texts, and 16 bytes a cell."""
    size = sum((F.coalesce(F.octet_length(F.col(quoted(n)).cast("string")), F.lit(0)) for n in df.columns), F.lit(16 * len(df.columns)))
    return df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def salts_for(big: DataFrame, on: list[str]) -> int:
    """How many parts the most frequent key must be cut into to be no larger than a usual task."""
    counts = big.groupBy(*on).agg(F.count("*").alias("n")).agg(F.max("n").alias("top"), F.sum("n").alias("all")).first()
    tasks = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MAX_SALTS, max(1, -(-counts["top"] * tasks // counts["all"]))) if counts["all"] else 1


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    spread: Column,
    how: str = "inner",
    max_bytes: int = MAX_BROADCAST_BYTES,
    paths: list[str] | None = None,
) -> DataFrame:
    """Join ``small`` to ``big``: broadcast if its size allows it, else salted.

    ``small`` is stored once and measured in bytes. In the salted form every row of ``small``
    is repeated once per salt and ``spread`` (any well-mixed column of ``big``) picks the
    salt; the number of salts follows the share of the most frequent key.
    """
    small = materialize(small, "lookup", paths)
    if _bytes(small) <= max_bytes:
        return big.join(F.broadcast(small), on, how)
    salts = salts_for(big, on)
    salted = small.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    return big.withColumn("_salt", F.pmod(F.hash(spread), F.lit(salts))).join(salted, [*on, "_salt"], how).drop("_salt")
