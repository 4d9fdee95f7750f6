"""Which hashes may be in a table: Bloom filters of a bounded size for functions that run in tasks."""

import numpy as np
from pyspark.sql import DataFrame, functions as F

# A table has at most so many bits (16 MB), however many hashes there are.
MOST_BITS = 2**27
# Bits per hash while that stays within bounds; one in 100,000 other hashes then passes.
BITS = 64
# A hash sets the bits named by its remainders after these shifts.
SHIFTS = (0, 12, 24, 36)
# Bits of one row that comes to the driver.
_ROW_BITS = 2**15


def bit_table(hashes: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of the hashes in ``column``."""
    n = hashes.count()
    bits = min(MOST_BITS, max(_ROW_BITS, 1 << (BITS * n).bit_length()))
    places = F.array(*[F.pmod(F.shiftrightunsigned(column, k), F.lit(bits)) + 1 for k in SHIFTS])
    at = hashes.select(F.explode(places).alias("place"))
    parts = at.select(F.bitmap_bucket_number("place").alias("part"), F.bitmap_bit_position("place").alias("bit"))
    table = np.zeros(bits // 8, np.uint8)
    for row in parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        held = np.frombuffer(bytes(row["bits"]), np.uint8)
        table[(row["part"] - 1) * len(held) : row["part"] * len(held)] = held
    return table


def maybe(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places of the hashes that may be in the table; none that is gets lost."""
    places = np.arange(len(hashes))
    for k in SHIFTS:
        at = ((hashes[places] >> np.uint64(k)) % np.uint64(8 * len(table))).astype(np.int64)
        places = places[(table[at >> 3] >> (at & 7) & 1).astype(bool)]
    return places
