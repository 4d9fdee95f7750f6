"""Best-fit packing of documents into sequences of several permitted lengths."""

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Permitted sequence lengths, ascending, in units of ``length``.
CAPACITIES = (512, 1024, 2048, 4096)
# What a sequence costs beyond its length.
OVERHEAD = 16
# Pieces packed together. Each group leaves a few sequences part filled, so this is not tiny.
GROUP = 8_192

SCHEMA = "doc_id bigint, piece int, start bigint, length int, bin_id bigint, capacity int, offset int"


def words(text: Column) -> Column:
    """A document's length: its words, and one for the end mark."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")) + 1


def fit(lengths: list[int], capacities: tuple[int, ...], overhead: int) -> list[tuple[int, int]]:
    """``bin, offset`` of each length, best fit in the given (descending) order.

    A length goes to the open bin it leaves the least room in. If none has room, the size opens
    that costs least for each unit it can still be filled with.
    """
    free: list[list[int]] = [[] for _ in range(capacities[-1] + 1)]
    open_sizes = 0  # bit n: a bin with n units of room
    left, out, sizes = sum(lengths), [], []
    for n in lengths:
        fitting = open_sizes >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                open_sizes ^= 1 << room
        else:
            b = len(sizes)
            room = min((c for c in capacities if c >= n), key=lambda c: ((c + overhead) / min(c, left), c))
            sizes.append(room)
        out.append((b, sizes[b] - room))
        left -= n
        if room > n:
            free[room - n].append(b)
            open_sizes |= 1 << (room - n)
    return out


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD):
    """``bin, offset, capacity`` of each length: the cheapest of the packings whose largest
    size is each permitted one in turn, every bin cut down to the least size that holds it."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    ordered, best = [lengths[i] for i in order], None
    for k, top in enumerate(capacities, 1):
        if ordered and ordered[0] > top:
            continue
        placed = fit(ordered, capacities[:k], overhead)
        held: dict[int, int] = {}
        for (b, offset), n in zip(placed, ordered):
            held[b] = max(held.get(b, 0), offset + n)
        final = {b: next(c for c in capacities if c >= n) for b, n in held.items()}
        cost = sum(final.values()) + overhead * len(final)
        if best is None or cost < best[0]:
            best = cost, placed, final
    out = [None] * len(lengths)
    if best:
        for i, (b, offset) in zip(order, best[1]):
            out[i] = b, offset, best[2][b]
    return out


def pieces(docs: DataFrame, length: Column, most: int) -> DataFrame:
    """``doc_id, piece, start, length``: documents cut at multiples of the greatest length."""
    sized = docs.select("doc_id", length.cast("bigint").alias("whole")).where("whole > 0")
    last = F.floor((F.col("whole") - 1) / most).cast("int")
    cut = sized.select("doc_id", "whole", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("bigint") * most
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.lit(most), F.col("whole") - start).cast("int").alias("length"))


def best_fit(
    docs: DataFrame, length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES,
    overhead: int = OVERHEAD, group: int = GROUP,
) -> DataFrame:
    """``doc_id, piece, start, length, bin_id, capacity, offset`` of all of every document.

    ``length`` (default: words and an end mark, so also null and empty texts have 1) says how
    many units a row has; rows with less than one are left out. Longer documents than the
    greatest capacity become pieces; no unit is lost. Pieces are dealt by hash into groups of
    about ``group`` that are packed on their own, so neither a task nor a bin depends on the
    size of the table. Rows that repeat a ``doc_id`` are packed one by one; other columns are
    ignored; an empty table gives an empty result.
    """
    capacities = tuple(sorted(capacities))
    cut = pieces(docs, words(F.col("text")) if length is None else length, capacities[-1])
    # The number of groups needs a count of the pieces; each is also hashed by its length, so
    # that rows with one repeated id do not meet in one group.
    groups = max(1, -(-cut.count() // group))
    shard = F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(groups)).alias("shard")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        found = pack(rows["length"].tolist(), capacities, overhead)
        base = int(rows["shard"].iloc[0]) << 32
        rows["bin_id"] = [base + b for b, _, _ in found]
        rows["offset"] = [o for _, o, _ in found]
        rows["capacity"] = [c for _, _, c in found]
        return rows[["doc_id", "piece", "start", "length", "bin_id", "capacity", "offset"]]

    return cut.withColumn("shard", shard).groupBy("shard").applyInPandas(run, SCHEMA)
