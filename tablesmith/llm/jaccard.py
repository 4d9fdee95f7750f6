"""Jaccard join of word n-gram sets by vertical partitioning."""

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tablesmith.llm.arrow import map_texts
from tablesmith.llm.base import components, few, texts
from tablesmith.llm.shingles import mix, sets
from tablesmith.session import materialize

# Documents compared in one task come from two blocks of about so many.
BLOCK = 256
# N-grams of the global order whose partial overlaps are counted at once.
FRAGMENT = 4_096
# Bits of the filter that keeps unshared segments out of the second exchange (16 MB).
FILTER_BITS = 2**27
# Other cuts of the order that are tried for a set with too many empty fragments.
CUTS = 64
# The place of a segment is what its first 44 bits say: 12 name a part of all places, 32 travel as a value.
PLACE_SHIFT, VALUE_BITS = np.uint64(20), np.uint64(32)
# Ranges of the global order, equal in width, in which the n-grams of a set are counted.
RANGES = 256


def _most_apart(n: int, m: int, percent: int) -> int:
    """The greatest symmetric difference of sets of ``n`` and ``m`` that still link."""
    return (100 - percent) * (n + m) // (100 + percent)


def _segments(own: np.ndarray, band: int, apart: int, percent: int) -> list[np.ndarray]:
    """Signatures of the segments of a set, as many as one of them must agree in a linked pair.

    The global order of n-grams is that of their hashes. It is cut into ``count`` fragments of
    equal width, the same for all sets of a band. A linked pair differs in at most ``apart``
    n-grams, each of which spoils one fragment, so of the first ``apart + 1`` segments that
    are not empty one is the same in both sets. A set with too few of them gives all it has,
    and is cut once more in another order.
    """
    high = 2 ** (band + 1) - 1
    count = np.uint64(_most_apart(high, high * 100 // percent, percent) * 11 // 10 + 4)
    out = []
    for cut in range(CUTS):
        hashes = own if cut == 0 else np.sort(mix(own + np.uint64(cut)))
        fragment = ((hashes >> np.uint64(32)) * count) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], fragment[1:] != fragment[:-1]]))
        sums = np.add.reduceat(mix(hashes), starts)
        salt = mix(fragment[starts] + np.uint64(cut * 64 + band << 40))
        out.append(mix(sums + salt)[: apart + 1])
        if len(starts) > apart:
            return out
    return [*out, np.array([band], np.uint64)]


def signatures(own: np.ndarray, percent: int) -> np.ndarray:
    """The signatures of a set in its band of sizes, and in the one below if a partner may lie there."""
    n = len(own)
    band = n.bit_length() - 1
    out = [np.zeros(0, np.uint64)]
    if apart := _most_apart(n, n * 100 // percent, percent):
        out += _segments(own, band, apart, percent)
    below = 2**band - 1
    if 100 * below >= percent * n and (apart := _most_apart(n, below, percent)):
        out += _segments(own, band - 1, apart, percent)
    return np.concatenate(out)


def _places(own: list[np.ndarray]) -> dict:
    """The places of the segments of some sets, by part; one that occurs again stands there twice."""
    places, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]) >> PLACE_SHIFT, return_counts=True)
    places = np.repeat(places, np.minimum(counts, 2))
    parts, starts = np.unique(places >> VALUE_BITS, return_index=True)
    values = np.split(places.astype(np.uint32), starts[1:])[: len(starts)]
    return {"part": parts.astype(np.int32), "places": [v.tobytes() for v in values]}


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places that occur more than once; rows of a part follow each other."""
    for (part,), rows in _groups(batches, ["part"]):
        values, counts = np.unique(np.frombuffer(b"".join(r["places"] for r in rows), np.uint32), return_counts=True)
        places = values[counts > 1].astype(np.int64) + (part << int(VALUE_BITS))
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64())], names=["place"])


def _filter(places: DataFrame) -> np.ndarray:
    """A bit for each place's remainder; its size is fixed, whatever the number of places."""
    place = F.pmod("place", F.lit(FILTER_BITS)) + 1
    parts = places.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("bit"))
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        bits = np.frombuffer(bytes(row["bits"]), np.uint8)
        table[(row["part"] - 1) * len(bits) : row["part"] * len(bits)] = bits
    return table


def _kept(segments: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = ((segments >> PLACE_SHIFT) % np.uint64(FILTER_BITS)).astype(np.int64)
    return segments[(table[at >> 3] >> (at & 7) & 1).astype(bool)]


def profile(own: np.ndarray) -> np.ndarray:
    """How many n-grams of a set lie in each range of the order, counted up to 255."""
    at = (own >> np.uint64(64 - (RANGES - 1).bit_length())).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=RANGES), 255).astype(np.uint8)


def may_link(profiles: np.ndarray, sizes: np.ndarray, sides: np.ndarray | None, percent: int) -> np.ndarray:
    """Whether each set may be similar enough to another one; with ``sides``, to one across.

    Sets whose counts in the ranges differ by ``d`` in all differ in ``d`` n-grams at least, so
    of two that link neither is left out.
    """
    counts = profiles.astype(np.int16)
    out = np.zeros(len(sizes), bool)
    for i in range(len(sizes) - 1):
        apart = np.abs(counts[i + 1 :] - counts[i]).sum(axis=1, dtype=np.int64)
        near = (100 + percent) * apart <= (100 - percent) * (sizes[i + 1 :] + sizes[i])
        if sides is not None:
            near &= sides[i + 1 :] != sides[i]
        out[i] |= near.any()
        out[i + 1 :] |= near
    return out


def overlaps(many: list[np.ndarray]) -> np.ndarray:
    """Shared n-grams of each pair: counted fragment by fragment of the order, summed per pair."""
    tokens = np.concatenate(many)
    docs = np.repeat(np.arange(len(many)), [len(s) for s in many])
    order = np.argsort(tokens, kind="stable")
    tokens, docs = tokens[order], docs[order]
    same = tokens[1:] == tokens[:-1]
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    tokens, docs = tokens[shared], docs[shared]
    codes = np.cumsum(np.concatenate([[False], tokens[1:] != tokens[:-1]])) if len(tokens) else tokens
    total = np.zeros((len(many), len(many)), np.float32)
    for low in range(0, int(codes[-1]) + 1 if len(codes) else 0, FRAGMENT):
        a, b = np.searchsorted(codes, [low, low + FRAGMENT])
        held = np.zeros((len(many), int(codes[b - 1]) - low + 1), np.float32)
        held[docs[a:b], codes[a:b] - low] = 1
        total += held @ held.T
    return total.astype(np.int64)


def _tree(links: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges that connect what a symmetric matrix links."""
    open_ = np.ones(len(links), bool)
    for root in range(len(links)):
        if open_[root]:
            open_[root] = False
            stack = [root]
            while stack:
                a = stack.pop()
                for b in np.flatnonzero(links[a] & open_).tolist():
                    open_[b] = False
                    stack.append(b)
                    yield a, b


def linked(many: list[np.ndarray], sides: np.ndarray | None, percent: int) -> Iterator[tuple[int, int]]:
    """Edges between sets that are similar enough; with ``sides``, only pairs across count."""
    sizes = np.array([len(s) for s in many])
    shared = overlaps(many)
    links = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    if sides is not None:
        links &= sides[:, None] != sides[None, :]
    np.fill_diagonal(links, False)
    return _tree(links)


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows that follow each other with the same key."""
    held, current = [], None
    for batch in batches:
        for row in batch.to_pylist():
            own = tuple(row[k] for k in key)
            if own != current and held:
                yield current, held
                held = []
            current = own
            held.append(row)
    if held:
        yield current, held


def similar_groups(docs: DataFrame, size: int = 5, percent: int = 80, paths: list[str] | None = None) -> DataFrame:
    """``doc_id, n_shingles, copy_of, component_id`` of every row of ``docs (doc_id, text)``.

    A document's set holds the distinct shingles of ``size`` words (runs other than ASCII white
    space, A-Z as a-z), or its whole sequence as one if it has fewer words. Two documents link
    when ``100 * shared >= percent * union``; ``component_id`` is the least ``doc_id`` reachable
    by links, ``copy_of`` the least one with the same set. Null texts and texts without words
    have no shingles and link with nothing. Rows that share a ``doc_id`` are one node; other
    columns are ignored. Shingles are compared by 64-bit hashes.

    Copies are one set. Sets that share a segment of the vertically cut order form star
    groups around their least id; a filter of fixed size keeps most others from being moved
    for that. A group is compared in blocks, each pair of blocks in one
    task: no task holds a whole group and no pair list is written, only edges that connect.
    Blocks are compared by counts of n-grams in ranges first, and only sets that these leave
    with a possible partner are moved as a whole. Tables stored on the way are added to
    ``paths``.
    """

    def digest(batch: pa.RecordBatch) -> dict:
        own = sets(batch["text"].to_pylist(), size)
        raw = [blake2b(s.tobytes(), digest_size=16).digest() for s in own]
        return {"doc_id": batch["doc_id"], "n": [len(s) for s in own], "digest": raw}

    whole = texts(docs)
    each = materialize(map_texts(whole, digest, "doc_id bigint, n bigint, digest binary"), "shingle-sets", paths)
    least = each.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("c"))
    copies = few(materialize(least.where("c > 1").drop("c"), "shingle-copies", paths))
    each = each.join(copies, "digest", "left")
    each = each.select("doc_id", "n", F.when(F.col("n") > 0, F.col("least")).alias("least"))
    each = each.withColumn("copy_of", F.coalesce("least", "doc_id")).drop("least")
    doubles = few(materialize(each.where("doc_id != copy_of").select("doc_id").distinct(), "shingle-doubles", paths))
    single = whole.join(doubles, "doc_id", "left_anti")

    def own_segments(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [signatures(s, percent) if len(s) else s for s in sets(batch["text"].to_pylist(), size)]

    def sign(batch: pa.RecordBatch, table: np.ndarray) -> dict:
        own = [_kept(s, table) for s in own_segments(batch)]
        ids = np.repeat(batch["doc_id"].to_numpy(zero_copy_only=False), [len(s) for s in own])
        flat = np.concatenate([np.zeros(0, np.uint64), *own])
        return {"segment": flat.view(np.int64), "node": ids.astype(np.int64)}

    named = single.where("doc_id is not null")
    # First only places travel, as packed numbers, to find out which of them occur again.
    seen = map_texts(named, lambda batch: _places(own_segments(batch)), "part int, places binary")
    seen = seen.repartition("part").sortWithinPartitions("part").mapInArrow(_repeated, "place bigint")
    table = _filter(materialize(seen, "shingle-places", paths))
    # Once more, but with nodes and only segments that may be shared.
    shared = map_texts(named, lambda batch: sign(batch, table), "segment bigint, node bigint")
    shared = materialize(shared, "shingle-shared", paths)
    stars = shared.groupBy("segment").agg(F.min("node").alias("center"), F.max("node").alias("last"))
    stars = materialize(stars.where("center < last").drop("last"), "shingle-stars", paths)
    members = shared.join(stars, "segment").where("node > center").select("center", "node").distinct()
    members = materialize(members, "shingle-members", paths)
    return _label(each, _components(named, _needed(members, paths), size, percent, paths), paths)


def _needed(members: DataFrame, paths: list[str] | None) -> DataFrame:
    """Without groups that lie in another one as a whole, whose pairs are compared there.

    Copies with few changes share most segments with their least id, but some with the next
    one only; that one's group then has nothing new.
    """
    names = members.select(F.col("node").alias("center"), F.col("center").alias("outer"))
    outer = names.groupBy("center").agg(F.min("outer").alias("outer"))
    inside = members.join(outer, "center").select("center", F.col("outer").alias("o"), "node")
    known = members.select(F.col("center").alias("o"), "node")
    found = inside.join(known, ["o", "node"], "left_semi").groupBy("center").agg(F.count("*").alias("found"))
    sizes = members.groupBy("center").agg(F.count("*").alias("size"))
    kept = materialize(sizes.join(found, "center", "left").where("found is null or found < size").select("center"), "shingle-kept", paths)
    return materialize(members.join(kept, "center", "left_semi"), "shingle-groups", paths)


def _components(single: DataFrame, members: DataFrame, size: int, percent: int, paths: list[str] | None) -> DataFrame:
    """``node, component`` from the star groups ``members (center, node)``."""
    counts = members.groupBy("center").agg(F.ceil((F.count("*") + 1) / BLOCK).cast("int").alias("blocks"))
    counts = materialize(counts, "shingle-counts", paths)
    full = members.union(members.select("center", F.col("center").alias("node")).distinct())
    own = F.pmod(F.xxhash64("node", "center"), F.col("blocks")).cast("int")
    dealt = full.join(counts, "center").withColumn("own", own)
    # Each block meets each block: the smaller number is the low side of the pair.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("center", "node", "own", other)
    low, high = F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    dealt = dealt.select("center", "node", "own", low, high)

    key = ["center", "low", "high"]

    def in_groups(dealt: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
        """The dealt rows with what ``function`` says of each node's text, those of a pair of blocks together."""
        ids = few(materialize(dealt.select(F.col("node").alias("doc_id")).distinct(), "shingle-nodes", paths))
        held = map_texts(single.join(ids, "doc_id", "left_semi"), function, f"node bigint, {schema}")
        return dealt.join(held, "node").repartition(*key).sortWithinPartitions(*key, "node")

    def sides(rows: list[dict], low: int, high: int) -> np.ndarray | None:
        return None if low == high else np.array([r["own"] for r in rows])

    def profiles(batch: pa.RecordBatch) -> dict:
        own = sets(batch["text"].to_pylist(), size)
        return {"node": batch["doc_id"], "n": [len(s) for s in own], "profile": [profile(s).tobytes() for s in own]}

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, low, high), rows in _groups(batches, key):
            counts = np.frombuffer(b"".join(r["profile"] for r in rows), np.uint8).reshape(len(rows), RANGES)
            sizes = np.array([r["n"] for r in rows])
            some = np.flatnonzero(may_link(counts, sizes, sides(rows, low, high), percent)).tolist()
            if some:
                yield pa.RecordBatch.from_pylist([{f.name: rows[i][f.name] for f in fields} for i in some], fields)

    def hashes(batch: pa.RecordBatch) -> dict:
        return {"node": batch["doc_id"], "shingles": [s.tobytes() for s in sets(batch["text"].to_pylist(), size)]}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, low, high), rows in _groups(batches, key):
            many = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
            found = [(rows[a]["node"], rows[b]["node"]) for a, b in linked(many, sides(rows, low, high), percent)]
            columns = [pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    fields = to_arrow_schema(dealt.schema)
    chosen = in_groups(dealt, profiles, "n bigint, profile binary").mapInArrow(choose, dealt.schema)
    chosen = few(materialize(chosen, "shingle-chosen", paths))
    links = in_groups(chosen, hashes, "shingles binary").mapInArrow(compare, "a bigint, b bigint")
    return components(links, "shingle-links", paths)


def _label(each: DataFrame, found: DataFrame, paths: list[str] | None) -> DataFrame:
    found = few(materialize(found.withColumnRenamed("node", "copy_of"), "shingle-components", paths))
    component = F.coalesce("component", "copy_of").alias("component_id")
    out = each.join(found, "copy_of", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "copy_of", component)
