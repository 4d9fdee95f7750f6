"""Benchmark items inside documents: size-partitioned MinHash containment search."""

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablesmith.llm.arrow import map_texts
from tablesmith.llm.base import few, texts
from tablesmith.llm.presence import bit_table, maybe
from tablesmith.llm.shingles import mix, sets, shingles
from tablesmith.session import materialize

SHINGLE, THRESHOLD = 5, 0.8
# Hash functions of a signature. A contained item of n shingles shares 0.8 n of them with the
# document, and windows of its class have less than 3 n. A shared shingle that is the least one
# of the item and of its own window gives a match, which for each of them has a chance of more
# than 1 / (4 n): together 0.2, wherever they lie. All functions miss below 0.8 ** HASHES = 0.00001.
HASHES = 52
# Items of at most TINY shingles are looked up shingle by shingle: windows of one, no sketch.
TINY = 8

_RANDOM = np.random.default_rng(20_240_501)
_MASKS = _RANDOM.integers(0, 2**63, HASHES, np.uint64)
_FACTORS = _RANDOM.integers(0, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)


def _permuted(hashes: np.ndarray, j: int) -> np.ndarray:
    h = (hashes ^ _MASKS[j]) * _FACTORS[j]
    return h ^ (h >> np.uint64(32))


def _class(n: int) -> int:
    """The size class of a set: ``u`` for ``u / 2 < n <= u``, 0 for tiny and empty ones."""
    return 1 << (n - 1).bit_length() if n > TINY else 0


def _key(least: np.ndarray, u: int, j: int) -> np.ndarray:
    """Least values of function ``j`` in class ``u`` as numbers that differ from those of all others."""
    return mix(least + np.uint64(u.bit_length() * HASHES + j))


def item_keys(own: np.ndarray) -> np.ndarray:
    """The numbers under which an item is found: its signature, or its shingles if they are few."""
    u = _class(len(own))
    if not u:
        return own
    return np.concatenate([_key(_permuted(own, j).min(keepdims=True), u, j) for j in range(HASHES)])


def _windows(hashes: np.ndarray, offsets: np.ndarray, classes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Class, documents and keys of all windows, for each hash function and class.

    Windows of class ``u`` take 1.5 ``u`` shingle positions and start every ``u / 2``, so each
    run of ``u`` positions lies in one of them.
    """
    base = min(classes) // 2
    counts = -(-np.diff(offsets) // base)
    first = np.concatenate([[0], np.cumsum(counts)])
    doc_of_cell = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(first[-1]) - first[doc_of_cell]
    starts = offsets[:-1][doc_of_cell] + within * base
    edges = {u: np.flatnonzero(within % (u // 2 // base) == 0) for u in classes}
    for j in range(HASHES):
        cells = np.minimum.reduceat(_permuted(hashes, j), starts)
        for u, edge in edges.items():
            least, docs = np.minimum.reduceat(cells, edge), doc_of_cell[edge]
            for _ in range(2):  # the next cell of the document, and the one after it
                same = docs[1:] == docs[:-1]
                least[:-1] = np.where(same, np.minimum(least[:-1], least[1:]), least[:-1])
            yield u, docs, _key(least, u, j)


def document_keys(many: list[str], classes: list[int], threshold: float, key_bits: np.ndarray, shingle_bits: np.ndarray):
    """``document, keys, shingles`` of the documents with a key that items may have.

    ``shingles`` are its distinct shingles that items may have. A document with too few of them
    for any item of a class holds none, so it gets no signature there.
    """
    hashes, offsets = shingles(many, SHINGLE)
    doc_of = np.repeat(np.arange(len(many)), np.diff(offsets))
    passed = maybe(hashes, shingle_bits)
    held = np.bincount(doc_of[passed], minlength=len(many))
    docs, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    if 0 in classes:
        docs.append(doc_of[passed])
        keys.append(hashes[passed])
    sketched = [u for u in classes if u]
    least = {u: threshold * (u // 2 + 1) - 1e-9 for u in sketched}
    some = np.flatnonzero(held >= min(least.values(), default=np.inf))
    if len(some):
        own = np.concatenate([hashes[offsets[d] : offsets[d + 1]] for d in some])
        edges = np.concatenate([[0], np.cumsum(np.diff(offsets)[some])])
        for u, at, found in _windows(own, edges, sketched):
            at = some[at]
            enough = np.flatnonzero(held[at] >= least[u])
            enough = enough[maybe(found[enough], key_bits)]
            docs.append(at[enough])
            keys.append(found[enough])
    docs, keys = np.concatenate(docs), np.concatenate(keys)
    at = maybe(keys, key_bits)
    at = at[np.argsort(docs[at], kind="stable")]
    docs, keys = docs[at], keys[at]
    for doc in np.unique(docs).tolist():
        a, b = np.searchsorted(docs, [doc, doc + 1])
        low, high = np.searchsorted(passed, [offsets[doc], offsets[doc + 1]])
        yield doc, np.unique(keys[a:b]), np.unique(hashes[passed[low:high]])


def contained_items(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, paths: list[str] | None = None
) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item, containment`` of every item held by a document.

    Words are runs other than ASCII white space, A-Z as a-z; a set is the distinct shingles of
    five words, or the whole sequence of a shorter text. ``containment`` is the share of the
    item's set in the document's. Candidates come from signatures; each is verified over the
    whole document, by 64-bit hashes. What is found is exact; a contained item is missed with a
    chance below 0.00001, whether it lies in one passage or in parts. Null texts and texts
    without words hold nothing and are held by nothing; rows that repeat an id are compared one
    by one, null ids are returned as such; other columns are ignored.

    Items of equal sets are one. The documents are read once, however many items there are:
    filters of bounded size leave only keys and shingles that items may have, and these meet
    the items in joins by key and by shingle. Tables stored on the way are added
    to ``paths``.
    """

    def sketch(batch: pa.RecordBatch) -> dict:
        own = sets(batch["text"].to_pylist(), SHINGLE)
        return {
            "item_id": batch["item_id"], "digest": [blake2b(s.tobytes(), digest_size=16).digest() for s in own],
            "shingles": [s.view(np.int64) for s in own], "keys": [item_keys(s).view(np.int64) for s in own],
        }

    known = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = "item_id bigint, digest binary, shingles array<bigint>, keys array<bigint>"
    given = materialize(map_texts(known, sketch, schema).where(F.size("shingles") > 0), "benchmark-items", paths)
    each = given.groupBy("digest").agg(F.first("shingles").alias("shingles"), F.first("keys").alias("keys"))
    each = materialize(each.withColumn("item", F.monotonically_increasing_id()), "benchmark-sets", paths)
    item_key = each.select("item", F.explode("keys").alias("key"))
    item_shingle = each.select("item", F.explode("shingles").alias("shingle"))
    # At most a number per power of two, and one for tiny items.
    n = F.size("shingles")
    kind = F.when(n > TINY, F.ceil(F.log2(n.cast("double")))).otherwise(0)
    classes = sorted({_class(r["n"]) for r in each.groupBy(kind).agg(F.max(n).alias("n")).collect()})

    context = docs.sparkSession.sparkContext
    key_bits = context.broadcast(bit_table(item_key, "key"))
    shingle_bits = context.broadcast(bit_table(item_shingle, "shingle"))

    def search(batch: pa.RecordBatch) -> dict:
        out = {"doc_id": [], "keys": [], "shingles": []}
        ids = batch["doc_id"].to_pylist()
        many = batch["text"].to_pylist()
        for doc, keys, own in document_keys(many, classes, threshold, key_bits.value, shingle_bits.value):
            for name, value in zip(out, (ids[doc], keys.view(np.int64), own.view(np.int64))):
                out[name].append(value)
        return out

    hits = map_texts(texts(docs), search, "doc_id bigint, keys array<bigint>, shingles array<bigint>")
    hits = materialize(hits.withColumn("hit", F.monotonically_increasing_id()), "benchmark-hits", paths)
    pairs = hits.select("hit", F.explode("keys").alias("key")).join(few(item_key), "key").select("hit", "item").distinct()
    pairs = materialize(pairs, "benchmark-pairs", paths)
    # Containment shingle by shingle: each is a row of its own, so no key gathers a document.
    wanted = pairs.join(few(item_shingle), "item")
    held = hits.select("hit", F.explode("shingles").alias("shingle"))
    shared = wanted.join(held, ["hit", "shingle"]).groupBy("hit", "item").agg(F.count("*").alias("n_shared"))
    size = each.select("item", "digest", F.size("shingles").cast("bigint").alias("n_item"))
    found = shared.join(few(size), "item").where(F.col("n_shared") >= threshold * F.col("n_item") - 1e-9)
    found = found.join(given.select("item_id", "digest"), "digest").join(hits.select("hit", "doc_id"), "hit")
    return found.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))
