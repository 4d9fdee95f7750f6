"""Long repeated substrings: anchored contexts, and a run-length index of those that differ."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablesmith.llm.arrow import map_texts
from tablesmith.llm.base import few, texts, with_rows
from tablesmith.llm.shingles import powers, mix
from tablesmith.session import materialize

LENGTH = 400
# Bytes of an anchor. Strings that share less are told apart without being moved.
ANCHOR = 64
# Window starts handled at once; a longer text is cut into overlapping pieces.
PIECE = 1_000_000
# An index is built over contexts of about so many bytes, of whole groups of one anchor.
INDEX_BYTES = 500_000
# A group of more different contexts than this is compared by the hashes of its windows.
GROUP = 2_048
SPAN = "struct<start: bigint, end: bigint>"


def _sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial in 64 bits; see ``_hash``."""
    up, _ = powers(max(20, int(len(values)).bit_length()))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])])


def _hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of slices, by where they start and end."""
    _, down = powers(max(20, (len(sums) - 1).bit_length()))
    return mix((sums[ends] - sums[starts]) * down[starts])


def _least_place(keys: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each ``width`` consecutive keys; equal keys: the first."""
    bits = np.uint64(max(1, int(len(keys)).bit_length()))
    marked = (keys >> bits << bits) | np.arange(len(keys), dtype=np.uint64)
    padded = np.full(-(-len(keys) // width) * width, np.uint64(2**64 - 1))
    padded[: len(keys)] = marked
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[: len(keys) - width + 1], before[width - 1 : len(keys)])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _grams(data: np.ndarray, length: int = ANCHOR) -> np.ndarray:
    sums = _sums(data.astype(np.uint64) + np.uint64(1))
    starts = np.arange(max(0, len(data) - length + 1))
    return _hash(sums, starts, starts + length)


def contexts(data: np.ndarray, firsts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``anchor, digest, digest, start, end`` of the contexts of texts laid end to end.

    Each window of ``length`` bytes belongs to the least-hashed of its ANCHOR-byte strings;
    consecutive windows with one anchor are a context. Equal windows thus have equal anchors
    at equal distances, wherever they are.
    """
    starts = np.zeros(0, np.int64)
    if len(data) >= length:
        grams = _grams(data)
        place = _least_place(grams, length - ANCHOR + 1)
        # A window must not leave its text.
        text = np.searchsorted(firsts, np.arange(len(place)), "right") - 1
        inside = np.arange(len(place)) + length <= firsts[text + 1]
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
        starts = np.flatnonzero(inside & (new | ~np.concatenate([[False], inside[:-1]])))
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty
    last = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]]))
    ends = last + length
    digests = [
        _hash(_sums(v), starts, ends - ANCHOR + 1).view(np.int64) for v in (grams, mix(grams + np.uint64(0x5851F42D4C957F2D)))
    ]
    return grams[place[starts]].view(np.int64), *digests, starts, ends


def _pieces(raw: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    for at in range(0, max(1, len(raw) - length + 1), PIECE):
        yield at, raw[at : at + PIECE + length - 1]


def _scan(batch: pa.RecordBatch, length: int) -> dict:
    """All contexts of a slice of documents."""
    names = ("anchor", "d1", "d2", "start", "end")
    out = {n: [] for n in ("row", *names)}
    pieces = [
        (d, at, p)
        for d, t in zip(batch["row"].to_pylist(), batch["text"].to_pylist())
        for at, p in _pieces(t.encode("utf-8", "surrogatepass"), length)
    ]
    while pieces:
        held = size = 0
        while held < len(pieces) and (not held or size + len(pieces[held][2]) <= PIECE):
            size += len(pieces[held][2])
            held += 1
        some, pieces = pieces[:held], pieces[held:]
        firsts = np.cumsum([0, *(len(p) for _, _, p in some)])
        data = np.frombuffer(b"".join(p for _, _, p in some), np.uint8)
        found = contexts(data, firsts, length)
        text = np.searchsorted(firsts, found[3], "right") - 1
        shift = np.array([at for _, at, _ in some], np.int64)[text] - firsts[text]
        for name, values in zip(names, (*found[:3], found[3] + shift, found[4] + shift)):
            out[name].append(values)
        out["row"] += [some[i][0] for i in text.tolist()]
    joined = {n: np.concatenate(out[n]) if out[n] else np.zeros(0, np.int64) for n in names}
    return {"row": out["row"], **joined}


def long_matches(many: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Spans of each text covered by strings of ``length`` bytes that also start elsewhere.

    A suffix array over all texts, each ended by a sign of its own, gives the Burrows-Wheeler
    transform. Only the ends of its runs are kept: two neighbouring suffixes inside a run are
    preceded by the same byte, so their match is the tail of a longer one, which some run end
    has. The match lengths at run ends therefore cover every repeated string.
    """
    if not many:
        return []
    data = np.frombuffer(b"".join(many), np.uint8)
    sizes = np.array([len(m) for m in many])
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    n = len(data)
    text = np.repeat(np.arange(len(many)), sizes)
    left = firsts[1:][text] - np.arange(n)  # bytes up to the end of the text
    # Ranks of prefixes of 7, 14, 28 ... signs; past the end of a text all signs are 0.
    step, key = 7, np.zeros(n, np.int64)
    for i in range(step):
        sign = np.zeros(n, np.int64)
        if i < n:
            sign[: n - i] = data[i:].astype(np.int64) + 1
        key = (key << 9) | np.where(left > i, sign, 0)
    levels, longest = [], int(sizes.max())
    while True:
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        levels.append((step, rank))
        if step >= longest:
            break
        after = np.zeros(n, np.int64)
        if step < n:
            after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + np.where(left > step, after, 0)
        step *= 2
    order = np.argsort(levels[-1][1], kind="stable")
    # The byte before each suffix; the start of a text has a sign of its own.
    before = np.where(order > 0, data[order - 1].astype(np.int64), 0)
    first = left[order] == sizes[text[order]]
    before[first] = 256 + text[order][first]
    ends = np.flatnonzero(before[1:] != before[:-1])
    a, b = order[ends], order[ends + 1]
    room, shared = np.minimum(left[a], left[b]), np.zeros(len(a), np.int64)
    near = room >= length
    a, b, room, shared = a[near], b[near], room[near], shared[near]
    for step, rank in reversed(levels):
        open_ = shared < room
        same = np.zeros(len(a), bool)
        same[open_] = rank[a[open_] + shared[open_]] == rank[b[open_] + shared[open_]]
        shared = np.minimum(shared + step * same, room)
    for _ in range(6):
        open_ = np.flatnonzero(shared < room)
        same = data[a[open_] + shared[open_]] == data[b[open_] + shared[open_]]
        room[open_[~same]] = shared[open_[~same]]
        shared[open_[same]] += 1
    hit = shared >= length
    starts, sizes_ = np.concatenate([a[hit], b[hit]]), np.concatenate([shared[hit]] * 2)
    out: list[list[tuple[int, int]]] = [[] for _ in many]
    for i, s, e in zip(text[starts].tolist(), (starts - firsts[text[starts]]).tolist(), (starts - firsts[text[starts]] + sizes_).tolist()):
        out[i].append((s, e))
    return [merged(spans) for spans in out]


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def _index_groups(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of contexts, from one index over the whole groups that follow each other."""

    def index(rows: list[dict]) -> pa.RecordBatch:
        found = long_matches([r["data"] for r in rows], length)
        spans = [(r["row"], r["start"] + s, r["start"] + e) for r, own in zip(rows, found) if r["c"] == 1 for s, e in own]
        columns = [pa.array([x[i] for x in spans], pa.int64()) for i in range(3)]
        return pa.RecordBatch.from_arrays(columns, names=["row", "start", "end"])

    held, size = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            if size >= INDEX_BYTES and row["anchor"] != held[-1]["anchor"]:
                yield index(held)
                held, size = [], 0
            held.append(row)
            size += len(row["data"])
    if held:
        yield index(held)


def repeated_spans(whole: DataFrame, length: int = LENGTH) -> DataFrame:
    """``row, start, end``: spans of bytes covered by strings that also start elsewhere; they may overlap.

    ``whole`` has ``row``, which names a row, and ``text``.
    """
    schema = "row bigint, anchor bigint, d1 bigint, d2 bigint, start bigint, end bigint"
    each = materialize(map_texts(whole, lambda b: _scan(b, length), schema), "repeat-contexts")
    context = ["anchor", "d1", "d2"]
    place = F.min(F.struct("row", "start", "end")).alias("p")
    kinds = each.groupBy(*context).agg(F.count("*").alias("c"), place)
    kinds = materialize(kinds.select(*context, "c", "p.*"), "repeat-kinds")
    # A context that occurs twice is repeated as a whole.
    twice = kinds.where("c > 1").select(*context)
    copies = each.join(twice, context, "left_semi").select("row", "start", "end")
    # Contexts that differ around one anchor are compared byte by byte.
    many = kinds.groupBy("anchor").agg(F.count("*").alias("m"), F.min("c").alias("rare")).where("m > 1 and rare = 1")
    many = materialize(many.drop("rare"), "repeat-anchors")
    wanted = kinds.join(many, "anchor").groupBy("row").agg(F.collect_list(F.struct("anchor", "c", "m", "start", "end")).alias("wanted"))
    wanted = few(materialize(wanted, "repeat-wanted"), "wanted")

    def cut(batch: pa.RecordBatch) -> dict:
        out = {n: [] for n in ("anchor", "c", "m", "row", "start", "data")}
        for row, text, own in zip(batch["row"].to_pylist(), batch["text"].to_pylist(), batch["wanted"].to_pylist()):
            raw = text.encode("utf-8", "surrogatepass")
            for w in own:
                for name in ("anchor", "c", "m", "start"):
                    out[name].append(w[name])
                out["row"].append(row)
                out["data"].append(raw[w["start"] : w["end"]])
        return out

    cuts = map_texts(whole.join(wanted, "row"), cut, "anchor bigint, c bigint, m bigint, row bigint, start bigint, data binary")
    cuts = materialize(cuts, "repeat-cuts")
    small = cuts.where(F.col("m") <= GROUP).select("anchor", "c", "row", "start", "data").distinct()
    small = small.repartition("anchor").sortWithinPartitions("anchor")
    indexed = small.mapInArrow(lambda b: _index_groups(b, length), "row bigint, start bigint, end bigint")

    def windows(batch: pa.RecordBatch) -> dict:
        out = {n: [] for n in ("row", "start", "h1", "h2", "rare")}
        for r in batch.to_pylist():
            grams = _grams(np.frombuffer(r["data"], np.uint8))
            starts = np.arange(len(r["data"]) - length + 1)
            out["row"] += [r["row"]] * len(starts)
            out["rare"] += [r["c"] == 1] * len(starts)
            out["start"].append(starts + r["start"])
            for name, v in (("h1", grams), ("h2", mix(grams + np.uint64(0x5851F42D4C957F2D)))):
                out[name].append(_hash(_sums(v), starts, starts + length - ANCHOR + 1).view(np.int64))
        arrays = {n: np.concatenate(out[n]) if out[n] else np.zeros(0, np.int64) for n in ("start", "h1", "h2")}
        return {**out, **arrays}

    wide = cuts.where(F.col("m") > GROUP).select("c", "row", "start", "data").distinct()
    large = map_texts(wide, windows, "row bigint, start bigint, h1 bigint, h2 bigint, rare boolean", "data")
    again = large.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    again = materialize(again, "repeat-windows")
    hashed = large.where("rare").join(again, ["h1", "h2"], "left_semi").select("row", "start", (F.col("start") + length).alias("end"))
    return copies.union(indexed).union(hashed)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, removed, kept``: the spans removed from each text, and the bytes left.

    Texts are UTF-8 bytes, null counts as empty. Every byte goes that a string of ``length``
    bytes covers which also starts anywhere else, in another document or the same one, also
    overlapping; what is left may thus end inside a character. Strings are judged on the input
    and never cross documents. ``removed`` has the maximal spans in bytes, ascending, end
    exclusive. Each row is a document of its own, also without a ``doc_id`` or with one that
    other rows have, too; so a repeated row loses all that is long enough, in each copy. Other
    columns are ignored.
    """
    span, whole = F.struct("start", "end"), with_rows(texts(docs))
    spans = repeated_spans(whole, length).groupBy("row").agg(F.collect_list(span).alias("spans"))

    def cut(batch: pa.RecordBatch) -> dict:
        out = {n: [] for n in ("n_bytes", "removed", "kept")}
        for text, own in zip(batch["text"].to_pylist(), batch["spans"].to_pylist()):
            raw, at, parts = text.encode("utf-8", "surrogatepass"), 0, []
            found = merged((s["start"], s["end"]) for s in own or [])
            for start, end in found:
                parts.append(raw[at:start])
                at = end
            out["n_bytes"].append(len(raw))
            out["removed"].append([{"start": s, "end": e} for s, e in found])
            out["kept"].append(b"".join([*parts, raw[at:]]))
        return {"doc_id": batch["doc_id"], **out}

    joined = whole.join(spans, "row", "left")
    return map_texts(joined, cut, f"doc_id bigint, n_bytes bigint, removed array<{SPAN}>, kept binary")
