"""Substring de-duplication by hashed lines and sentences."""

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh32_intdigest

from tablesmith.llm.arrow import map_texts
from tablesmith.llm.base import texts, with_rows
from tablesmith.llm.shingles import mix, powers
from tablesmith.session import materialize

# Units of fewer words are common phrases, list marks or brackets; they stay.
MIN_WORDS = 5
# In scripts without spaces each character is read as a word and counts as half a one.
UNSPACED = (
    "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff"
    "\uf900-\ufaff\uff66-\uff9d\U00020000-\U000323af"
)
# A phrase that finds no end in its own words is cut after so many.
LONG_WORDS = 40
# A worker keeps the hashes of about so many words, some 200 bytes each, from batch to batch.
KNOWN_WORDS = 300_000
UNSPACED_SIGN = re.compile(f"[{UNSPACED}]")
MIXED = re.compile(rf"[{UNSPACED}]|[^\s{UNSPACED}]+")
# Whether a character is white space; there is none beyond the last place.
BLANK = np.array([chr(c).isspace() for c in range(0x3001)] + [False])
SPANS = "array<struct<start: int, end: int>>"


class Checksums(dict):
    """64-bit hashes of words, the low half a checksum; each computed once."""

    @classmethod
    def known(cls) -> "Checksums":
        """Those of the words that this worker has met lately, for one more batch."""
        if len(_KNOWN) > KNOWN_WORDS:
            _KNOWN.clear()
        return _KNOWN

    def __missing__(self, word: str) -> int:
        raw = word.encode("utf-8", "surrogatepass")
        self[word] = crc32(raw) | xxh32_intdigest(raw) << 32
        return self[word]


_KNOWN = Checksums()


def _digests(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each range of words, from two sums over all of them."""
    up, down = powers(max(12, int(len(hashes)).bit_length()))
    out = []
    for shift in (np.uint64(0), np.uint64(0x5851F42D4C957F2D)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + shift) * up[: len(hashes)])])
        out.append(mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _ends(keys: np.ndarray, unspaced: np.ndarray | None, least: int) -> list[int]:
    """Where phrases end: after words whose key is the least among ``least - 1`` words on both sides.

    So an end depends on the words around it alone, wherever they stand, and a phrase has
    ``least`` words or more; characters of scripts without spaces count half.
    """
    near = max(least - 1, 1)
    far = near if unspaced is None else 2 * least - 1
    ends = np.ones(len(keys), bool)
    for d in range(1, min(far, len(keys) - 1) + 1):
        after, before = keys[d:] < keys[:-d], keys[:-d] <= keys[d:]
        if d > near:
            after, before = after | ~unspaced[d:], before | ~unspaced[:-d]
        ends[d:] &= after
        ends[:-d] &= before
    ends[:near] = ends[max(len(keys) - near - 1, 0) :] = False
    return (np.flatnonzero(ends) + 1).tolist()


def _phrases(keys: np.ndarray, unspaced: np.ndarray | None, size, min_words: int) -> list[tuple[int, int]]:
    """The text as word ranges of ``min_words`` or more; a rest that is shorter goes to a neighbour."""
    bounds = [0]
    for end in [*_ends(keys, unspaced, min_words), len(keys)]:
        while end - bounds[-1] > LONG_WORDS + min_words:
            bounds.append(bounds[-1] + LONG_WORDS)
        bounds.append(end)
    if unspaced is None and min_words <= LONG_WORDS:
        # Ends keep that distance from one another and from both sides of the text.
        return list(zip(bounds, bounds[1:]))
    first, found = 0, []
    for end in bounds[1:]:
        if size(first, end) >= min_words:
            found.append((first, end))
            first = end
    return [*found[:-1], (found[-1][0], len(keys))] if found else []


def _edges(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of characters that are ``inside`` start and end."""
    out = np.concatenate([[True], ~inside, [True]])
    edges = np.flatnonzero(out[1:] != out[:-1])
    return edges[::2], edges[1::2]


def _lines_and_sentences(codes: np.ndarray) -> np.ndarray:
    """``start, end`` of the lines, then of the sentences of lines that have a stop before a space."""
    first, last = _edges(codes != 10)
    spaces = np.flatnonzero(codes[1:] == 32) + 1
    before = codes[spaces - 1]
    stops = spaces[(before == 46) | (before == 33) | (before == 63)]  # . ! ?
    several = np.searchsorted(stops, first) < np.searchsorted(stops, last)
    # The sentences' starts and ends alternate, so those of all lines can be put in order as a whole.
    starts = np.sort(np.concatenate([first[several], stops + 1]))
    ends = np.sort(np.concatenate([stops, last[several]]))
    return np.stack([np.concatenate([first, starts]), np.concatenate([last, ends])], 1)


def _pieces(text: str, min_words: int, checksums: Checksums):
    """The hashes of a text's words, and the ranges of words and the places of its lines, sentences and phrases; none if it is too short."""
    low = text.lower()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if UNSPACED_SIGN.search(text):
        words = MIXED.findall(low)
        starts, ends = (np.array([at(m) for m in MIXED.finditer(text)], np.int64) for at in (re.Match.start, re.Match.end))
        unspaced = np.fromiter((UNSPACED_SIGN.match(w) is not None for w in words), bool, len(words))
        sums = np.concatenate([[0], np.cumsum(np.where(unspaced, 1, 2))])
        size = lambda i, j: (sums[j] - sums[i]) / 2
    else:
        # Words as ``str.split`` sees them.
        (starts, ends), words, unspaced = _edges(~BLANK[np.minimum(codes, len(BLANK) - 1)]), low.split(), None
        size = lambda i, j: j - i
    if not size(0, len(words)) >= min_words:
        return None
    places = _lines_and_sentences(codes)
    ranges = np.searchsorted(starts, places)
    long = size(*ranges.T) >= min_words
    hashes = np.fromiter(map(checksums.__getitem__, words), np.uint64, len(words))
    keys = hashes & np.uint64(0xFFFFFFFF)
    # Of a word and the next one, so that one common word alone does not decide.
    keys = keys * np.uint64(0x9E3779B97F4A7C15) + np.append(keys[1:], np.uint64(0)) * np.uint64(0xC2B2AE3D27D4EB4F)
    phrases = np.array(_phrases(keys ^ (keys >> np.uint64(29)), unspaced, size, min_words), np.int64).reshape(-1, 2)
    places = np.concatenate([places[long], np.stack([starts[phrases[:, 0]], ends[phrases[:, 1] - 1]], 1)])
    return hashes, np.concatenate([ranges[long], phrases]), places


def _all_units(texts: list[str], min_words: int, checksums: Checksums) -> list[np.ndarray]:
    """``text, start, end, d1, d2`` of the lines, of the sentences of longer lines, of the phrases of whole texts; ``text`` is a place in the list.

    What is the same for all texts is done for all together, since most texts are short.
    """
    found = [(i, *own) for i, text in enumerate(texts) if (own := _pieces(text, min_words, checksums)) is not None]
    if not found:
        return [np.zeros(0, np.int64)] * 5
    numbers, hashes, ranges, places = zip(*found)
    # One place more for each text, so that no range of one text is a range of the next.
    lengths = np.array([len(h) + 1 for h in hashes], np.int64)
    counts = [len(r) for r in ranges]
    ranges = np.concatenate(ranges) + np.repeat(np.cumsum(lengths) - lengths, counts)[:, None]
    hashes = np.concatenate([part for h in hashes for part in (h, np.zeros(1, np.uint64))])
    # Of equal ranges the first counts: a line, then a sentence, then a phrase.
    _, once = np.unique(ranges[:, 0] * (len(hashes) + 1) + ranges[:, 1], return_index=True)
    return [np.repeat(numbers, counts)[once], *np.concatenate(places)[once].T, *_digests(hashes, *ranges[once].T)]


def _units(text: str, min_words: int, checksums: Checksums):
    """The units of one text without its number; none if it is too short."""
    found = _all_units([text], min_words, checksums)
    return tuple(found[1:]) if len(found[0]) else None


def units(whole: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``row, start, end, d1, d2`` of all units of ``whole (row, text)``; offsets in code points, end exclusive.

    A unit is a line, and in a line of several sentences also each sentence (up to a full
    stop, question or exclamation mark before a space, without that space), if it has
    ``min_words``. The whole text is also cut into phrases of ``min_words`` or more at places
    that the words around them decide; they may run over the ends of sentences and short
    lines, so that a passage is found wherever it starts, but for a few words at its edges.
    The digest, 128 bits, is taken from the sequence of lower-case words; in scripts without
    spaces a character is a word, and two of them count as one.
    """

    def cut(batch: pa.RecordBatch) -> dict:
        which, *columns = _all_units(batch["text"].to_pylist(), min_words, Checksums.known())
        return dict(zip(("row", "start", "end", "d1", "d2"), (batch["row"].to_numpy()[which], *columns)))

    return map_texts(whole, cut, "row bigint, start bigint, end bigint, d1 bigint, d2 bigint")


def repeated_units(whole: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``row, start, end`` of every unit whose digest occurs earlier; least (row, start) first.

    What overlaps the first occurrence is the same text, not a repeat: a line and its only
    sentence have the same words.
    """
    found = units(whole, min_words)
    first = F.min(F.struct("row", "start", "end")).alias("first")
    known = found.groupBy("d1", "d2").agg(first, F.count("*").alias("n")).where("n > 1").drop("n")
    # Stored, so that the rows of one very common line are split over several tasks.
    known = materialize(known, "unit-digests")
    at = F.struct("row", "start", "end")
    apart = ~F.col("row").eqNullSafe(F.col("first.row")) | (F.col("start") >= F.col("first.end"))
    return found.join(known, ["d1", "d2"]).where((at > F.col("first")) & apart).select("row", "start", "end")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, text, removed``: what stays of each text, and the removed spans of the original.

    Of equal units of ``docs (doc_id, text)`` the one with the least ``(doc_id, start)`` stays,
    also within one document. The white space between units stays, but not inside a phrase. ``removed`` has merged,
    ascending spans in code points, end exclusive, and is empty where nothing went. Null
    texts count as empty; rows without units come back as they are; other columns are ignored.
    Each row is a document of its own; those without a ``doc_id``, or with one that other rows
    have, too, come after all others, in any order. So of repeated rows one keeps its text.
    """
    whole = with_rows(texts(docs))
    spans = repeated_units(whole, min_words).groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def cut(batch: pa.RecordBatch) -> dict:
        kept, removed = [], []
        for text, found in zip(batch["text"].to_pylist(), batch["spans"].to_pylist()):
            merged = []
            for start, end in sorted((s["start"], s["end"]) for s in found or []):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(end, merged[-1][1])
                else:
                    merged.append([start, end])
            at, parts = 0, []
            for start, end in merged:
                parts.append(text[at:start])
                at = end
            kept.append("".join([*parts, text[at:]]))
            removed.append([{"start": s, "end": e} for s, e in merged])
        return {"doc_id": batch["doc_id"], "text": kept, "removed": removed}

    joined = whole.join(spans, "row", "left")
    return map_texts(joined, cut, f"doc_id bigint, text string, removed {SPANS}")
