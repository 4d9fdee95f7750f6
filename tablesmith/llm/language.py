"""Language identification by rank-order profiles of character n-grams."""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tablesmith.llm.arrow import field, map_texts
from tablesmith.llm.base import few
from tablesmith.session import materialize

# N-grams of one to ORDER characters; the PLACES most frequent ones make a profile.
ORDER, PLACES = 3, 400
# So many characters are counted at once, which bounds memory for very long texts.
PIECE = 131_072
# Learned from at most so many labelled documents per language, taken by the hash of their id.
SAMPLE_ROWS = 5_000
# Of each language first so many shares are ranked on their own, so no task sorts all its ids.
SAMPLE_SHARES = 256
# A profile table of more languages is refused, so what is sent to the tasks stays bounded.
MAX_LANGUAGES = 2_000
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For each character of the basic plane: itself if it is a letter, else a space."""
    table = np.full(65_536, 32, np.uint16)
    for code in range(65_536):
        if not 0xD800 <= code < 0xE000 and chr(code).isalpha():
            table[code] = code
    return table


def _lines(text: str) -> Iterator[np.ndarray]:
    """The folded characters of a text, in pieces: letters in lower case, all else one space.

    A piece begins with the last ``ORDER - 1`` characters of the one before. Letters beyond the
    basic plane are folded into its private area.
    """
    lower, before, gap = text.lower(), np.full(1, 32, np.uint16), True
    for start in range(0, len(lower), PIECE):
        codes = np.frombuffer(lower[start : start + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        plain = _letters()[np.minimum(codes, 0xFFFF)]
        for code in np.unique(codes[codes > 0xFFFF]):
            if chr(code).isalpha():
                plain[codes == code] = 0xE000 + code % 6_400
        space = plain == 32
        keep = ~space
        keep[1:] |= ~space[:-1]
        keep[0] |= not gap
        end = np.full(int(start + PIECE >= len(lower)), 32, np.uint16)
        line = np.concatenate([before, plain[keep], end])
        yield line
        before, gap = line[1 - ORDER :], bool(space[-1])


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text with their counts, ascending; an n-gram packs its characters into 16 bits each."""
    found, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    known = 0
    for piece in _lines(text):
        piece = piece.astype(np.uint64)
        fresh = piece[known:]
        packed, grams = piece, [fresh[fresh != 32]]
        for n in range(2, ORDER + 1):
            packed = (packed[:-1] << np.uint64(16)) | piece[n - 1 :]
            # Those that end within the characters carried over have been counted.
            grams.append(packed[max(known - n + 1, 0) :])
        known = min(ORDER - 1, len(piece))
        own, n = np.unique(np.concatenate(grams), return_counts=True)
        if len(found):
            own, at = np.unique(np.concatenate([found, own]), return_inverse=True)
            n = np.bincount(at, np.concatenate([counts, n])).astype(np.int64)
        found, counts = own, n
    # Letters come first; without any, the text has no n-gram that counts.
    return (found, counts) if len(found) and found[0] < 2**16 else (found[:0], counts[:0])


def _profile(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent n-grams, most frequent first; equal counts by n-gram."""
    return grams[np.argsort(-counts, kind="stable")[:PLACES]]


@dataclass
class Profiles:
    """``place[l, g]``: the place of n-gram ``grams[g]`` in language ``l``, PLACES where it has none."""

    languages: list[str]
    grams: np.ndarray
    place: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        found, counts = _grams(text or "")
        if not len(found) or not self.languages:
            return UNKNOWN, 0.0
        own = _profile(found, counts)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        known = self.grams[at] == own
        ranks = np.arange(len(own))
        away = np.abs(self.place[:, at] - ranks)
        away = np.where(known & (self.place[:, at] < PLACES), away, PLACES).sum(axis=1)
        best = int(np.argmin(away))
        return self.languages[best], float(1 - away[best] / (PLACES * len(own)))


def _sample(usable: DataFrame, sample_rows: int) -> DataFrame:
    """``doc_id, lang`` of the ``sample_rows`` rows of each language that come first by the hash of their id."""
    rows = usable.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_SHARES)).alias("share"))
    for own in (["lang", "share"], ["lang"]):
        order = Window.partitionBy(*own).orderBy(F.xxhash64("doc_id"), "doc_id")
        rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample_rows).drop("n")
    return rows.drop("share")


def learn(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Profiles:
    """Profiles from ``labelled (doc_id, text, lang)``; rows without text or language are left out.

    At most ``sample_rows`` documents per language are read. Counts are summed by Spark; only
    the PLACES best n-grams of each language reach the driver.
    """
    usable = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    chosen = few(materialize(_sample(usable, sample_rows).distinct(), "language-sample"))

    def count(batch: pa.RecordBatch) -> dict:
        held: dict[str, list] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            held.setdefault(lang, []).append(text)
        langs, grams, counts = [], [], []
        for lang, own in held.items():
            found, n = _grams("\n".join(own))
            langs += [lang] * len(found)
            grams.append(found.view(np.int64))
            counts.append(n)
        joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (grams, counts)]
        return {"lang": langs, "gram": joined[0], "n": joined[1]}

    sums = map_texts(usable.join(chosen, ["doc_id", "lang"]), count, "lang string, gram bigint, n bigint")
    sums = sums.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    table = sums.withColumn("place", place).where(F.col("place") < PLACES)
    rows = table.select("lang", "gram", "place").limit(MAX_LANGUAGES * PLACES + 1).collect()
    if len(rows) > MAX_LANGUAGES * PLACES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted({r["lang"] for r in rows})
    grams = np.unique(np.array([r["gram"] for r in rows], np.int64).view(np.uint64))
    matrix = np.full((len(languages), len(grams)), PLACES, np.int64)
    row = {lang: i for i, lang in enumerate(languages)}
    for r in rows:
        matrix[row[r["lang"]], np.searchsorted(grams, np.uint64(r["gram"] % 2**64))] = r["place"]
    return Profiles(languages, grams, matrix)


def identify(docs: DataFrame, profiles: Profiles, *keep: str, text: str = "text") -> DataFrame:
    """``docs`` (the named columns) with ``lang_pred`` and ``score`` from its ``text`` alone.

    ``text`` may name a field of a struct column among ``keep``, so that no text travels twice.

    The language whose profile has the least summed out-of-place distance to the document's
    own; equal distances go to the first name. The score is 1 less the distance as a share of the
    greatest possible one. Null texts and texts without a letter are ``und`` with score 0, and
    so is everything where no language was learned. Repeated rows are handled one by one;
    other columns are ignored.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def predict(batch: pa.RecordBatch) -> dict:
        found = [profiles.predict(t) for t in field(batch, text).to_pylist()]
        out = {"lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}
        return {**{k: batch[k] for k in keep}, **out}

    needed = docs.select(*dict.fromkeys([text.split(".")[0], *keep]))
    return map_texts(needed, predict, f"{fields}, lang_pred string, score double", text)


def lettered(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The named columns of the rows of ``docs`` whose ``text`` has a letter, as :func:`identify` sees it."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def look(batch: pa.RecordBatch) -> dict:
        return {**{k: batch[k] for k in keep}, "lettered": [any(map(str.isalpha, t or "")) for t in field(batch, text).to_pylist()]}

    needed = docs.select(*dict.fromkeys([text.split(".")[0], *keep]))
    return map_texts(needed, look, f"{fields}, lettered boolean", text).where("lettered").select(*keep)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is never learned from: the crc32 of its id as text leaves 2 by 4."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def split_identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, learned from the documents not held out."""
    profiles = learn(docs.where(~F.coalesce(held_out(), F.lit(False))))
    found = identify(docs, profiles, "doc_id")
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
