"""Token ids of all documents in files: a frame per document under one shared dictionary."""

import os
import re
import zlib
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tablesmith.llm.arrow import map_texts, slices
from tablesmith.llm.base import few, texts
from tablesmith.session import materialize

END_ID = 0
# The dictionary is trained on at most so many arrays, each cut to so many bytes.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 2_000, 8_192, 64_000
# A worker remembers the ids of so many distinct words, those it met last, and of as many more between
# two clearings.
CACHE_WORDS = 300_000

# A space or line break before a sign always starts a new piece of byte-level BPE, so ids can
# be looked up word by word. A word keeps white space that no sign follows, and the line break
# before it; the space before it is left out.
WORDS = re.compile(r" (?=\S)|(?=\n\S)")
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# The texts in which white space or the end follows a space or line break.
ODD = rf"[ \n](?:{BLANK}|\z)"
# The words with a space in them or white space at an end.
EDGED = rf"\A{BLANK}| |{BLANK}\z"
# A sign after a word of Latin letters only is a piece of its own.
SIGNS = ".,;:!?"
SIGNED = rf"\A[A-Za-z\x{{c0}}-\x{{d6}}\x{{d8}}-\x{{f6}}\x{{f8}}-\x{{17f}}]+[{SIGNS}]\z"
# So many words are encoded as one text.
TOGETHER = 500

BLOCK = (
    "part int, block int, first_doc_id bigint, last_doc_id bigint, dictionary string, "
    "doc_ids array<bigint>, offsets array<int>, counts array<int>, frames binary"
)


def _order(mask: pa.Array) -> np.ndarray:
    """Where each row lies once those outside the mask come first."""
    held = mask.to_numpy(zero_copy_only=False)
    return np.argsort(np.concatenate([np.flatnonzero(~held), np.flatnonzero(held)]))


def _merged(mask: pa.Array, outside: pa.Array, inside: pa.Array) -> pa.Array:
    return pa.concat_arrays([outside, inside]).take(pa.array(_order(mask)))


class Encoder:
    """Ids of texts as little-endian bytes, word by word, by one tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 65_536 else "<u4")
        self.spaced = np.zeros(size, bool)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.spaced[number] = token.startswith("Ġ")
        self.words, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.met, self.round = np.zeros(0, np.int64), 0
        self.end = np.array([END_ID], self.dtype).tobytes()
        self.signs = pa.array([*(self._ids([s])[0].tobytes() for s in SIGNS), b""], pa.large_binary())

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype) for x in found]

    def _learn(self, words: pa.Array) -> pa.Array:
        """The ids of words after a space: plain ones many at once, split where an id starts with a space."""
        edged = pc.match_substring_regex(words, EDGED)
        plain = words.filter(pc.invert(edged))
        cuts = pa.array([*range(0, len(plain), TOGETHER), len(plain)], pa.int32())
        some = pc.binary_join(pa.ListArray.from_arrays(cuts, plain), pa.scalar(" ", plain.type)).to_pylist() if len(plain) else []
        ids = np.concatenate([np.zeros(0, self.dtype), *self._ids([" " + s for s in some])])
        starts = np.flatnonzero(self.spaced[ids])
        assert len(starts) == len(plain)
        edges = np.append(starts, len(ids)).astype(np.int64) * self.dtype.itemsize
        found = pa.Array.from_buffers(pa.large_binary(), len(plain), [None, pa.py_buffer(edges), pa.py_buffer(ids)])
        rest = self._ids([w if w[:1] == "\n" else " " + w for w in words.filter(edged).to_pylist()])
        return _merged(edged, found, pa.array([x.tobytes() for x in rest], pa.large_binary()))

    def _look_up(self, words: pa.Array) -> pa.Array:
        """The ids of different words."""
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(at))
        place = at.fill_null(-1).to_numpy().astype(np.int64)
        place[place < 0] = len(self.words) + np.arange(len(new))
        self.words, self.ids = pa.concat_arrays([self.words, new]), pa.concat_arrays([self.ids, self._learn(new)])
        self.round += 1
        self.met = np.append(self.met, np.full(len(new), self.round))
        self.met[place] = self.round
        found = self.ids.take(pa.array(place))
        if len(self.words) > 2 * CACHE_WORDS:
            last = pa.array(np.argsort(-self.met, kind="stable")[:CACHE_WORDS])
            self.words, self.ids, self.met = self.words.take(last), self.ids.take(last), self.met[last]
        return found

    def _different(self, words: pa.Array) -> pa.Array:
        """The ids of different words, with a sign at their end or without."""
        signed = pc.match_substring_regex(words, SIGNED)
        bare = pc.if_else(signed, pc.utf8_slice_codeunits(words, 0, -1), words).dictionary_encode()
        sign = pc.index_in(pc.utf8_slice_codeunits(words, -1), value_set=pa.array(list(SIGNS), pa.large_string()))
        ends = self.signs.take(pc.if_else(signed, sign, len(SIGNS)))
        return pc.binary_join_element_wise(self._look_up(bare.dictionary).take(bare.indices), ends, pa.scalar(b"", ends.type))

    def encode(self, many: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text with the end id."""
        texts = pa.array(many, pa.string()).cast(pa.large_string())
        if not len(texts):
            return []
        odd = pc.match_substring_regex(texts, ODD)
        plain = pc.split_pattern(pc.replace_substring(texts.filter(pc.invert(odd)), "\n", " \n"), " ")
        others = pa.array([WORDS.split(t) for t in texts.filter(odd).to_pylist()], plain.type)
        split = pa.concat_arrays([plain, others])
        starts, words = split.offsets.to_numpy(), split.values
        first = [ids.tobytes() for ids in self._ids(words.take(pa.array(starts[:-1])).to_pylist())]
        later = np.ones(len(words), bool)
        later[starts[:-1]] = False
        each = words.filter(pa.array(later)).dictionary_encode()
        ids = self._different(each.dictionary).take(each.indices)
        edges = starts - np.arange(len(starts))
        at, raw = [0] * len(edges), b""
        if len(ids):
            _, places, data = ids.buffers()
            at, raw = np.frombuffer(places, np.int64)[edges].tolist(), memoryview(data)
        found = [b"".join((f, raw[a:b], self.end)) for f, a, b in zip(first, at, at[1:])]
        return [found[i] for i in _order(odd).tolist()]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """A zstandard dictionary from a bounded sample of documents, taken by the hash of their id."""
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = docs.select("doc_id").orderBy(*order).limit(SAMPLE_ROWS).distinct()
    sample = texts(docs).join(few(materialize(chosen, "token-sample")), "doc_id", "left_semi")

    def encode(batch: pa.RecordBatch) -> dict:
        return {"ids": [x[:SAMPLE_BYTES] for x in encoder(tokenizer).encode(batch["text"])]}

    arrays = map_texts(sample, encode, "ids binary").limit(2 * SAMPLE_ROWS).collect()
    arrays = sorted(bytes(r["ids"]) for r in arrays)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes()
    except zstandard.ZstdError:  # too little to learn from: frames then stand alone
        return b""


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_tokens(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write ``docs (doc_id, text)`` as ids in ascending ``doc_id`` order.

    ``path/blocks`` holds blocks of documents: their ids, counts, byte offsets and one
    zstandard frame per document, under the dictionary in ``path/dictionary`` that each block
    names by its SHA-256. Part and block numbers ascend with ``doc_id``. Both are Parquet, so a
    lost executor's files are written anew, and a reader prunes blocks by their first and last
    ``doc_id``. Null texts count as empty and have the end id only; rows that repeat a
    ``doc_id`` are all kept, ordered by text; other columns are ignored.
    """
    spark = docs.sparkSession
    raw = train_dictionary(docs, tokenizer)
    digest = sha256(raw).hexdigest()
    spark.createDataFrame([Row(sha256=digest, data=bytearray(raw))], "sha256 string, data binary").coalesce(
        1
    ).write.parquet(f"{path}/dictionary")
    fields = to_arrow_schema(StructType.fromDDL(BLOCK))

    def pack(batches):
        press = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(raw), write_checksum=False)
        own, block = encoder(tokenizer), 0
        for batch in batches:
            for some in slices(batch):
                arrays = own.encode(some["text"])
                frames = [press.compress(a) for a in arrays]
                ids = some["doc_id"].to_pylist()
                row = {
                    "part": TaskContext.get().partitionId(), "block": block, "first_doc_id": ids[0], "last_doc_id": ids[-1],
                    "dictionary": digest, "doc_ids": ids, "offsets": np.cumsum([0, *map(len, frames)]).tolist(),
                    "counts": [len(a) // own.dtype.itemsize for a in arrays], "frames": b"".join(frames),
                }
                block += 1
                yield pa.RecordBatch.from_pylist([row], schema=fields)

    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(pack, BLOCK).write.parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, tokenizer: str, ids: tuple[int, int] | None = None) -> DataFrame:
    """``part, block, place, doc_id, n_tokens, ids`` of the written documents, ids as little-endian bytes.

    ``ids`` names the first and last ``doc_id`` wanted: other blocks are not read, and only
    the wanted frames are decompressed.
    """
    keep = spark.read.parquet(f"{path}/dictionary").collect()[0]
    raw, digest = bytes(keep["data"]), keep["sha256"]
    if sha256(raw).hexdigest() != digest:
        raise ValueError("the dictionary is not the one that was written")
    blocks = spark.read.parquet(f"{path}/blocks")
    if ids is not None:
        blocks = blocks.where((F.col("last_doc_id") >= ids[0]) & (F.col("first_doc_id") <= ids[1]))
    schema = "part int, block int, place int, doc_id bigint, n_tokens int, ids binary"
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def unpack(batches):
        press = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != digest:
                    raise ValueError("a block was written under another dictionary")
                view, edges = memoryview(row["frames"]), row["offsets"]
                out = {name: [] for name in fields.names}
                for i, (doc_id, n) in enumerate(zip(row["doc_ids"], row["counts"])):
                    if ids is None or ids[0] <= (doc_id if doc_id is not None else ids[0] - 1) <= ids[1]:
                        data = press.decompress(view[edges[i] : edges[i + 1]])
                        for name, value in zip(fields.names, (row["part"], row["block"], i, doc_id, n, data)):
                            out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=fields)

    return blocks.mapInArrow(unpack, schema)


def token_index(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of a written folder, from its files alone.

    ``start`` counts the ids of all documents before: sums per part, per block within a part,
    and per document within a block, so that no task sees more than its own part.
    """
    dtype = encoder(tokenizer).dtype

    def check(batch: pa.RecordBatch) -> dict:
        wide = [np.frombuffer(x, dtype).astype("<u4").tobytes() for x in batch["ids"].to_pylist()]
        names = ("part", "block", "place", "doc_id")
        crc = [zlib.crc32(w) for w in wide]
        return {**{n: batch[n] for n in names}, "n_tokens": [len(w) // 4 for w in wide], "ids_crc32": crc}

    schema = "part int, block int, place int, doc_id bigint, n_tokens bigint, ids_crc32 bigint"
    each = materialize(map_texts(read_tokens(spark, path, tokenizer), check, schema, "ids"), "token-index")
    parts = each.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)) + F.col("base")
    return each.join(parts, "part").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")
