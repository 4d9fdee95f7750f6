"""Secrets, and weak parts of credentials that only count next to their complement."""

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablesmith.llm.arrow import map_texts
from tablesmith.llm.base import texts
from tablesmith.session import materialize

KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
# Parts belong to one scope if they lie in one document with at most so many characters between.
REACH = 400

# ASCII only: no other letter counts as the upper or lower case of one of these.
ASSIGN = re.compile(
    r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

# Weak parts: what names an account, what may be a key, where one could use it. No part has
# a greatest length; each pattern reads a run of its characters once.
ID = re.compile(r"(?ai:access_?key_?id|client_?id|account_?id|user_?name|login)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@_.-]{4,})")
ID_SHAPE = re.compile(r"(?<![A-Za-z0-9])A[A-Z]IA[A-Z0-9]{12,16}(?![A-Za-z0-9])")
KEY = re.compile(r"(?ai:private_?key|access_?key|client_?key|auth|signature|pwd|pass)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]{8,})")
KEY_SHAPE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")
DIGIT = re.compile("[0-9]")
ENDPOINT = re.compile(r"https?://[A-Za-z0-9.-]{3,}(?::[0-9]{1,5})?(?:/[A-Za-z0-9._~/%-]*)?")
ENDPOINT_NAME = re.compile(r"(?ai:endpoint|host|server|region|bucket)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9./:_-]{4,})")
# Words without which a pattern cannot match, in lower case; looked for first, being cheaper.
HINTS = {
    ASSIGN: ("password", "passwd", "secret", "token", "apikey", "api_key"),
    ID: ("access", "client", "account", "user", "login"),
    KEY: ("key", "auth", "signature", "pwd", "pass"),
    ENDPOINT_NAME: ("endpoint", "host", "server", "region", "bucket"),
}
# Bits per character from which a long word looks random.
ENTROPY = 3.7


def _matches(pattern: re.Pattern, text: str, lower: str):
    return pattern.finditer(text) if any(h in lower for h in HINTS[pattern]) else ()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    found = [(0, *m.span()) for m in _matches(ASSIGN, text, text.lower()) if m.end(1) - m.start(1) >= 8]
    found += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [(2, *m.span()) for m in HEX.finditer(text)]


def _random(word: str) -> bool:
    if not (re.search("[0-9]", word) and re.search("[a-z]", word) and re.search("[A-Z]", word)):
        return False
    return -sum(n / len(word) * math.log2(n / len(word)) for n in Counter(word).values()) >= ENTROPY


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Parts that overlap neither a plain secret nor, within their kind, one another."""
    lower = text.lower()
    shaped = KEY_SHAPE.finditer(text) if DIGIT.search(text) else ()
    found = [
        *((3, *m.span(1)) for m in _matches(ID, text, lower)),
        *((3, *m.span()) for m in (ID_SHAPE.finditer(text) if "IA" in text else ())),
        *((4, *m.span(1)) for m in _matches(KEY, text, lower)),
        *((4, *m.span()) for m in shaped if _random(m[0])),
        *((5, *m.span()) for m in ENDPOINT.finditer(text)),
        *((5, *m.span(1)) for m in _matches(ENDPOINT_NAME, text, lower)),
    ]
    taken = sorted((s, e) for _, s, e in base)
    out, at, free = [], 0, {}
    for start, end, kind in sorted((s, e, k) for k, s, e in found):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if (at == len(taken) or taken[at][0] >= end) and free.get(kind, 0) <= start:
            out.append((kind, start, end))
            free[kind] = end
    return out


def parts(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` with ``rank, kind, start, end, base``: all parts, weak ones included."""

    def scan(batch: pa.RecordBatch) -> dict:
        out = []
        for text in batch["text"].to_pylist():
            base = base_spans(text)
            named = ((True, base), (False, weak_spans(text, base)))
            out.append([{"rank": k, "kind": KINDS[k], "start": s, "end": e, "base": b} for b, f in named for k, s, e in f])
        return {"doc_id": batch["doc_id"], "spans": out}

    span = "struct<rank: int, kind: string, start: int, end: int, base: boolean>"
    return map_texts(texts(docs), scan, f"doc_id bigint, spans array<{span}>")


def secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``doc_id, spans``: secrets of every row of ``docs (doc_id, text)``.

    Plain secrets (``base``) always count. A weak part counts if a complement lies in the same
    document at most ``reach`` characters away: a key for an identifier or an endpoint, either
    of them for a key; plain secrets are complements too. A key may lie in its endpoint, but a
    weak key and an identifier that overlap are two readings of one word and do not link each
    other. Parts are joined on the row and the cells of ``reach`` characters that they touch, a complement's widened by ``reach`` on
    both sides, so that a long document is spread over many tasks and no near pair is lost. Null
    and empty texts have no spans, other columns are ignored. Each row is a scope of its own,
    also without a ``doc_id`` or with one that other rows have, too.
    """
    # Rows are numbered where they are stored, so that a number stays with its row.
    all_parts = materialize(parts(docs).withColumn("row", F.monotonically_increasing_id()), "secret-parts")
    one = all_parts.select("row", F.explode("spans").alias("s")).select("row", "s.*").distinct()
    # Sides: 1 names or locates, 2 opens. Only unlike sides complement each other.
    one = one.withColumn("side", F.when(F.col("kind").isin("access", "id", "endpoint"), 1).otherwise(2))
    first, last = (F.floor(F.col(n) / reach).cast("int") for n in ("start", "end"))
    weak = one.where("not base").withColumn("cell", F.explode(F.sequence(first, last)))
    other = one.select("row", "kind", "side", "start", "end", F.explode(F.sequence(first - 1, last + 1)).alias("cell"))
    near = (
        (F.col("w.row") == F.col("o.row")) & (F.col("w.cell") == F.col("o.cell"))
        & (F.col("w.side") != F.col("o.side"))
        & (F.col("o.start") - F.col("w.end") <= reach) & (F.col("w.start") - F.col("o.end") <= reach)
        & ~(
            ((F.col("w.kind") == "id") | (F.col("o.kind") == "id"))
            & (F.col("o.start") < F.col("w.end")) & (F.col("w.start") < F.col("o.end"))
        )
    )
    linked = weak.alias("w").join(other.alias("o"), near, "left_semi").drop("cell")
    fields = F.struct("rank", "kind", "start", "end", "base")
    kept = one.where("base").unionByName(linked).groupBy("row").agg(F.collect_set(fields).alias("kept"))
    joined = all_parts.select("row", "doc_id").join(kept, "row", "left")
    return joined.select("doc_id", F.coalesce("kept", F.array().cast(kept.schema["kept"].dataType)).alias("spans"))
