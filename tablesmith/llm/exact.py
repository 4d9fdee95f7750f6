"""Exact de-duplication by content-defined chunk recipes, in DataFrame functions only."""

from pyspark.sql import Column, DataFrame, functions as F

from tablesmith.llm.base import BLANKS, texts
from tablesmith.session import materialize

# A chunk ends at a sign of the first kind before a space and a sign of the second kind,
# wherever that is in the text, so chunks after an insertion are the same as before it. A
# text without such a place is cut after MAX_CHUNK characters.
CUT, NEXT, MAX_CHUNK = "[.!?;:}>]", "[A-Ca-c]", 8_000


def normalized(text: Column) -> Column:
    """Every run of ASCII white space as one space."""
    return F.regexp_replace(text, BLANKS, " ")


def chunks(text: Column) -> Column:
    """The text cut at places that its content decides; joined they are the text again."""
    shape = f"(?s).{{1,{MAX_CHUNK - 1}}}?{CUT}(?= {NEXT})|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(text, F.lit(shape), F.lit(0))


def recipes(docs: DataFrame) -> DataFrame:
    """``doc_id, text_sha256, recipe``: a document as the list of its chunks' identifiers.

    An identifier is the SHA-256 of a chunk. It is verified: chunks are grouped by digest and
    text, and a document that holds a digest with two different texts carries its whole text
    at the end of the recipe, so that lists are equal only for equal texts.
    """
    whole = texts(docs).select("doc_id", normalized(F.col("text")).alias("text"))
    parts = whole.select(F.explode(chunks(F.col("text"))).alias("chunk"))
    known = parts.select(F.unhex(F.sha2("chunk", 256)).alias("digest"), "chunk").distinct()
    clashing = known.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    # The set of clashing digests is empty but for a broken hash.
    clashes = clashing.agg(F.collect_set("digest")).scalar()
    ids = F.transform(chunks(F.col("text")), lambda c: F.unhex(F.sha2(c, 256)))
    listed = whole.select("doc_id", "text", F.sha2("text", 256).alias("text_sha256"), ids.alias("ids"))
    tail = F.when(F.arrays_overlap("ids", clashes), F.array(F.encode("text", "UTF-8")))
    recipe = F.concat("ids", F.coalesce(tail, F.array().cast("array<binary>"))).alias("recipe")
    return listed.select("doc_id", "text_sha256", recipe)


def exact_groups(docs: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``docs (doc_id, text)``.

    Equal are texts that agree after each run of ASCII white space became one space. The
    least ``doc_id`` of a group stays. Null counts as the empty text, empty texts are equal to
    each other, further columns are ignored, an empty table gives an empty result. Rows that
    repeat a ``doc_id`` count one by one, and all rows with the kept id stay. Tables stored on
    the way are added to ``paths``.
    """
    listed = materialize(recipes(docs), "recipes", paths)
    groups = listed.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # Stored, so that both sides of the join are plain exchanges: one large group of copies is
    # then split over several tasks.
    groups = materialize(groups.where("group_size > 1"), "copies", paths)
    joined = listed.join(groups, "recipe", "left")
    keep, size = F.coalesce("keep_id", "doc_id"), F.coalesce("group_size", F.lit(1).cast("bigint"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), size.alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256"
    )
