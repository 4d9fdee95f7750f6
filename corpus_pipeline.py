"""A training corpus from raw documents: five stages, each over all that the one before kept."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablesmith.llm.base import documents, few, with_rows
from tablesmith.llm.contamination import contained_items
from tablesmith.llm.exact import exact_groups
from tablesmith.llm.jaccard import similar_groups
from tablesmith.llm.language import UNKNOWN, held_out, identify, learn, lettered
from tablesmith.llm.packing import best_fit
from tablesmith.session import materialize, release

#: Language identification learns from data, so no SQL gives the rows of ``run``.
ORACLE_SQL = None


def _rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` with a number ``row`` each, and ``doc_id, text`` of them by that number.

    It is the ``doc_id`` where only one row has it; rows without one, or with one that others
    have too, come after all others (before them if ids next to 2**63 leave no room).
    """
    named = with_rows(docs.select("doc_id", "text", F.struct("*").alias("document")))
    return named, named.select(F.col("row").alias("doc_id"), "text")


def _without(named: DataFrame, dropped: DataFrame, paths: list[str]) -> DataFrame:
    """The rows but for those whose number is a ``doc_id`` in ``dropped``.

    Only the numbers to be dropped are stored, so that the rows need not be moved for a join if
    these are few; the tables of ``paths``, from which they were found, are deleted.
    """
    ids = materialize(dropped.select(F.col("doc_id").alias("row")).distinct(), "dropped-rows")
    release(named.sparkSession, paths)
    return named.join(few(ids), "row", "left_anti").select("document.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: list[str] | None = None) -> DataFrame:
    """Drops null texts and texts without a letter, which are of no language; with ``languages``, all others, too.

    The predicted language is written into ``lang`` where that is null. Without any labelled
    document nothing is learned, and then no text with a letter is dropped.
    """
    whole = docs.select(F.struct("*").alias("document"))
    profiles = learn(docs.where(~F.coalesce(held_out(), F.lit(False)))) if "lang" in docs.columns else None
    if not (profiles and profiles.languages):
        return lettered(whole, "document", text="document.text").select("document.*")
    kept = identify(whole, profiles, "document", text="document.text").where(F.col("lang_pred") != UNKNOWN)
    kept = kept if languages is None else kept.where(F.col("lang_pred").isin(languages))
    return kept.select(F.col("document").withField("lang", F.coalesce("document.lang", "lang_pred")).alias("document")).select("document.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first row of each group of equal texts: the least ``doc_id``, rows without one of their own last."""
    named, own = _rows(docs)
    paths: list[str] = []
    return _without(named, exact_groups(own, paths).where("not kept"), paths)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first row of each group of near copies: five words, similarity 0.8.

    The first is that of the least ``doc_id``; rows without one of their own come last.
    """
    named, own = _rows(docs)
    paths: list[str] = []
    return _without(named, similar_groups(own, size=5, percent=80, paths=paths).where("doc_id != component_id"), paths)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a benchmark item, whatever their ``doc_id``: five words, containment 0.8."""
    named, own = _rows(docs)
    paths: list[str] = []
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(named, contained_items(own, items, paths=paths), paths)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the documents' words and end marks."""
    return best_fit(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what one returns is stored for the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
