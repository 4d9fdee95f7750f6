"""Toxicity by a factorization machine over hashed terms."""

from dataclasses import dataclass

from pyspark.ml.classification import FMClassificationModel, FMClassifier
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tablesmith.session import materialize, release

# Terms (runs of letters, in lower case) fall into 2**TERM_BITS numbers.
TERM_BITS = 18
# Learned from about so many labelled documents of either label, taken by the hash of their id.
SAMPLE_ROWS = 20_000
# A term is tied to label 1 if chance alone would tie fewer than so many terms of the table so strongly.
CHANCE_TERMS = 0.05
FACTORS, ROUNDS, STEP, PENALTY = 8, 120, 0.1, 1e-4
TOXIC_FROM = 0.7


def terms(docs: DataFrame) -> DataFrame:
    """``docs`` with the vector ``terms`` of the hashed terms of the whole ``text``, each 1 however often it occurs."""
    words = RegexTokenizer(pattern="\\p{L}+", gaps=False, inputCol="text", outputCol="words")
    hashed = HashingTF(numFeatures=1 << TERM_BITS, binary=True, inputCol="words", outputCol="terms")
    filled = docs.withColumn("text", F.coalesce("text", F.lit("")))
    return hashed.transform(words.transform(filled)).drop("words", "text")


def _sample(labelled: DataFrame, sample_rows: int) -> DataFrame:
    """About ``sample_rows`` rows ``doc_id, toxic`` of either label: those whose hashed id is below a threshold."""
    counts = dict(labelled.groupBy("toxic").count().collect())
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    most = {label: (1 << 40) * min(1, sample_rows / n) for label, n in counts.items()}
    return labelled.where(place < F.when(F.col("toxic") == 1, most.get(1, 0)).otherwise(most.get(0, 0)))


def labelled_terms(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``label, terms`` of the bounded sample; documents of equal terms and label count once.

    Ids whose labels contradict each other are not learned from. The ids of the sample are so
    few, whatever the input, that they are sent to the texts.
    """
    marks = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
    chosen = _sample(marks.where("toxic = most").select("doc_id", "toxic"), sample_rows)
    rows = terms(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("double").alias("label")))
    return rows.dropDuplicates(["label", "terms"])


def tied_terms(rows: DataFrame) -> list[int]:
    """Numbers of the terms that go with label 1 more often than chance allows.

    By Chernoff's bound: ``n`` documents have a share ``q`` of toxic ones where all have ``p``
    with a chance of at most ``exp(-n * divergence(q, p))``.
    """
    indices = F.from_json(F.to_json(F.struct("terms")), "terms struct<indices array<int>>")["terms"]["indices"]
    counts = rows.select(F.explode(indices).alias("term"), "label").groupBy("term").agg(F.count("*").alias("n"), F.avg("label").alias("q"))
    share, found = rows.agg(F.avg("label")).first()[0], counts.count()
    if not share or share == 1:
        return []
    part: Column = lambda q, p: F.when(q > 0, q * F.log(q / p)).otherwise(0.0)
    q = F.col("q")
    strength = F.col("n") * (part(q, F.lit(share)) + part(1 - q, F.lit(1 - share)))
    tied = counts.where((q > share) & (strength > F.log(F.lit(max(found, 1) / CHANCE_TERMS))))
    return sorted(r["term"] for r in tied.select("term").collect())


@dataclass
class Toxicity:
    """What was learned: the share of toxic documents, the terms used, and their weights and factors."""

    share: float
    terms: list[int]
    machine: FMClassificationModel | None

    def score(self, docs: DataFrame, *keep: str) -> DataFrame:
        """The columns ``keep`` of ``docs`` with the probability ``score`` of its ``text``."""
        if self.machine is None:
            return docs.select(*keep).withColumn("score", F.lit(float(self.share)))
        own = docs.select("text", F.struct(*keep).alias("document"))
        scored = self.machine.transform(_features(terms(own), self.terms))
        return scored.select("document.*", vector_to_array("probability")[1].alias("score"))


def _features(rows: DataFrame, own: list[int]) -> DataFrame:
    """The tied terms alone, as vectors of length 1, so that a single one counts as much as many."""
    tied = VectorSlicer(inputCol="terms", outputCol="tied", indices=own).transform(rows)
    return Normalizer(inputCol="tied", outputCol="features").transform(tied)


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Toxicity:
    """A machine from the ``labels (doc_id, toxic)`` of ``docs (doc_id, text)``.

    Spark's factorization machine gives each term tied to label 1 a weight and FACTORS factors,
    so that a pair of terms adds the product of their factors. Other terms would only add noise
    to long texts.
    """
    paths: list[str] = []
    rows = materialize(labelled_terms(docs, labels, sample_rows), "labelled-terms", paths)
    share, own = rows.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0], tied_terms(rows)
    machine = None
    if own:
        fm = FMClassifier(factorSize=FACTORS, maxIter=ROUNDS, stepSize=STEP, regParam=PENALTY, seed=12)
        machine = fm.fit(_features(rows, own))
    release(docs.sparkSession, paths)
    return Toxicity(share, own, machine)


def held_out() -> Column:
    """Whether a label is never learned from: the crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def split_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``, learned from the labels of documents not held out.

    A score is the learned probability of label 1 and depends on the text alone. Empty and null
    texts have the score of a text without any term tied to a label. Rows without ``doc_id``
    are scored and never learned from; repeated rows are scored one by one; of documents with
    equal terms and label one is learned from; ids with contradicting labels and labels other
    than 0 and 1 are left out. Where no term is tied to a label (few labels, or one label only),
    every score is the share of toxic documents, 0 without labels. Other columns are ignored.
    """
    found = learn(docs.where(~held_out()), labels).score(docs, "doc_id")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))
