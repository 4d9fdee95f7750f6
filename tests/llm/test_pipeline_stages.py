"""The stages of the pipeline on odd rows, rows without an id and tables without labels."""

from collections import Counter
from pathlib import Path

import pytest

from corpus_pipeline import STAGES, decontamination, exact_dedup, language_id, near_dedup, packing
from tests.llm.conftest import ODD

SF_DIR = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i}" for i in range(60))


def rows(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def stored(spark):
    """Names of the tables in the shared folder."""
    return [p.name for p in Path(spark.conf.get("spark.checkpoint.dir"), "tablesmith").glob("*")]


def lettered(given):
    return Counter((i, t) for i, t, *_ in given if any(map(str.isalpha, t or "")))


def test_languages_without_labels(spark, make):
    given = [*ODD, (7, "123 %"), (8, "the house"), (None, "der fluss"), (None, "...")]
    assert rows(language_id(spark, make(given), SF_DIR)) == lettered(given)
    assert rows(language_id(spark, make(given).drop("lang"), SF_DIR)) == lettered(given)
    labelled = [*given, *((i, "the river and the house", "en") for i in range(100, 120))]
    assert rows(language_id(spark, make(labelled), SF_DIR)) == lettered(labelled)


def test_exact_copies_without_ids(spark, make):
    given = [*ODD, (None, "a"), (None, "a  b c"), (None, LONG), (9, "a b  d"), (None, "a b d")]
    got = rows(exact_dedup(spark, make(given), SF_DIR))
    texts = Counter(" ".join((t or "").split()) for _, t in got.elements())
    assert texts == Counter({"": 1, **{" ".join(t.split()): 1 for t in ("a", ODD[6][1], "a b c", LONG, "a b d")}}) + Counter({"": 1})
    assert {i for i, _ in got} == {1, 3, 4, 6, 9, None}
    assert rows(exact_dedup(spark, make([(None, "x y"), (None, None)]), SF_DIR)) == Counter([(None, "x y"), (None, None)])


def test_near_copies_without_ids(spark, make):
    given = [*ODD, (9, LONG), (None, LONG + " more"), (None, "some other text of a few more words"), (None, "A  b c")]
    got = rows(near_dedup(spark, make(given), SF_DIR))
    assert {i for i, _ in got} == {1, 2, 3, 4, 6, 9, None}
    assert sorted(t.lower().split() for i, t in got if i is None) == [["a", "b", "c"], given[-2][1].split()]
    assert sum(got.values()) == 8


def test_benchmark_items_without_ids(spark, make):
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").where("text is not null").orderBy("item_id").first()["text"]
    given = [*ODD, (9, item), (None, "before " + item)]
    assert rows(decontamination(spark, make(given), SF_DIR)) == Counter(ODD)


@pytest.mark.parametrize("name, stage", STAGES)
def test_stages_on_odd_rows(spark, make, name, stage):
    got = stage(spark, make(ODD), SF_DIR)
    assert got.where("doc_id is null").count() >= 1
    assert stage(spark, make([]), SF_DIR).collect() == []


def test_rows_that_share_an_id(spark, make):
    """A row is judged by its own text, not by that of another row with its id."""
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").where("text is not null").orderBy("item_id").first()["text"]
    assert rows(decontamination(spark, make([(5, item), (5, "clean words here"), (6, "more")]), SF_DIR)) == Counter([(5, "clean words here"), (6, "more")])
    given = [(4, "one text"), (5, "one  text"), (5, "another text"), (7, "third"), (None, "third")]
    assert rows(exact_dedup(spark, make(given), SF_DIR)) == Counter([(4, "one text"), (5, "another text"), (7, "third")])
    given = [(2**63 - 1, "third"), (None, "third"), (None, "fourth")]
    assert sorted(t for _, t in rows(exact_dedup(spark, make(given), SF_DIR)).elements()) == ["fourth", "third"]
    given = [(4, LONG), (5, LONG + " more"), (5, "quite another text of some words")]
    assert rows(near_dedup(spark, make(given), SF_DIR)) == Counter([(4, LONG), given[2]])


@pytest.mark.parametrize("stage", [exact_dedup, near_dedup, decontamination])
def test_rows_stay_where_they_are(spark, make, tmp_path, stage):
    """Dropping a few rows moves no text in an exchange, and leaves no table on disk but their numbers."""
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").where("text is not null").orderBy("item_id").first()["text"]
    make([(1, LONG), (2, LONG), (3, LONG + " more"), (4, "quite another text"), (5, item)], extra=False).write.parquet(str(tmp_path / "documents"))
    before = set(stored(spark))
    got = stage(spark, spark.read.parquet(str(tmp_path / "documents")), SF_DIR)
    left = {name.rsplit("-", 1)[0] for name in set(stored(spark)) - before}
    kept = {exact_dedup: {1, 3, 4, 5}, near_dedup: {1, 4, 5}, decontamination: {1, 2, 3, 4}}[stage]
    assert {i for i, _ in rows(got)} == kept
    assert left <= {"odd-ids", "dropped-rows"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_predicted_languages_fill_gaps(spark, make):
    labelled = [(i, "the river and the house of the king", "en") for i in range(100, 120)] + [(i, "der fluss und das haus des herrn", "de") for i in range(200, 220)]
    given = make([*labelled, (1, "the house and the king"), (2, "das haus und der herr"), (3, "12")])
    got = {r["doc_id"]: r["lang"] for r in language_id(spark, given, SF_DIR).collect()}
    assert len(got) == 42 and (got[1], got[2]) == ("en", "de")
    assert {r["lang"] for r in language_id(spark, given, SF_DIR, ["de"]).collect()} == {"de"}


def test_packing_without_ids(spark, make):
    got = packing(spark, make(ODD), SF_DIR).where("doc_id is null").collect()
    assert sum(r["length"] for r in got) == 4
