"""The registered queries against SQL or plain versions over a whole small table."""

import zlib
from hashlib import sha256

import pyarrow.parquet as pq
import pytest

from checks.compare import connect, difference
from tablesmith.llm.queries import ORACLES, QUERIES
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    table = pq.read_table(f"{SF_DIR}/documents.parquet", columns=["doc_id", "text", "lang"])
    return sorted(zip(*[table[n].to_pylist() for n in ("doc_id", "text", "lang")]))


def result(spark, name):
    return {r["doc_id"]: r.asDict() for r in QUERIES[name](spark, SF_DIR).collect()}


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_as_sql(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) is None


def digest(spans):
    return sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


@pytest.mark.parametrize("name, plain", [("op2_personal_data", brute.personal), ("op9_secrets", brute.credentials)])
def test_plain_spans(spark, documents, name, plain):
    got = result(spark, name)
    for i, text, _ in documents:
        spans = plain(text)
        assert got[i]["base_sha256"] == digest(spans)
        assert set(f"{k}:{s}:{e}" for k, s, e in spans) <= set(got[i]["spans"].split(","))
        for kind in {k for k, _, _ in spans}:
            assert got[i][f"n_{kind}"] == sum(k == kind for k, _, _ in spans)


def test_near_groups(spark, documents):
    got = {i: (r["n_shingles"], r["component_id"]) for i, r in result(spark, "op1_jaccard_join").items()}
    assert got == brute.near([(i, t) for i, t, _ in documents], 4, 85)


def test_repeated_substrings(spark, documents):
    got = result(spark, "op7_repeated_substrings")
    for i, (spans, kept) in brute.repeats([(i, t) for i, t, _ in documents], 400).items():
        row = got[i]
        assert (row["n_removed"], row["n_spans"]) == (sum(e - s for s, e in spans), len(spans))
        assert row["kept_sha256"] == sha256(kept).hexdigest()


def test_languages(spark, documents):
    got = result(spark, "op3_language")
    held = [got[i]["lang_pred"] == lang for i, _, lang in documents if got[i]["held_out"]]
    assert sum(held) >= 0.95 * len(held)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in documents)


def test_lines(spark, documents):
    got = result(spark, "op10_line_dedup")
    for i, text, _ in documents:
        left = text
        spans = [tuple(map(int, s.split(":"))) for s in got[i]["spans"].split(",") if s]
        for s, e in reversed(spans):
            left = left[:s] + left[e:]
        assert got[i]["kept_sha256"] == sha256(left.encode()).hexdigest() and got[i]["n_removed"] == len(text) - len(left)


def test_packing(spark, documents):
    rows = QUERIES["op5_best_fit_packing"](spark, SF_DIR).collect()
    assert sum(r["length"] for r in rows) == sum(len(brute.words(t)) + 1 for _, t, _ in documents)


def test_pipeline(spark, documents):
    """Each stage's decisions by plain versions."""
    rows = [(i, t) for i, t, _ in documents if any(c.isalpha() for c in t or "")]
    rows = [(r[0], dict(rows)[r[0]]) for r in brute.exact(rows) if r[3]]
    rows = _least(rows)
    items = pq.read_table(f"{SF_DIR}/benchmark.parquet")
    bad = {d for d, *_ in brute.containment(rows, list(zip(items["item_id"].to_pylist(), items["text"].to_pylist())))}
    expected = {i: len(brute.words(t)) + 1 for i, t in rows if i not in bad}
    got = {}
    for r in QUERIES["pipeline"](spark, SF_DIR).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == expected


def _least(rows):
    found = brute.near(rows, 5, 80)
    return [(i, t) for i, t in rows if found[i][1] == i]
