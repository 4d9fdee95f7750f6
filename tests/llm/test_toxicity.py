"""Toxicity: held-out labels, pairs that no sum of weights tells apart, odd rows."""

import random
from zlib import crc32

import numpy as np
import pytest

from tablesmith.llm.queries import QUERIES
from tablesmith.llm.toxicity import learn, split_score
from tests.llm.conftest import ODD, by_id


def labels(spark, rows):
    return spark.createDataFrame([(*r, 0, 0.5) for r in rows], "doc_id bigint, toxic int, quality int, score double")


def filler(dice, n):
    return " ".join("".join(dice.choice("abcdefgh") for _ in range(3)) for _ in range(n))


def test_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op12_toxicity"](spark, sf_dir).collect()}
    truth = dict(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").collect())
    held = [i for i in truth if got[i]["held_out"]]
    assert all(r["held_out"] == (crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got.values())
    assert sum(got[i]["predicted"] == truth[i] for i in held) >= 0.95 * len(held)
    assert not any(got[i]["predicted"] for i in held if truth[i] == 0)


def test_pairs_of_terms(spark, make):
    """Toxic are ``rag`` with ``elf`` and ``mug`` with ``orc``; the other pairs are not, which no additive weights can say."""
    dice, rows, marks = random.Random(2), [], []
    for i in range(1_200):
        pair = dice.choice(["rag elf", "mug orc", "rag orc", "mug elf", "", "", "", ""])
        words = [*filler(dice, 20).split(), *pair.split()]
        dice.shuffle(words)
        rows.append((i, " ".join(words)))
        marks.append((i, int(pair in ("rag elf", "mug orc"))))
    got = by_id(split_score(make(rows), labels(spark, marks)), "held_out", "score", "predicted")
    held = [i for i in got if got[i][0]]
    right = [got[i][2] == dict(marks)[i] for i in held]
    assert sum(right) >= 0.97 * len(right)
    model = learn(make(rows), labels(spark, marks))
    found = by_id(model.score(make([(1, "rag elf"), (2, "Orc, mug!"), (3, "rag orc"), (4, "mug elf"), (5, "")]), "doc_id"), "score")
    assert found[1] > 0.7 and found[2] > 0.7 and max(found[3], found[4], found[5]) < 0.3


def test_long_texts_and_copies(spark, make):
    """A single insult is found in any length of text; thousands of copies of one text teach nothing more than one."""
    dice = random.Random(3)
    rows = [(i, filler(dice, 30) + (" idiot" if i % 5 == 0 else "")) for i in range(800)]
    copy = "some quiet words of nothing much"
    rows += [(i, copy) for i in range(800, 3_000)]
    marks = [(i, int(i % 5 == 0)) if i < 800 else (i, 1) for i in range(3_000)]
    model = learn(make(rows), labels(spark, marks))
    found = by_id(model.score(make([(1, filler(dice, 30_000)), (2, filler(dice, 30_000) + " idiot"), (3, copy), (4, "IDIOT")]), "doc_id"), "score")
    assert found[1] < 0.3 and found[2] > 0.7 and found[3] < 0.7 and found[4] > 0.7


def test_score_against_plain_sum(spark, make):
    """The machine's score by its formula."""
    dice = random.Random(4)
    rows = [(i, filler(dice, 10) + dice.choice([" idiot moron", " idiot", " moron", "", "", ""])) for i in range(600)]
    marks = [(i, int("idiot" in t or "moron" in t)) for i, t in rows]
    model = learn(make(rows), labels(spark, marks))
    linear, factors = model.machine.linear.toArray(), model.machine.factors.toArray()
    got = by_id(model.score(make([(1, "idiot"), (2, "moron idiot x")]), "doc_id"), "score")
    assert len(model.terms) == 2
    one = model.machine.intercept + linear
    pair = model.machine.intercept + linear.sum() / np.sqrt(2) + factors[0] @ factors[1] / 2
    assert min(abs(1 / (1 + np.exp(-one)) - got[1])) < 1e-9 and abs(1 / (1 + np.exp(-pair)) - got[2]) < 1e-9


@pytest.mark.parametrize("marks", [[], [(1, 1), (4, 0)], [(5, 1), (5, 0), (6, None), (None, 1), (7, 3)]])
def test_odd_rows(spark, make, marks):
    got = split_score(make(ODD), labels(spark, marks)).collect()
    assert len(got) == len(ODD) and sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in ODD)
    assert len({r["score"] for r in got}) == 1 and not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert split_score(make([]), labels(spark, marks)).collect() == []
