"""Rows that share or lack a doc_id are still told apart."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tablesmith.llm import lines, repeats
from tablesmith.llm.base import with_rows
from tablesmith.llm.secrets import secrets
from tests.llm import brute


def text(seed, words=120):
    dice = random.Random(seed)
    return " ".join("".join(dice.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(words))


def test_numbers_name_rows(spark, make):
    given = [(1, "a"), (5, "b"), (5, "c"), (5, "c"), (None, "d"), (None, "d"), (9, None)]
    got = with_rows(make(given).select("doc_id", "text")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(given)
    assert len({r["row"] for r in got}) == 7 and all(r["row"] == r["doc_id"] for r in got if r["doc_id"] in (1, 9))
    assert all(r["row"] > 9 for r in got if r["doc_id"] not in (1, 9))
    top = 2**63 - 1
    got = with_rows(make([(top, "a"), (None, "b"), (None, "c")]).select("doc_id", "text")).collect()
    assert sorted(r["row"] for r in got)[-1] == top and len({r["row"] for r in got}) == 3


def test_long_repeats_stay_with_their_row(spark, make):
    single, shared, other = text(1), text(2), text(3)
    given = [(5, single), (5, shared), (6, other + " " + shared), (None, shared), (None, text(4)), (7, other[:300]), (8, text(5)), (8, text(5))]
    expected = brute.repeats([(i, t) for i, (_, t) in enumerate(given)], 400)
    got = repeats.without_repeats(make(given)).collect()
    plain = Counter((given[i][0], len((given[i][1]).encode()), kept) for i, (_, kept) in expected.items())
    assert Counter((r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in got) == plain
    assert (5, len(single), single.encode()) in plain and (8, len(text(5)), b"") in plain


def test_lines_stay_with_their_row(spark, make):
    one, two = "a line of some eight words stands here", "another line of eight other words is here"
    given = [(5, one), (5, two), (6, two), (None, one), (None, "a line without any copy in the table"), (7, one)]
    got = Counter((r["doc_id"], r["text"]) for r in lines.without_repeats(make(given)).collect())
    # Rows with an id of their own come first.
    assert got == Counter([(5, ""), (5, ""), (6, two), (None, ""), (None, given[4][1]), (7, one)])
    twice = lines.without_repeats(make([(3, one), (3, one)])).collect()
    assert sorted(r["text"] for r in twice) == ["", one]


def test_secrets_stay_with_their_row(spark, make):
    given = [(3, "password = abcdefghi"), (3, "nothing at all in this"), (None, "password = abcdefgh12"), (3, "password = abcdefghi"), (4, "login: someone"), (4, "pwd = abcdefgh1")]
    got = Counter((r["doc_id"], tuple((s["kind"], s["start"], s["end"]) for s in r["spans"])) for r in secrets(make(given)).collect())
    assert got == Counter([(3, (("assign", 0, 20),)), (3, ()), (None, (("assign", 0, 21),)), (3, (("assign", 0, 20),)), (4, ()), (4, ())])


def first_ones(rows, min_words=5):
    """What stays of ``rows (doc_id, text)`` if of equal units, by their words, only the first stays."""
    held, units = {}, []
    for i, t in sorted(rows):
        found = lines._units(t or "", min_words, lines.Checksums())
        for start, end in zip(*(x.tolist() for x in found[:2])) if found else ():
            words = tuple((t[start:end]).lower().split())
            units.append((words, i, start, end))
            held[words] = min(held.get(words, (i, start, end)), (i, start, end))
    spans = {}
    for words, i, start, end in units:
        first = held[words]
        if (i, start, end) > first and (i != first[0] or start >= first[2]):
            spans.setdefault(i, []).append((start, end))
    out = {}
    for i, t in rows:
        for start, end in reversed(brute.merged(spans.get(i, []))):
            t = t[:start] + t[end:]
        out[i] = t or ""
    return out


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_lines_against_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["text"] for r in lines.without_repeats(docs).collect()}
    assert got == first_ones(rows)


def test_units_are_those_of_the_text(spark):
    """Every line and sentence of five words or more is a unit, and phrases cover the whole text."""
    sample = "One line of just five.\nshort one\nA first sentence of six words. And then a second one here!  No.\n\n" + text(9, 200)
    found = lines._units(sample, 5, lines.Checksums())
    spans = set(zip(found[0].tolist(), found[1].tolist()))
    for part in ("One line of just five.", "A first sentence of six words.", "And then a second one here!"):
        assert (sample.index(part), sample.index(part) + len(part)) in spans
    assert brute.merged(spans)[0][0] == 0 and brute.merged(spans)[-1][1] == len(sample)


def test_lines_and_sentences_are_those_of_plain_patterns():
    """Lines, then the sentences of lines with a stop before a space, found without a loop over them."""
    for sample in ("", "\n", "a", "One. Two! \nno stop.\n\n? x. \n. ", ". . \n.\n", "A.B. C?! D", text(3, 300)):
        lined = [m.span() for m in re.finditer(r"[^\n]+", sample)]
        cut = [[m.start() + 1 for m in re.compile("[.!?] ").finditer(sample, *span)] for span in lined]
        sentences = [s for (a, b), stops in zip(lined, cut) if stops for s in zip([a, *(p + 1 for p in stops)], [*stops, b])]
        got = lines._lines_and_sentences(np.frombuffer(sample.encode("utf-32-le"), np.uint32))
        assert [tuple(x) for x in got.tolist()] == [*lined, *sentences]


def test_units_of_many_texts_are_those_of_each(monkeypatch):
    """Texts of a batch are hashed together, with the words known from batches before."""
    rng = random.Random(7)
    words = ["one", "Two.", "three!", "vier", "fünf?", "漢字", "ΣΑΣ", "x" * 30]
    texts = ["", "a b", "漢字かな交じり文。" * 3]
    texts += [" ".join(rng.choice(words) + rng.choice(["", "\n", "\n\n"]) for _ in range(rng.randrange(120))) for _ in range(60)]
    for least in (1, 5):
        found = list(zip(*lines._all_units(texts, least, lines.Checksums())))
        alone = [lines._units(t, least, lines.Checksums()) for t in texts]
        assert found == [(i, *u) for i, own in enumerate(alone) if own is not None for u in zip(*own)]
    monkeypatch.setattr(lines, "KNOWN_WORDS", 3)
    lines.Checksums.known().clear()
    lines._all_units(["one two three four five six"], 5, lines.Checksums.known())
    assert len(lines._KNOWN) == 6 and lines.Checksums.known() is lines._KNOWN and not lines._KNOWN
