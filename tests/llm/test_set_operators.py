"""Jaccard join, decontamination, repeated substrings, packing, token files, the pipeline."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from tablesmith.llm import jaccard, repeats, tokens
from tablesmith.llm.base import components
from tablesmith.llm.contamination import contained_items
from tablesmith.llm.packing import best_fit, pack
from tablesmith.llm.shingles import shingles
from tablesmith.llm.tokens import encoder, read_tokens, token_index, write_tokens
from tests.llm import brute
from tests.llm.conftest import ODD, by_id

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near_rows(seed, groups=6, copies=9):
    """Groups of copies with more and more words changed, single texts, short texts."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = prose(rng, rng.choice([3, 8, 20, 60, 200]))
        for c in range(copies):
            text = [f"x{rng.randrange(10**6)}" if rng.random() < 0.006 * c else w for w in base]
            rows.append((len(rows) * 7 % 1009, " ".join(text).upper() if c == 1 else " ".join(text)))
        rows.append((2000 + g, " ".join(prose(rng, 40))))
    return rows


@pytest.mark.parametrize("size, percent, block", [(4, 85, 256), (5, 80, 4)])
def test_near_groups(make, monkeypatch, size, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_rows(size)
    rows += [(3000, None), (3001, ""), (3002, "one two"), (3003, "One\ttwo"), (3004, "two one")]
    got = by_id(jaccard.similar_groups(make(rows), size, percent), "n_shingles", "component_id")
    assert got == brute.near(rows, size, percent)


def test_near_groups_of_odd_rows(make):
    got = jaccard.similar_groups(make(ODD), 4, 85).collect()
    assert len(got) == len(ODD) and {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1, 2, 3}
    assert jaccard.similar_groups(make([]), 4, 85).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.sampled_from([60, 80, 85, 95]), st.integers(0, 9))
def test_linked_sets_share_a_signature(n, gone, new, percent, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**64, n, np.uint64))
    b = np.unique(np.concatenate([a[min(gone, n - 1) :], rng.integers(0, 2**64, new, np.uint64)]))
    shared = len(np.intersect1d(a, b))
    if 100 * shared >= percent * (len(a) + len(b) - shared) and not np.array_equal(a, b):
        assert np.isin(jaccard.signatures(a, percent), jaccard.signatures(b, percent)).any()


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.sampled_from([60, 80, 85, 95]), st.integers(0, 9), st.booleans())
def test_linked_sets_pass_by_their_profiles(n, gone, new, percent, seed, crowded):
    """Also if many n-grams lie in one range, where counts end at 255."""
    rng = np.random.default_rng(seed)
    top = 2**56 if crowded else 2**64
    a = np.unique(rng.integers(0, top, n, np.uint64))
    b = np.unique(np.concatenate([a[min(gone, n - 1) :], rng.integers(0, top, new, np.uint64)]))
    shared = len(np.intersect1d(a, b))
    if 100 * shared >= percent * (len(a) + len(b) - shared):
        profiles, sizes = np.stack([jaccard.profile(a), jaccard.profile(b)]), np.array([len(a), len(b)])
        assert jaccard.may_link(profiles, sizes, None, percent).all()
        assert jaccard.may_link(profiles, sizes, np.array([0, 1]), percent).all()
        assert not jaccard.may_link(profiles, sizes, np.array([1, 1]), percent).any()


def test_profiles_tell_other_sets_apart():
    rng = np.random.default_rng(0)
    many = [np.unique(rng.integers(0, 2**64, n, np.uint64)) for n in (700, 700, 900, 40, 50)]
    many.append(np.unique(np.concatenate([many[0][30:], rng.integers(0, 2**64, 30, np.uint64)])))
    profiles, sizes = np.stack([jaccard.profile(s) for s in many]), np.array([len(s) for s in many])
    assert np.flatnonzero(jaccard.may_link(profiles, sizes, None, 80)).tolist() == [0, 5]


def test_repeated_places():
    rng = np.random.default_rng(0)
    many = [rng.integers(0, 2**64, 3_000, np.uint64) for _ in range(4)]
    many[1][:50], many[3][50:90], many[2][:5] = many[0][:50], many[1][50:90], many[2][5:10]
    batches = []
    for own in (many[:2], many[2:3], [], many[3:]):
        found = jaccard._places(own)
        batches += [(int(part), value) for part, value in zip(found["part"], found["places"])]
    parts, values = zip(*sorted(batches))
    table = pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.int32()), "places": pa.array(values, pa.binary())})
    got = [p for batch in jaccard._repeated(iter([table])) for p in batch["place"].to_pylist()]
    places, counts = np.unique(np.concatenate(many) >> np.uint64(20), return_counts=True)
    assert got == places[counts > 1].tolist() and len(got) == 95


def test_overlaps():
    rng = np.random.default_rng(0)
    many = [np.unique(rng.integers(0, 20_000, 3_000).astype(np.uint64)) for _ in range(5)]
    found = jaccard.overlaps(many)
    assert all(found[i, j] == len(np.intersect1d(many[i], many[j])) for i in range(5) for j in range(5) if i != j)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbB \t\n\x0béñ"), max_size=30), max_size=6), st.integers(1, 5))
def test_shingle_hashes(texts, size):
    """Two shingles have one hash exactly if their words agree."""
    hashes, offsets = shingles(texts, size)
    seen = {}
    for text, a, b in zip(texts, offsets, offsets[1:]):
        w = brute.words(text)
        expected = [tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
        assert b - a == len(expected)
        for h, s in zip(hashes[a:b].tolist(), expected):
            assert seen.setdefault(s, h) == h
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    rng = random.Random(0)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(7, 7)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint"), "t").collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: root(i) for i in linked}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "t").collect() == []


def test_contained_items(make, spark):
    rng = random.Random(4)
    items = [(i, " ".join(prose(rng, n, 10**6))) for i, n in enumerate([2, 4, 5, 6, 9, 13, 20, 33, 70, 150, 300])]
    items += [(50, None), (51, ""), (3, items[3][1])]
    rows = []
    for i, (_, text) in enumerate(items[:11]):
        w = text.split()
        for share in (1.0, 0.95, 0.8, 0.5):
            some = w[: max(1, int(len(w) * share))]
            rows.append((len(rows), " ".join([*prose(rng, 400), *some, *prose(rng, 700)])))
        rows.append((len(rows), text.upper()))
    rows += [(900, None), (901, " "), (902, " ".join(prose(rng, 60_000)) + " " + items[7][1])]
    known = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as doc_id")
    found = contained_items(make(rows), known).collect()
    got = sorted((r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in found)
    assert got == brute.containment(rows, items)
    assert contained_items(make([]), known).collect() == [] and contained_items(make(ODD), known).collect() == []
    assert contained_items(make(rows), known.limit(0)).collect() == []


def test_recall_of_signatures(make, spark):
    """Windows find nearly all of what comparing everything finds, also at the threshold."""
    rng = random.Random(6)
    items = [(i, " ".join(prose(rng, rng.randint(14, 64), 10**6))) for i in range(150)]
    rows = []
    for i, text in items:
        w = text.split()
        w[len(w) // 2] = "changed"
        rows.append((i, " ".join([*prose(rng, 300, 10**6), *w, *prose(rng, 300, 10**6)])))
    known = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contained_items(make(rows), known).collect()}
    expected = {(d, i) for d, i, _, _ in brute.containment(rows, items)}
    assert got <= expected and len(got) >= 0.99 * len(expected) and len(expected) > 100


def test_items_in_scattered_parts(make, spark):
    """Parts of an item all over a long document, equal items, null ids, documents that hold many items."""
    rng = random.Random(16)
    items = [(i, " ".join(prose(rng, rng.randint(40, 130), 10**6))) for i in range(40)]
    rows = []
    for i, text in items:
        w = text.split()
        cuts = [w[k : k + 34] for k in range(0, len(w), 30)]  # neighbours share four words, so no shingle is lost
        rng.shuffle(cuts)
        rows.append((i, " ".join(" ".join([*c, *prose(rng, 500, 10**6)]) for c in cuts)))
    rows += [(100, " x y z ".join(t for _, t in items[:25])), (None, items[0][1]), (None, items[1][1]), (3, "a b c d e f")]
    items += [(None, items[2][1]), (77, items[3][1].upper()), (77, "A b"), (78, "a b c d e"), (79, None)]
    known = spark.createDataFrame(items, "item_id bigint, text string")
    found = contained_items(make(rows), known).collect()
    named = lambda i: -1 if i is None else i
    got = sorted((named(r["doc_id"]), named(r["item_id"]), r["n_shared"], r["n_item"]) for r in found)
    assert got == brute.containment([(named(i), t) for i, t in rows], [(named(i), t) for i, t in items]) and len(got) > 65


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab"), min_size=1, max_size=40), min_size=1, max_size=8), st.integers(2, 9))
def test_run_length_index(texts, length):
    got = repeats.long_matches([t.encode() for t in texts], length)
    assert got == [s for s, _ in brute.repeats(list(enumerate(texts)), length).values()]


@pytest.mark.parametrize("group, piece", [(2_048, 1_000_000), (2, 300)])
def test_repeated_substrings(make, monkeypatch, group, piece):
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "PIECE", piece)
    rng = random.Random(8)
    rand = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passage, other = rand(260), rand(150)
    rows = [(i, rand(rng.randint(0, 90)) + passage[rng.randint(0, 60) :] + rand(rng.randint(0, 90))) for i in range(12)]
    rows += [(20, rand(300)), (21, other + other), (22, "a" * 700), (23, "ab" * 300), (24, passage[:99]), (25, passage)]
    rows += [(30, None), (31, ""), (32, rows[0][1])]
    got = by_id(repeats.without_repeats(make(rows), 100), "n_bytes", "removed", "kept")
    for i, (spans, kept) in brute.repeats(rows, 100).items():
        assert [(s["start"], s["end"]) for s in got[i][1]] == spans and bytes(got[i][2]) == kept
        assert got[i][0] == len((dict(rows)[i] or "").encode())
    assert repeats.without_repeats(make([]), 100).collect() == []
    assert repeats.without_repeats(make(ODD), 100).count() == len(ODD)


def best_fit_by_search(lengths, capacities, overhead):
    """The same rule with plain lists: the fullest open bin with room, else the cheapest new one."""
    bins, left, out = [], sum(lengths), []
    for n in lengths:
        fitting = [(room, -turn, b) for b, (room, turn) in enumerate(bins) if room >= n]
        if fitting:
            b = min(fitting)[2]
            room = bins[b][0]
        else:
            b, room = len(bins), min((c for c in capacities if c >= n), key=lambda c: ((c + overhead) / min(c, left), c))
            bins.append((room, 0))
        bins[b] = room - n, len(out) + 1
        out.append(b)
        left -= n
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_pack(lengths):
    capacities, overhead = (8, 16, 64), 2
    got = pack(lengths, capacities, overhead)
    held = {}
    for n, (b, offset, capacity) in zip(lengths, got):
        held.setdefault(b, []).append((offset, n, capacity))
    for spans in held.values():
        at = 0
        for offset, n, capacity in sorted(spans):
            assert offset == at
            at += n
        assert at <= capacity and all(at > c for c in capacities if c < capacity)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    ordered = [lengths[i] for i in order]
    costs = []
    for k in range(1, 4):
        if not ordered or ordered[0] <= capacities[k - 1]:
            sums = {}
            for b, n in zip(best_fit_by_search(ordered, capacities[:k], overhead), ordered):
                sums[b] = sums.get(b, 0) + n
            costs.append(sum(next(c for c in capacities if c >= n) + overhead for n in sums.values()))
    assert sum(spans[0][2] + overhead for spans in held.values()) == min(costs)


def test_best_fit(make):
    rows = [(i, "w " * n) for i, n in enumerate([0, 1, 50, 511, 4095, 4096, 9000, 700, 300, 200])] + [(20, None), (21, ""), (3, "a b")]
    found = best_fit(make(rows), group=4).collect()
    cover = {}
    for r in found:
        cover.setdefault(r["doc_id"], []).append((r["start"], r["start"] + r["length"]))
    for i, text in rows:
        if i != 3:
            spans = sorted(cover[i])
            assert spans[0][0] == 0 and spans[-1][1] == len((text or "").split()) + 1
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert sorted(cover[3]) == [(0, 3), (0, 512)]
    assert all(r["offset"] + r["length"] <= r["capacity"] for r in found)
    assert best_fit(make([])).collect() == [] and best_fit(make(ODD)).count() == len(ODD)


PIECES = ["a", "bc", " ", "  ", "\n", "\t", "é", "\u3000", "'s", "12", "<|endoftext|>", "!", ".", ",", "\x1c", "Ġ", "\u0301", "\r", "\x0b", "\x85", "\u2028"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), max_size=4))
def test_ids_word_by_word(texts):
    plain = Tokenizer.from_file(TOKENIZER)
    plain.encode_special_tokens = True
    own = encoder(TOKENIZER)
    for text, raw in zip(texts, own.encode(texts)):
        assert np.frombuffer(raw, own.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids + [0]


def test_ids_with_a_small_memory(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 5)
    rng, own = random.Random(1), tokens.Encoder(TOKENIZER)
    for _ in range(30):
        text = " ".join(prose(rng, 12, 30)) + rng.choice([".", " ", "\n"])
        ids = own.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode([text])[0], own.dtype).tolist() == [*ids, 0]


@pytest.mark.parametrize("n", [0, 3, 400])
def test_token_files(spark, make, tmp_path, n):
    rng, plain = random.Random(n), Tokenizer.from_file(TOKENIZER)
    rows = [(i * 3 % 401, " ".join(prose(rng, rng.randint(0, 50)))) for i in range(n)] + [(500, None), (501, ""), (502, "é" * 9000)][: n]
    write_tokens(make(rows), str(tmp_path / "t"), TOKENIZER)
    got = by_id(token_index(spark, str(tmp_path / "t"), TOKENIZER), "start", "n_tokens", "ids_crc32")
    start = 0
    for i, text in sorted(rows):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(rows)
    if n:
        one = read_tokens(spark, str(tmp_path / "t"), TOKENIZER, (500, 501)).collect()
        assert [(r["doc_id"], r["n_tokens"]) for r in sorted(one)] == [(500, 1), (501, 1)]


def test_odd_token_files(spark, make, tmp_path):
    write_tokens(make(ODD), str(tmp_path / "t"), TOKENIZER)
    assert token_index(spark, str(tmp_path / "t"), TOKENIZER).count() == len(ODD)


def test_pipeline(spark, make, tmp_path):
    rng = random.Random(11)
    passage = prose(rng, 30, 10**6)
    base = prose(rng, 120, 10**6)
    rows = [(i, " ".join(prose(rng, 60, 10**6)), "en") for i in range(1, 30)]
    rows += [(40, " ".join(base), "en"), (41, "  ".join(base), "en"), (42, " ".join([*base, "more"]), "en")]
    rows += [(50, " ".join([*prose(rng, 50, 10**6), *passage]), "en"), (60, None, "en"), (61, "12 34", "en")]
    docs = make(rows, extra=False).selectExpr("*", "'s' as source", "1L as n_chars", "1 as document", "2 as lang_pred")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items = spark.createDataFrame([(1, " ".join(passage))], "item_id bigint, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [{r["doc_id"] for r in rows_} for rows_ in _stages(spark, docs, str(tmp_path))]
    everything = {i for i, *_ in rows}
    assert kept[0] == everything - {60, 61} and kept[1] == kept[0] - {41} and kept[2] == kept[1] - {42}
    assert kept[3] == kept[2] - {50} and kept[4] == kept[3]
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lengths = {i: len(t.split()) + 1 for i, t, _ in rows if t}
    assert {r["doc_id"]: r["length"] for r in final} == {i: lengths[i] for i in kept[3]}


def _stages(spark, docs, folder):
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if i < 4:
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        yield docs.collect()


def test_pipeline_of_nothing(spark, make, tmp_path):
    docs = make([], extra=False)
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
