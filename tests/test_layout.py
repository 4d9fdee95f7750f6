"""Layout inference against a plain Python walk over the same catalog."""

import random
from difflib import SequenceMatcher

from tablesmith.operators.layout import (
    build_mapping,
    candidate_scores,
    confidence,
    dataset_mode,
    period_strategy,
    synonym_bank,
)
from tablesmith.schema import TARGET_COLUMNS

SCHEMA = "file string, sheet string, col_pos int, col_name string, sample array<string>"


def catalog(spark, files):
    rows = [(f, "data", i, name, sample) for f, columns in files.items() for i, (name, sample) in enumerate(columns)]
    return spark.createDataFrame(rows, SCHEMA)


def brute_force(columns, targets):
    bank = synonym_bank(None, targets)
    plain = lambda s: " ".join("".join(ch if ch.isascii() and ch.isalnum() else " " for ch in s.lower()).split())
    scored = []
    for t, target in enumerate(targets):
        for c, (name, _) in enumerate(columns):
            n = plain(name)
            best = max((max(SequenceMatcher(None, n, w).ratio(), 0.82 if w in n or n in w else 0) for w in bank[target]), default=0) if n else 0
            scored.append((-best, t, c, name))
    taken = {}
    for score, t, c, name in sorted(scored):
        if -score >= 0.55 and targets[t] not in taken and c not in [x for x, _ in taken.values()]:
            taken[targets[t]] = (c, name)
    return {t: taken[t][1] if t in taken else None for t in targets}


def test_mapping_is_the_greedy_one(spark):
    pick = random.Random(7)
    names = ["Pais", "Country", "Zona", "Region Name", "Canal", "Trade", "Ciudad", "State", "Categ", "Marca", "Brand Desc", "Sku Code",
             "Producto", "Units", "Sales", "Totl", "Xyz", "Market", "Channel Group", "Sub Category"]
    files = {f"f{i}": [(pick.choice(names) + pick.choice(["", " 2", "x"]), ["a"]) for _ in range(pick.randint(1, 40))] for i in range(25)}
    got = build_mapping(candidate_scores(catalog(spark, files))).collect()
    for f, columns in files.items():
        assert {r["target"]: r["col_name"] for r in got if r["file"] == f} == brute_force(columns, TARGET_COLUMNS), columns


def test_numeric_samples_hint_at_the_measure(spark):
    files = {"f": [("Zzz", ["1", "2", "3"]), ("Qqq", ["a", "2"]), ("", ["9"])]}
    got = build_mapping(candidate_scores(catalog(spark, files), ["Fact"]), ["Fact"]).first()
    assert (got["col_name"], got["score"]) == ("Zzz", 0.55)
    assert got["review"] == "Low-confidence mapping: 'Zzz' -> Fact (score 0.55); please confirm."


def test_empty_name_scores_zero(spark):
    got = candidate_scores(catalog(spark, {"f": [("???", ["a"])]}), ["Brand"]).first()
    assert got["score"] == 0.0


def test_period_strategy_and_mode(spark):
    files = {
        "long": [("Brand", ["x"]), ("Year Month", ["P01"]), ("Period", ["P02"])],
        "values": [("A", ["1,999", "2024"]), ("B", ["p7"])],
        "year only": [("Fiscal Year", ["2024"]), ("Brand", ["x"])],
        "month first": [("Month", ["1"]), ("Year", ["2024"])],
        "both last": [("Month", ["x"]), ("Monthly Year", ["x"])],
        "wide": [("Jan 2024", ["x"]), ("02.2024", ["x"]), ("Brand", ["x"])],
        "not a year": [("A", ["1999", "12345"]), ("B", ["P1"])],
    }
    got = {r["file"]: r for r in dataset_mode(period_strategy(catalog(spark, files))).collect()}
    pair = lambda f: (got[f]["year_column"], got[f]["period_column"], got[f]["dataset_mode"])
    assert pair("long") == ("Year Month", "Period", "long_period")
    assert pair("values") == ("A", "B", "long_period")
    assert pair("year only") == (None, None, "normal")
    assert pair("month first") == ("Year", "Month", "long_period")
    assert pair("both last") == ("Monthly Year", "Month", "long_period")
    assert pair("wide") == (None, None, "wide_period")
    assert pair("not a year") == (None, None, "normal")


def test_confidence(spark):
    df = catalog(spark, {"f": [("Country", ["x"]), ("Brand", ["x"])]})
    mapping = build_mapping(candidate_scores(df, ["Country", "Brand", "SKU", "Fact"]), ["Country", "Brand", "SKU", "Fact"])
    matrix = spark.createDataFrame([("f", "data", True)], "file string, sheet string, looks_matrix boolean")
    normal = confidence(mapping, dataset_mode(period_strategy(df))).first()
    assert (normal["mapped_targets"], normal["required_targets"], normal["confidence"]) == (2, 4, 0.63)
    assert confidence(mapping, dataset_mode(period_strategy(df), matrix)).first()["confidence"] == 0.6
