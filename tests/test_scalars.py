"""Golden values of the scalar rules."""

import pytest
from pyspark.sql import functions as F

from tablesmith.functions import dates, numbers, similarity, text

NBSP, EM, FI, WIDE_A = chr(0xA0), chr(0x2003), chr(0xFB01), chr(0xFF21)


def check(apply, rule, cases, dtype="string"):
    assert dict(zip(cases, apply(rule, list(cases), dtype))) == cases


def test_numbers(apply):
    check(
        apply,
        numbers.parse_numeric,
        {
            "1,234.50": 1234.5, "(1,234)": -1234.0, "$-5": -5.0, "-5": -5.0, "0": 0.0, "12%": 12.0, "5)": 5.0, "(5": 5.0,
            " 7 ": 7.0, "$ 5": 5.0, "5.": 5.0, "1,2,3": 123.0, "-$5": None, "($5)": None, "$(5)": None, "(5)%": None,
            ".5": None, "1e5": None, ",": None, "-": None, "nan": None, "": None, "abc": None, "-(5)": None, "007": 7.0,
        },
    )


def test_explicit_zero_is_not_null(apply):
    assert apply(numbers.parse_numeric, ["0", None]) == [0.0, None]
    assert list(map(str, apply(numbers.parse_numeric, ["-0", "(0)", "0"]))) == ["0.0"] * 3


def test_dates(apply):
    check(
        apply,
        dates.normalize_date,
        {
            "2024-7-3": "2024-07-03", "03/04/2024": "2024-03-04", "13/05/2024": "2024-05-13", "3.7.2024": "2024-07-03",
            "January/2020": "2020-01-01", "FEB 2025": "2025-02-01", "c2025 Feb": "2025-02-01", "C2025 march": "2025-03-01",
            "01.2020": "2020-01-01", "13.2020": "2020-13-01", "P3": "P03", "p12": "P12", "2024-02-31": "2024-02-31",
            "7": "7", "2024": "2024", "Jan/2020": "Jan/2020", "c2025 Sept": "c2025 Sept", "soon": "soon",
            "2024-07-03 10:15:00": "2024-07-03", "2024-07-03T10:15:00Z": "2024-07-03", "2024/07/03": "2024-07-03",
            "20240703": "2024-07-03", "3 July 2024": "2024-07-03", "July 3, 2024": "2024-07-03", "3-Jul-2024": "2024-07-03",
            "7/3/2024 10:15": "2024-07-03", "7/3/2024 10:15 PM": "2024-07-03", "07-03-2024": "2024-07-03", "3/Jul/2024": "2024-07-03",
            "July 3rd 2024": "2024-07-03", "Wed, 3 Jul 2024": "2024-07-03", "Wednesday 21st June 2023 08:00": "2023-06-21",
            "31-12-2023": "2023-12-31", "Monday": "Monday", "Sat 2024": "Sat 2024", "31-31-2024": "31-31-2024",
            "2024-07-03 25:00": "2024-07-03 25:00", "0000-01-01": "0000-01-01", "30/02/2024": "30/02/2024",
        },
    )
    assert apply(dates.normalize_date, [None]) == [None]


def test_periods(apply):
    cases = {
        "c2031 Oct": "2031-10", "09.2019": "2019-09", "August/2022": "2022-08", "2023-5": "2023-05", "2024/11": "2024-11",
        "c2025 September": "2025-09", "13.2020": "2020-13", "c2025 Sept": "c2025 Sept", "Feb/2024": "2024-02",
        "march-2024": "2024-03", " 01.2020 ": "2020-01", "Brand": "Brand", "Item 2024": "Item 2024",
    }
    check(apply, dates.normalize_period, cases)
    assert {k: dates.header_period(k) for k in cases} == cases


def test_period_headers(apply):
    cases = {
        "c2025 Feb": True, "c2025 Foo": True, "01.2020": True, "1.2020": False, "June 2020": True, "June/2020": True,
        "2024-7": True, "2024/12": True, "Jan 2020": True, "P01": False, "Brand": False, "2024-123": False,
    }
    check(apply, dates.is_period_column, cases)
    assert {k: dates.header_is_period(k) for k in cases} == cases
    assert apply(lambda c: dates.is_period_column(c, abbreviated=False), ["Jan 2020", "June 2020"]) == [False, True]
    assert apply(dates.is_period_header, ["P01", "P1", "P123", "feb_2024", "c2025 F"]) == [True, True, False, True, False]


def test_long_period(spark):
    rows = [("2024.0", "P07"), ("2024", "p7"), ("2024", "13"), ("2024", "00"), (None, "P01"), ("2024", "x"), ("abc", "P01"),
            ("2024", "2024-07"), ("2024", "month 12!"), ("2024", "123"), ("95", "P1")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, y string, p string").orderBy("i")
    got = [r[0] for r in df.select(dates.long_period(F.col("y"), F.col("p"))).collect()]
    assert got == ["2024-07", "2024-07", None, None, None, None, None, None, "2024-12", "2024-12", "0095-01"]


def test_clean_value(apply):
    check(
        apply,
        text.clean_value,
        {
            f"a{NBSP}{EM} b": "a b", f"{FI}n": "fin", f"{WIDE_A}": "A", "a\x00b\x1fc": "abc", "   ": None, "": None, "x": "x",
            " a ": "a", "a\t\n b": "a b", "a \x07 b": "a b", f"{NBSP}": None, "\x01": None, "á": "á", "a  b": "a b",
        },
    )


@pytest.mark.parametrize("rule", [text.clean_value, text.normalize_text, dates.normalize_date, dates.normalize_period])
def test_rules_are_idempotent(apply, rule):
    values = [f" A{NBSP}B ", "O'NEIL-FOODS", "2024-7-3", "P3", "FEB 2025", "c2025 Feb", "x\x00", "01.2020", "13/05/2024"]
    once = apply(rule, values)
    assert apply(rule, once) == once


def test_text_case(apply):
    check(
        apply,
        text.normalize_text,
        {
            "O'NEIL-FOODS": "O'Neil-Foods", "USA": "USA", "SKU12": "Sku12", "Mixed CASE": "Mixed CASE", "1234": "1234",
            "ACME  FOODS 2X": "Acme  Foods 2X", "ÉCOLE": "École", "(ABC) DEF": "(Abc) Def", "": "",
        },
    )
    assert apply(lambda c: text.normalize_text(c, keep_codes=True), ["SKU12 BRAND"]) == ["SKU12 Brand"]


def test_phone_and_email(apply):
    assert apply(text.normalize_phone, ["\t0049 (30) 90 18-20", "   ", None, "ext."]) == ["004930901820", None, None, ""]
    assert apply(text.normalize_email, ["Sales.Team@Shop.Test  ", None]) == ["sales.team@shop.test", None]
    assert apply(text.email_valid, ["a@b.co", "a@b", "a b@c.d"]) == [True, False, False]


def test_is_numeric(apply):
    cases = {
        "1,234": True, "$5": True, "1e5": True, ".5": True, "5.": True, "nan": True, "-inf": True, "1_000": True, "": False,
        "1d": False, "abc": False, "0x10": False, " 3 ": True, "--1": False, "P1": False,
    }
    check(apply, numbers.is_numeric, cases)
    assert apply(numbers.is_numeric, [None]) == [False]
    assert apply(numbers.float_value, ["2,024", "1_000", "x"]) == [2024.0, 1000.0, None]


def test_headers(apply):
    assert apply(similarity.normalize_header, ["Trade  Channel!", "región", "ññ"]) == ["trade channel", "regi n", ""]


def test_similarity_is_ratcliff_obershelp(spark):
    from difflib import SequenceMatcher

    pairs = [("brand", "marca"), ("trade channel", "channel"), ("", "x"), ("abcd", "bcde"), ("brand", "marca")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", similarity.similarity(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(r["r"] == SequenceMatcher(None, r["a"], r["b"]).ratio() for r in got)


def test_typed_dates(spark):
    df = spark.sql("select date'2024-07-03' as d, timestamp'2024-07-03 10:00:00' as t")
    assert list(df.select(dates.date_text(F.col("d")), dates.date_text(F.col("t"))).first()) == ["2024-07-03"] * 2


def test_trace_keeps_unmapped_targets(spark):
    assert spark.range(1).select(text.trace_json({"Country": "pais", "SKU": None})).first()[0] == '{"Country":"pais","SKU":null}'
