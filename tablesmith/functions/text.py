"""Text rules: Unicode, control characters, white space, phone, e-mail, casing."""

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from tablesmith.schema import quoted

# Code points of the characters that count as white space.
_SPACES = [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
WHITESPACE = "".join(map(chr, _SPACES))
# The characters that are deleted (tab, line feed and carriage return stay).
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"

_UNICODE_SPACE = r"\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# A cheap range that holds all of them: few texts have such a character at all.
_MAYBE_UNICODE_SPACE = r"\x85\xA0\x{1680}-\x{3000}"
# Text of which cleaning leaves something.
_VISIBLE = rf"[^\x00-\x20{_UNICODE_SPACE}]"


def non_ascii(c: Column) -> Column:
    return F.octet_length(c) != F.length(c)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def nfkc_udf():
    """NFKC has no built-in function; all columns of a query share one Arrow hop."""

    @F.pandas_udf(T.StringType())
    def normalize(s: pd.Series) -> pd.Series:
        return s.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")

    return normalize


def nfkc(c: Column) -> Column:
    """Only values that hold a non-ASCII character travel to Python."""
    return F.coalesce(nfkc_udf()(F.when(non_ascii(c), c)), c)


def nfkc_cells(cells: Column) -> Column:
    """NFKC of an array of texts in one Arrow hop; only arrays with a non-ASCII character travel to Python.

    They travel as JSON, since Spark measures a batch of arrays anew for each row it adds.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def normalize(s: pd.Series) -> pd.Series:
        plain = lambda v: v if v is None else unicodedata.normalize("NFKC", v)
        return s.map(lambda row: [plain(v) for v in json.loads(row)], na_action="ignore")

    return F.coalesce(normalize(F.when(non_ascii(F.concat_ws("", cells)), F.to_json(cells))), cells)


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, CONTROLS, "")


def _ascii_spaces(c: Column) -> Column:
    has_unicode = non_ascii(c) & c.rlike(f"[{_MAYBE_UNICODE_SPACE}]")
    return F.when(has_unicode, F.regexp_replace(c, f"[{_UNICODE_SPACE}]", " ")).otherwise(c)


def _collapse_ascii(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"[\s\x1C-\x1F]+", " "))


def collapse_whitespace(c: Column) -> Column:
    """Every run of white space as one blank, none at the ends."""
    return _collapse_ascii(_ascii_spaces(c))


def _dirt(c: Column) -> Column:
    return c.contains("  ") | c.rlike(r"[\x00-\x1F]") | (non_ascii(c) & c.rlike(f"[{_MAYBE_UNICODE_SPACE}]"))


def clean_value(c: Column, unicode: bool = True) -> Column:
    """NFKC, delete control characters, collapse white space, empty text to null.

    Most cells are clean already; cheap tests find them, and they are passed on as they are.
    No costly step stands where its argument is named twice, since that would repeat it.
    """
    c = nfkc(c) if unicode else c
    untidy = c.startswith(" ") | c.endswith(" ") | _dirt(c)
    tidied = _collapse_ascii(strip_controls(_ascii_spaces(c)))
    return F.when(untidy, F.when(c.rlike(_VISIBLE), tidied)).when(c != "", c)


def joined_cells(cells: Column) -> Column:
    """The texts of an array between bars, for :func:`untidy_cells`."""
    return F.concat(F.lit("|"), F.concat_ws("|", cells), F.lit("|"))


def untidy_cells(joined: Column) -> Column:
    """False only if :func:`clean_value` leaves every non-empty text of the array as it is; bars in texts may make it true."""
    return joined.contains("| ") | joined.contains(" |") | _dirt(joined)


def normalize_phone(c: Column) -> Column:
    return F.regexp_replace(F.nullif(strip(c), F.lit("")), "[^0-9+]", "")


def normalize_email(c: Column) -> Column:
    return F.lower(strip(c))


def email_valid(c: Column) -> Column:
    return normalize_email(c).rlike(EMAIL)


_MARK = "\x00 "


def _title(c: Column) -> Column:
    """``initcap`` starts a word after a blank only, so a marked blank is put before every
    other start of a run of letters and taken out again."""
    marked = F.regexp_replace(c, r"(?<=[^\p{L} ])(?=\p{L})", _MARK)
    return F.replace(F.initcap(marked), F.lit(_MARK), F.lit(""))


def normalize_text(c: Column, keep_codes: bool = False) -> Column:
    """Title-case text that is all capitals and longer than three characters.

    A word is a run of letters, so the parts around an apostrophe, a hyphen or a digit are
    cased on their own. ``keep_codes`` leaves tokens with digits in them alone.
    """
    shouting = (c == F.upper(c)) & (c != F.lower(c)) & (F.length(c) > 3)
    if not keep_codes:
        return F.when(shouting, _title(c)).otherwise(c)
    tokens = F.regexp_extract_all(c, F.lit(r"(\S+|\s+)"), 1)
    cased = F.transform(tokens, lambda t: F.when(t.rlike(r"\d"), t).otherwise(_title(t)))
    return F.when(shouting, F.array_join(cased, "")).otherwise(c)


def row_text(columns: list[str]) -> Column:
    """All non-null cells of a row, joined by a space."""
    return F.concat_ws(" ", *[F.col(quoted(n)).cast("string") for n in columns])


def first_filled(a: Column, b: Column) -> Column:
    """The first value, unless it is null or empty; then the second."""
    return F.coalesce(F.nullif(a, F.lit("")), b)


def trace_json(trace: dict[str, str | None]) -> Column:
    """The target -> source column map as constant JSON, unmapped targets included."""
    entries = [F.lit(source).cast("string").alias(target) for target, source in trace.items()]
    return F.to_json(F.struct(*entries), {"ignoreNullFields": "false"})
