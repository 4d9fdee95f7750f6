"""Dates and periods written as text, normalized to ``YYYY-MM-DD``, ``YYYY-MM`` or ``Pnn``."""

import re

from pyspark.sql import Column, functions as F

from tablesmith.functions.text import strip

# English month names in calendar order.
MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
FULL_MONTH = {name: f"{i:02d}" for i, name in enumerate(MONTHS, 1)}
SHORT_MONTH = {name[:3]: f"{i:02d}" for i, name in enumerate(MONTHS, 1)}
ANY_MONTH = FULL_MONTH | SHORT_MONTH

# The header shapes that name a period.
C_YEAR = r"^c(\d{4})\s+([A-Za-z]+)$"
MONTH_DOT_YEAR = r"^(\d{2})\.(\d{4})$"
NAME_YEAR = r"^([A-Za-z]+)[ /_-](\d{4})$"
YEAR_MONTH = r"^(\d{4})[-/](\d{1,2})$"

_NAMES = "|".join(MONTHS)
_ALL_NAMES = "|".join(list(FULL_MONTH) + [n for n in SHORT_MONTH if n not in FULL_MONTH])
STRICT_HEADER = rf"(?i)^c\d{{4}}\s+[A-Za-z]+$|^\d{{2}}\.\d{{4}}$|^({_NAMES})[ /-]\d{{4}}$|^\d{{4}}[-/]\d{{1,2}}$"
HEADER = rf"(?i)^c\d{{4}}\s+[A-Za-z]+$|^\d{{2}}\.\d{{4}}$|^({_ALL_NAMES})[ /_-]\d{{4}}$|^\d{{4}}[-/]\d{{1,2}}$"
WIDE_HEADER = (
    rf"(?i)^c\d{{4}}\s+[A-Za-z]{{3,}}$|^\d{{2}}\.\d{{4}}$|^({_ALL_NAMES})[ /_-]\d{{4}}$"
    rf"|^\d{{4}}[-/]\d{{1,2}}$|^P\d{{1,2}}$"
)


def _month(name: Column, months: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in months.items() for x in pair])
    return F.try_element_at(table, F.lower(name))


def _day_text(c: Column) -> Column:
    """ISO text of a ``y-m-d`` text, or null if there is no such day."""
    return c.try_cast("date").cast("string")


# Shapes with digits only. One replacement puts the parts of any of them in order, since a
# group that took no part in the match is empty.
_YEAR = r"((?!0000)\d{4})"
_DAY = r"( ?\d|\d\d)"
_TIME = r"(?:[T ](?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d+)?)?(?: ?[AaPp][Mm])?(?:Z|[+-]\d{2}:?\d{2})?)?"
_DIGITS = rf"^{_YEAR}[-/.](\d{{1,2}})[-/.]{_DAY}{_TIME}$|^{_DAY}\.(\d{{1,2}})\.{_YEAR}$|^{_YEAR}(\d\d)(\d\d)$"
_DIGITS_YMD = "$1$6$7-$2$5$8-$3$4$9"
_SLASHES = rf"^{_DAY}[/-]{_DAY}[/-]{_YEAR}{_TIME}$"
# Shapes with a month name; a day that is not given is the first.
_NAMED = (
    rf"(?i)^(?:{_NAMES})/{_YEAR}$|^[A-Za-z]+\s+{_YEAR}$|^c{_YEAR}\s+[A-Za-z]+$"
    rf"|^(\d{{1,2}})(?:st|nd|rd|th)?[ /-][A-Za-z]+[ /-]{_YEAR}{_TIME}$"
    rf"|^[A-Za-z]+ (\d{{1,2}})(?:st|nd|rd|th)?,? {_YEAR}{_TIME}$"
)
_WEEKDAY = r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? +"
_NAMED_YEAR = "$1$2$3$5$7"
_NAMED_DAY = "$4$6"
_WORD = "[A-Za-z]{3,}"
_P_PERIOD = r"^[Pp](\d{1,2})$"


def normalize_date(c: Column) -> Column:
    """Text with a known date or period shape in ISO form; any other text unchanged.

    Month before day wins where both readings are possible. Besides the fixed formats, these
    complete days are read, each also with a time of day: year, month, day; day and month
    before a year of four digits with slashes or dashes; a day (also ``3rd``) and a month name
    in either order, also after a weekday. Nothing is completed from today's date.
    """
    s = F.regexp_replace(strip(c), _WEEKDAY, "")
    dash = F.lit("-")
    put = lambda pattern, order: F.regexp_replace(s, pattern, order)
    day = F.coalesce(F.nullif(put(_NAMED, _NAMED_DAY), F.lit("")), F.lit("1"))
    named = F.concat(put(_NAMED, _NAMED_YEAR), dash, _month(F.regexp_extract(s, _WORD, 0), ANY_MONTH), dash, day)
    spaced = lambda text: F.replace(text, F.lit(" "), F.lit(""))
    iso = (
        F.when(s.rlike(_DIGITS), _day_text(spaced(put(_DIGITS, _DIGITS_YMD))))
        .when(
            s.rlike(_SLASHES),
            F.coalesce(_day_text(spaced(put(_SLASHES, "$3-$1-$2"))), _day_text(spaced(put(_SLASHES, "$3-$2-$1")))),
        )
        .when(s.rlike(_NAMED), _day_text(named))
        .when(s.rlike(MONTH_DOT_YEAR), put(MONTH_DOT_YEAR, "$2-$1-01"))
        .when(s.rlike(_P_PERIOD), F.concat(F.lit("P"), F.lpad(F.substring(s, 2, 2), 2, "0")))
    )
    return F.coalesce(F.when(s.rlike("[0-9]"), iso), c)


def date_text(c: Column) -> Column:
    """ISO day of a typed date or timestamp."""
    return F.date_format(c, "yyyy-MM-dd")


def is_period_column(c: Column, abbreviated: bool = True) -> Column:
    """Whether a header names a period; ``abbreviated`` also admits short month names."""
    return strip(c).rlike(HEADER if abbreviated else STRICT_HEADER)


def is_period_header(c: Column) -> Column:
    """The wider test used when guessing a layout: also ``P1`` .. ``P99``."""
    return strip(c).rlike(WIDE_HEADER)


def normalize_period(c: Column) -> Column:
    """A period header as ``YYYY-MM``; the month number is not range-checked."""
    s = strip(c)
    digits = F.regexp_replace(s, f"{MONTH_DOT_YEAR}|{YEAR_MONTH}", "$2$3-$1$4")
    month = _month(F.regexp_extract(s, _WORD, 0), ANY_MONTH)
    return F.coalesce(
        F.when(s.rlike(f"{MONTH_DOT_YEAR}|{YEAR_MONTH}"), F.regexp_replace(digits, r"-(\d)$", "-0$1")),
        F.when(s.rlike(f"(?i){C_YEAR}|{NAME_YEAR}"), F.concat(F.regexp_extract(s, r"\d{4}", 0), F.lit("-"), month)),
        s,
    )


# The first one or two digits, if they are a month.
_MONTH_NUMBER = r"^\D*(0[1-9]|1[0-2]|[1-9](?!\d))"


def long_period(year: Column, period: Column) -> Column:
    """``YYYY-MM`` from a year column and a period column, or null if either is unusable."""
    y = year.try_cast("double").try_cast("int")
    m = F.regexp_extract(period.cast("string"), _MONTH_NUMBER, 1)
    year_text = F.when(y.between(0, 9999), F.lpad(y.cast("string"), 4, "0")).otherwise(F.format_string("%04d", y))
    return F.when((m != "") & y.isNotNull(), F.concat(year_text, F.lit("-"), F.lpad(m, 2, "0")))


def header_is_period(name: str) -> bool:
    """Driver-side twin of :func:`is_period_column`, for the headers of one table."""
    return re.match(HEADER, name.strip()) is not None


def header_period(name: str) -> str:
    """Driver-side twin of :func:`normalize_period`, for the headers of one table."""
    s = name.strip()
    if m := re.match(C_YEAR, s, re.IGNORECASE):
        year, month = m[1], ANY_MONTH.get(m[2].lower())
    elif m := re.match(MONTH_DOT_YEAR, s):
        year, month = m[2], m[1]
    elif m := re.match(NAME_YEAR, s):
        year, month = m[2], ANY_MONTH.get(m[1].lower())
    elif m := re.match(YEAR_MONTH, s):
        year, month = m[1], m[2].zfill(2)
    else:
        return s
    return f"{year}-{month}" if month else s
