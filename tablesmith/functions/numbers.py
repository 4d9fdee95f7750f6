"""Numbers written as business text."""

from pyspark.sql import Column, functions as F

from tablesmith.functions.text import strip

# Fixed value: the shape of text that is read as a number.
NUMERIC_TEXT = r"^\s*[$€£]?\s*-?\(?[\d,]+\.?\d*\)?\s*%?\s*$"

# Texts that denote a float once thousands separators and dollar signs are gone.
_FLOAT_TEXT = (
    r"^(?i)[+-]?(\d(_?\d)*(\.(\d(_?\d)*)?)?(e[+-]?\d(_?\d)*)?"
    r"|\.\d(_?\d)*(e[+-]?\d(_?\d)*)?|nan|inf|infinity)$"
)


def parse_numeric(c: Column) -> Column:
    """The DOUBLE value of ``c``, or null where it is not a number.

    The sign is kept, parentheses around the whole text mean a negative number, and a
    percent sign is dropped without scaling.
    """
    s = strip(c)
    digits = F.translate(F.btrim(s, F.lit("()")), "$€£,%", "")
    number = F.btrim(digits)
    # Adding to zero and taking from zero both turn a negative zero into plain zero.
    zero = F.lit(0.0)
    value = F.when(number.rlike(r"^-?\d+\.?\d*$"), number.try_cast("double"))
    negative = s.startswith("(") & s.endswith(")")
    return F.when(s.rlike(NUMERIC_TEXT), F.when(negative, zero - F.abs(value)).otherwise(zero + value))


def _plain(c: Column) -> Column:
    return strip(F.translate(c, ",$", ""))


def is_numeric(c: Column) -> Column:
    """Whether the text reads as a float; null counts as not numeric."""
    return F.coalesce(_plain(c).rlike(_FLOAT_TEXT), F.lit(False))


def float_value(c: Column) -> Column:
    """The value of a text that passed :func:`is_numeric`."""
    return F.when(is_numeric(c), F.replace(_plain(c), F.lit("_"), F.lit("")).try_cast("double"))
