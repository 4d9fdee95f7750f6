"""Header names: normalization, and similarity to the names of the target columns."""

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


# Everything but these is a blank in a normalized header.
NOT_PLAIN = "[^a-z0-9]+"


def normalize_header(c: Column) -> Column:
    """Lower case, with every run of other characters than ``a-z0-9`` as one space."""
    return F.btrim(F.regexp_replace(F.lower(c), NOT_PLAIN, " "))


def similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two texts; each distinct pair of a batch is scored once."""

    @F.pandas_udf(T.DoubleType())
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        pairs = pd.MultiIndex.from_arrays([left, right])
        codes, distinct = pairs.factorize()
        scores = np.array([SequenceMatcher(None, x, y).ratio() for x, y in distinct])
        return pd.Series(scores[codes])

    return F.when(a.isNotNull() & b.isNotNull(), ratio(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))


def best_similarity(name: Column, bank: dict[str, list[str]]) -> Column:
    """For a normalized name, the best score against each entry of a synonym bank.

    The result is an array in the order of ``bank``. A name that contains a synonym, or is
    contained in one, scores at least 0.82; an empty name scores 0. Names repeat a lot, so
    each distinct name of a batch is scored once; no pair is ever formed by a join.
    """
    words = list(bank.values())

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(names: pd.Series) -> pd.Series:
        def best(name, synonyms):
            scores = [max(SequenceMatcher(None, name, w).ratio(), 0.82 * (w in name or name in w)) for w in synonyms]
            return max(scores, default=0.0)

        codes, distinct = names.factorize()
        table = [[best(n, w) if n else 0.0 for w in words] for n in distinct]
        return pd.Series([table[i] for i in codes])

    return score(F.coalesce(name, F.lit("")))
