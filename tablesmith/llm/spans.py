"""Spans of a scan as text and as counts."""

from pyspark.sql import Column, functions as F


def joined(spans: Column, *order: str) -> Column:
    """``kind:start:end`` of all spans, sorted by the named fields, joined by commas.

    ``rank`` is the place of a kind in its list; ``spans`` holds ``rank, kind, start, end``.
    """
    rest = [n for n in ("rank", "start", "end", "kind") if n not in order]
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(*[s[n].alias(n) for n in (*order, *rest)])))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
