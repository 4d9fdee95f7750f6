import pytest


@pytest.fixture(scope="session")
def make(spark):
    """A documents table; further columns carry names that the operators use themselves."""

    def build(rows, extra=True):
        schema = "doc_id bigint, text string, lang string"
        full = [(i, t, lang[0] if lang else None) for i, t, *lang in rows]
        if not extra:
            return spark.createDataFrame(full, schema)
        more = "n int, component string, span string, start int, digest int, node int, shard int, anchor int, c int"
        return spark.createDataFrame([(*r, *[None] * 9) for r in full], f"{schema}, {more}")

    return build


# Null, empty, blank and very short texts, repeated rows, signs beyond the basic plane.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "a"), (5, "a"), (6, "\U0001f600 ñandú\x0b\x0cé"), (None, "a b c")]


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}
