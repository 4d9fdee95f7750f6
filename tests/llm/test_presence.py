"""Bloom filters built by Spark and read in numpy."""

import numpy as np
import pytest

from tablesmith.llm import presence


@pytest.mark.parametrize("most", [2**27, 2**15])
def test_no_hash_is_denied(spark, monkeypatch, most):
    monkeypatch.setattr(presence, "MOST_BITS", most)
    rng = np.random.default_rng(1)
    own, other = (rng.integers(0, 2**64, n, np.uint64) for n in (3_000, 50_000))
    table = presence.bit_table(spark.createDataFrame([(int(h),) for h in own.view(np.int64)], "h bigint"), "h")
    assert len(presence.maybe(own, table)) == len(own)
    assert most < 2**27 or len(presence.maybe(other, table)) < 50
    empty = presence.bit_table(spark.createDataFrame([], "h bigint"), "h")
    assert len(presence.maybe(own, empty)) == 0
