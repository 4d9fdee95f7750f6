"""Collects queries and their SQL twins by name."""

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.fixtures import with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_folder(spark: SparkSession) -> SparkSession:
    """Names a folder for intermediate tables, for a local session that has none."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.startswith("local"):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tablesmith-"))
    return spark


def query(name: str, sql: str | None = None):
    """Register a query under its operator id; ``sql`` may name the fixture views."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = with_fixtures(sql)
        return build

    return add
