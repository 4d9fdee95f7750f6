"""Where intermediate tables go."""

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

# Settings that suit these jobs. Generated methods above 8000 bytes are never compiled by
# the JVM; rules over many columns are faster as smaller functions.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    The library never makes one itself: a machine-local folder would be lost together with
    its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/tablesmith/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage and fixes row positions for good.

    The path is added to ``paths``, so that :func:`release` can remove it later.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_counted(
    df: DataFrame, name: str, paths: list[str] | None = None, **counts: Column
) -> tuple[DataFrame, dict[str, int]]:
    """:func:`materialize`, and the named aggregates of ``df`` as the write itself has seen them.

    Only tasks whose output is kept count, so a task that runs again changes nothing.
    """
    seen = Observation()
    stored = materialize(df.observe(seen, *[c.alias(n) for n, c in counts.items()]), name, paths)
    found = seen.get
    # A write that Spark knows to be empty beforehand reports nothing.
    return stored, {n: found.get(n) or 0 for n in counts}


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored intermediate tables; frames that read them can no longer be used."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    paths.clear()


def compute_once(df: DataFrame, columns: list[Column]) -> DataFrame:
    """A projection that later filters stay above of.

    A filter on a computed column is otherwise pushed below the projection, where it repeats
    the column's whole expression: for chains of text rules, many times over.
    """
    return df.select(F.inline(F.array(F.struct(*columns))))


def apart(c: Column) -> Column:
    """``c`` as it is, by way of a function over an array, which keeps its projection out of the stage's one generated method.

    For projections of very many columns: they would make that method too long for the JVM to
    compile, while a projection of its own is generated as many short ones.
    """
    return F.transform(F.array(c), lambda v: v)[0]
