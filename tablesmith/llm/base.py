"""What the operators share: text columns, sized joins, connected components."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablesmith.session import materialize

# ASCII white space in the sense of all contracts here: space and \t \n \v \f \r.
BLANKS = "[\\x20\\x09-\\x0D]+"
# A side of a join is broadcast up to this many values of fixed size; beyond it, joins shuffle.
BROADCAST_VALUES = 3_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` with null as empty, and the named further columns."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def with_rows(df: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """``df`` with a number ``row`` of its own for every row: the ``doc_id`` where only one row has it.

    Rows without a ``doc_id``, or with one that others have too, get numbers above all ids (below
    all, if there is no room above). Only such rows are stored, so that a number stays with its
    row wherever it is read; without any, finding that out is one count of the ids.
    """
    counts = df.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1")
    odd = materialize(counts.select("doc_id"), "odd-ids", paths)
    if odd.isEmpty():
        return df.withColumn("row", F.col("doc_id"))
    low, top = df.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, top = (-1, -1) if top is None else (low, top)
    # Numbers of rows in tasks stay below 2**60.
    above = top < 2**63 - 2**60
    if not above and low < -(2**63) + 2**60:
        raise ValueError("the ids leave no room for numbers of rows without an id of their own")
    number = F.monotonically_increasing_id()
    number = F.lit(top + 1).cast("bigint") + number if above else F.lit(low - 1).cast("bigint") - number
    shared = df.join(odd, df["doc_id"].eqNullSafe(odd["doc_id"]), "left_semi")
    shared = materialize(shared.withColumn("row", number), "odd-rows", paths)
    single = df.where("doc_id is not null").join(odd, "doc_id", "left_anti")
    return single.select(*df.columns, F.col("doc_id").alias("row")).unionByName(shared)


def few(df: DataFrame, *lists: str, limit: int = BROADCAST_VALUES) -> DataFrame:
    """``df`` with a broadcast hint if counting proves it small; ``df`` should be stored.

    Counted are its numbers and digests, in the named list columns one by one with their
    fields; other columns must be of fixed size.
    """
    width = len(df.columns) - len(lists)
    values = [F.size(n) * len(df.schema[n].dataType.elementType.fields) for n in lists]
    total = df.agg(F.coalesce(F.sum(sum(values, F.lit(width)).cast("bigint")), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= limit else df


def components(links: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """``node, component`` of the undirected ``links (a, b)``: the least node reachable.

    Every round hangs each node below the least neighbour of its neighbours and stores the
    shortened links, so the number of rounds grows with the logarithm of the longest chain.
    Nodes without a link are not returned. Tables stored on the way are added to ``paths``.
    """
    both = lambda e: e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(
        links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name, paths
    )
    while True:
        # Large star: every greater neighbour and the node itself move to the least neighbour.
        least = both(edges).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both(edges).join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a != b").distinct(), name, paths)
        # Small star: the smaller neighbours and the node itself move to the least of them.
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(root.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        after = materialize(small, name, paths)
        roots = after.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b"))
        done = (
            roots.where("n > 1").isEmpty()
            and after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty()
        )
        if done:
            heads = after.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
            return heads.union(after.select(F.col("a").alias("node"), F.col("b").alias("component")))
        edges = after
