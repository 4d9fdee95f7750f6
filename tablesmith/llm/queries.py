"""The registered queries of this subpackage and their DuckDB twins."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from tablesmith.llm import conversations_sql, repeats
from tablesmith.llm.base import documents
from tablesmith.llm.contamination import contained_items
from tablesmith.llm.conversations import repair_damaged
from tablesmith.llm.exact import exact_groups
from tablesmith.llm.jaccard import similar_groups
from tablesmith.llm.language import split_identify
from tablesmith.llm.lines import without_repeats
from tablesmith.llm.packing import best_fit
from tablesmith.llm.pii import personal_data
from tablesmith.llm.secrets import secrets
from tablesmith.llm.spans import count, joined
from tablesmith.llm.tokens import token_index, write_tokens
from tablesmith.llm.toxicity import split_score
from tablesmith.llm.whitening import whiten
from tablesmith.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


NORMAL = "regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')"


@query(
    "op8_exact_dedup",
    f"""
    with n as (select doc_id, {NORMAL} as t from documents),
    g as (select t, min(doc_id) as keep_id, count(*) as group_size from n group by t)
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256
    from n join g using (t)
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


@query("op10_line_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters removed, their spans and what stays, per document."""
    out = without_repeats(documents(spark, sf_dir))
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select(
        "doc_id", F.size("removed").cast("long").alias("n_spans"), size.alias("n_removed"),
        spans.alias("spans"), F.sha2("text", 256).alias("kept_sha256"),
    )


@query("op2_personal_data")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    counts = [count(base, k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    order = ("rank", "start")
    return found.select(
        "doc_id", *counts, F.sha2(joined(base, *order), 256).alias("base_sha256"), joined(F.col("spans"), *order).alias("spans")
    )


@query("op9_secrets")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    counts = [count(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    order = ("start", "rank")
    return found.select(
        "doc_id", *counts, F.sha2(joined(base, *order), 256).alias("base_sha256"), joined(F.col("spans"), *order).alias("spans")
    )


@query("op3_language")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_identify(documents(spark, sf_dir))


WORDS = """
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')
"""


def shingle_sql(size: int) -> str:
    """A list of the distinct shingles of the words ``w``; a shorter text is one shingle."""
    return f"""
    case when len(w) = 0 then [] when len(w) < {size} then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(w[i:i + {size} - 1], ' '))) end
    """


@query(
    "op4_decontamination",
    f"""
    with d as (select doc_id, unnest({shingle_sql(5)}) as g from (select doc_id, {WORDS} as w from documents)),
    b as (select item_id, unnest(s) as g, len(s) as n from (
        select item_id, {shingle_sql(5)} as s from (select item_id, {WORDS} as w from benchmark)))
    select doc_id, item_id, count(*) as n_shared, any_value(n) as n_item, count(*) / any_value(n) as containment
    from d join b using (g) group by doc_id, item_id having 5 * count(*) >= 4 * any_value(n)
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(documents(spark, sf_dir))


@query("op6_token_files")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer, path = public_tokenizers.path("byte_bpe_50k.json"), scratch_path(spark, "token-files")
    write_tokens(documents(spark, sf_dir), path, tokenizer)
    return token_index(spark, path, tokenizer)


@query(
    "op1_jaccard_join",
    f"""
    with recursive d as (select doc_id, {shingle_sql(4)} as s from (select doc_id, {WORDS} as w from documents)),
    n as (select doc_id, len(s) as n, case when len(s) = 0 then doc_id else min(doc_id) over (partition by list_sort(s)) end as copy_of from d),
    g as (select doc_id, unnest(s) as g from d),
    pairs as (select x.doc_id as a, y.doc_id as b, count(*) as o from g as x join g as y on x.g = y.g and x.doc_id <> y.doc_id group by all),
    links as (select a, b from pairs join n as p on p.doc_id = a join n as q on q.doc_id = b where 100 * o >= 85 * (p.n + q.n - o)),
    reach as (select doc_id, doc_id as r from n union select doc_id, b from reach join links on a = r)
    select doc_id, any_value(n) as n_shingles, any_value(copy_of) as copy_of, min(r) as component_id from n join reach using (doc_id) group by doc_id
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(documents(spark, sf_dir), size=4, percent=85)


@query("op7_repeated_substrings")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.without_repeats(documents(spark, sf_dir))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op11_conversation_repair", conversations_sql.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query("op12_toxicity")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
