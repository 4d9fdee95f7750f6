"""Layout inference over a column catalog.

A catalog has one row per column of any number of files: ``(file, sheet, col_pos,
col_name, sample)``, where ``sample`` is an array of the column's first values as text.
"""

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablesmith.functions.dates import is_period_header
from tablesmith.functions.numbers import float_value, is_numeric
from tablesmith.functions.similarity import NOT_PLAIN, best_similarity, normalize_header
from tablesmith.functions.text import strip
from tablesmith.operators.reshape import selected_targets
from tablesmith.schema import TARGET_COLUMNS

TABLE = ["file", "sheet"]

# Header words that name each target.
SYNONYMS = {
    "Country": ["country", "pais", "país", "nation", "market"],
    "Region": [
        "region", "región", "zone", "zona", "division", "división", "subdivision",
        "subdivisión", "area", "área", "branch", "state region",
    ],
    "Channel": [
        "channel", "canal", "trade channel", "channel group", "channel macro group",
        "customer grp", "sub channel", "trade name", "tradename", "customer",
    ],
    "City/State": [
        "city", "state", "ciudad", "estado", "city/state", "rsm", "sub trade channel",
        "location", "province",
    ],
    "Category": [
        "category", "categoria", "categoría", "global category", "category group",
        "sub category", "beverage sub category", "segmento", "segment", "mg1_desc", "smalc",
    ],
    "Brand": ["brand", "marca", "brand_desc", "bottler", "marca_desc"],
    "SKU": [
        "sku", "product", "producto", "product_desc", "product_code", "barcode",
        "description", "format flavor description", "mother_pack", "formato", "container",
        "primary container",
    ],
    "Fact": [
        "fact", "measure", "metric", "quantity", "value", "sales", "volume", "total",
        "unit", "eaches", "tons",
    ],
}

# Score limits, confidence terms, header words for years and periods.
MIN_SCORE = 0.55
SURE_SCORE = 0.7
NUMERIC_SHARE = 0.6
YEAR_WORDS = ["year", "año", "ano", "displayyear"]
PERIOD_WORDS = ["period", "periodo", "month", "mes"]
FIRST_YEAR, LAST_YEAR = 1990, 2100
SAMPLE_VALUES = 10
MATRIX_CONFIDENCE = 0.6


def _plain_name(name: str) -> str:
    """Driver-side twin of ``normalize_header`` for the few names of the bank."""
    return re.sub(NOT_PLAIN, " ", name.lower()).strip()


def synonym_bank(extra: dict[str, list[str]] | None = None, targets: Iterable[str] = TARGET_COLUMNS) -> dict[str, list[str]]:
    """Normalized names per target: its own name, the known synonyms, and any extra ones."""
    extra = extra or {}
    return {t: [_plain_name(w) for w in [t, *SYNONYMS.get(t, []), *extra.get(t, [])]] for t in targets}


def sample_numeric_share(sample: Column) -> Column:
    """The fraction of an array of sample values that read as numbers."""
    numeric = F.size(F.filter(sample, is_numeric))
    return F.when(F.size(sample) > 0, numeric / F.size(sample)).otherwise(F.lit(0.0))


def candidate_scores(
    catalog: DataFrame, required: Iterable[str] = TARGET_COLUMNS, extra: dict[str, list[str]] | None = None
) -> DataFrame:
    """A row per column and target with the score of the match. No shuffle, no join."""
    targets = selected_targets(required)
    bank = synonym_bank(extra, targets)
    scored = catalog.withColumn("_scores", best_similarity(normalize_header(F.col("col_name")), bank))
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("target_pos"), F.lit(t).alias("target"), F.col("_scores")[i].alias("name_score"))
            for i, t in enumerate(targets)
        ]
    )
    long = scored.select(*TABLE, "col_pos", "col_name", sample_numeric_share(F.col("sample")).alias("_share"), F.inline(pairs))
    numeric_fact = (F.col("target") == "Fact") & (F.col("_share") > NUMERIC_SHARE)
    score = F.when(numeric_fact, F.greatest("name_score", F.lit(MIN_SCORE))).otherwise(F.col("name_score"))
    return long.select(*TABLE, "col_pos", "col_name", "target_pos", "target", score.alias("score"))


def _assign(candidates: Column) -> Column:
    """Walk candidates in order and take each whose target and column are both still free."""
    taken = F.filter(candidates, lambda x: F.lit(False))

    def step(acc, x):
        free = ~F.exists(acc, lambda a: (a["target_pos"] == x["target_pos"]) | (a["col_pos"] == x["col_pos"]))
        return F.when(free, F.concat(acc, F.array(x))).otherwise(acc)

    return F.aggregate(candidates, taken, step)


def rank_candidates(candidates: DataFrame, n: int | None = None) -> DataFrame:
    """All columns of each target, ranked by score, then by position; with ``n`` only the best.

    A limit is applied before the shuffle as well, so a table with very many columns
    sends ``n`` rows per target and task.
    """
    best = Window.partitionBy(*TABLE, "target_pos").orderBy(F.desc("score"), "col_pos")
    ranked = candidates.withColumn("rank", F.row_number().over(best))
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def build_mapping(candidates: DataFrame, required: Iterable[str] = TARGET_COLUMNS) -> DataFrame:
    """Assign columns to targets one-to-one, best score first.

    With ``n`` targets, at most ``n - 1`` columns are taken before a target's turn comes, so
    only its ``n`` best columns can ever matter: the result is the same as from all of
    them, and a table has n * n candidates however many columns it has. Every target is
    in the result; an unmapped one has a null column.
    """
    targets = selected_targets(required)
    short = rank_candidates(candidates, len(targets))
    record = F.struct((-F.col("score")).alias("order"), "target_pos", "col_pos", "col_name", "target", "score")
    sure_enough = F.filter(F.array_sort(F.collect_list(record)), lambda x: x["score"] >= MIN_SCORE)
    groups = short.groupBy(*TABLE).agg(sure_enough.alias("_candidates"))
    chosen = groups.select(*TABLE, _assign(F.col("_candidates")).alias("_chosen"))
    each = chosen.select(
        *TABLE,
        F.posexplode(F.array(*[F.lit(t) for t in targets])).alias("target_pos", "target"),
        F.col("_chosen"),
    )
    match = F.try_element_at(F.filter("_chosen", lambda x: x["target_pos"] == F.col("target_pos")), F.lit(1))
    found = each.select(*TABLE, "target_pos", "target", match["col_name"].alias("col_name"), match["score"].alias("score"))
    # The two review texts.
    unsure = F.format_string(
        "Low-confidence mapping: '%s' -> %s (score %.2f); please confirm.", "col_name", "target", "score"
    )
    missing = F.format_string("No confident source column found for target '%s'.", "target")
    review = F.when(F.col("col_name").isNull(), missing).when(F.col("score") < SURE_SCORE, unsure)
    return found.select("*", review.alias("review"))


def is_year_column(name: Column, sample: Column) -> Column:
    """Named like a year, or its first numeric samples are all years."""
    plain = normalize_header(name)
    named = F.lit(False)
    for word in YEAR_WORDS:
        named = named | plain.contains(word)
    numbers = F.slice(F.transform(F.filter(sample, is_numeric), float_value), 1, SAMPLE_VALUES)
    years = F.forall(numbers, lambda v: v.between(FIRST_YEAR, LAST_YEAR)) & (F.size(numbers) > 0)
    return F.coalesce(named | years, F.lit(False))


def is_month_column(name: Column, sample: Column) -> Column:
    """Named like a period, or any of the first samples is ``P1`` .. ``P99`` or 1 .. 99."""
    plain = normalize_header(name)
    named = F.lit(False)
    for word in PERIOD_WORDS:
        named = named | plain.contains(word)
    some = F.exists(F.slice(sample, 1, SAMPLE_VALUES), lambda v: F.coalesce(strip(v).rlike(r"^[Pp]?\d{1,2}$"), F.lit(False)))
    return F.coalesce(named | some, F.lit(False))


def flag_columns(catalog: DataFrame) -> DataFrame:
    """Year, period and period-header flags for every column. No shuffle."""
    name, sample = F.col("col_name"), F.col("sample")
    return catalog.select(
        *TABLE,
        "col_pos",
        "col_name",
        is_year_column(name, sample).alias("is_year"),
        is_month_column(name, sample).alias("is_period"),
        is_period_header(name).alias("is_period_header"),
    )


def period_strategy(catalog: DataFrame) -> DataFrame:
    """Per table the year and the period column, or null for both, and its period headers.

    The year column is the first that looks like one; the period column is the first that
    looks like one and is not the year column. One aggregate per table finds both.
    """
    flags = flag_columns(catalog)
    column = F.struct("col_pos", "col_name")
    tables = flags.groupBy(*TABLE).agg(
        F.min(F.when(F.col("is_year"), column)).alias("_year"),
        F.array_sort(F.collect_list(F.when(F.col("is_period"), column))).alias("_periods"),
        F.count_if("is_period_header").alias("period_headers"),
    )
    others = F.filter("_periods", lambda p: ~p["col_pos"].eqNullSafe(F.col("_year.col_pos")))
    period = F.try_element_at(others, F.lit(1))["col_name"]
    both = F.col("_year").isNotNull() & period.isNotNull()
    return tables.select(
        *TABLE,
        F.when(both, F.col("_year.col_name")).alias("year_column"),
        F.when(both, period).alias("period_column"),
        "period_headers",
    )


def dataset_mode(strategy: DataFrame, matrix: DataFrame | None = None) -> DataFrame:
    """Per table ``long_period``, ``wide_period``, ``matrix`` or ``normal``.

    ``matrix`` holds (file, sheet, looks_matrix) for the tables that came from worksheets.
    """
    both = strategy if matrix is None else strategy.join(matrix, TABLE, "left")
    looks = F.lit(False) if matrix is None else F.coalesce("looks_matrix", F.lit(False))
    mode = (
        F.when(F.col("year_column").isNotNull(), "long_period")
        .when(F.col("period_headers") >= 2, "wide_period")
        .when(looks, "matrix")
        .otherwise("normal")
    )
    return both.select(*TABLE, "year_column", "period_column", mode.alias("dataset_mode"))


def confidence(mapping: DataFrame, modes: DataFrame) -> DataFrame:
    """Per table the share of mapped targets, scaled to 0.35 .. 0.9; at most 0.6 for a matrix."""
    shares = mapping.groupBy(*TABLE).agg(
        F.count("col_name").alias("mapped_targets"), F.count("*").alias("required_targets")
    )
    score = F.round(0.35 + 0.55 * (F.col("mapped_targets") / F.col("required_targets")), 2)
    capped = F.when(F.col("dataset_mode") == "matrix", F.least(score, F.lit(MATRIX_CONFIDENCE))).otherwise(score)
    return shares.join(modes.select(*TABLE, "dataset_mode"), TABLE).select(
        *TABLE, "dataset_mode", "mapped_targets", "required_targets", capped.alias("confidence")
    )
