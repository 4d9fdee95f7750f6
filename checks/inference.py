"""Layout inference over the column catalog."""

from pyspark.sql import functions as F

from checks.fixtures import view
from checks.registry import query
from checks.sheets import MATRIX_SHEETS, _NAMES, _SCORES as _SCORES_OF_ROWS
from tablesmith.functions.similarity import normalize_header, similarity
from tablesmith.operators.layout import (
    build_mapping,
    candidate_scores,
    confidence,
    dataset_mode,
    flag_columns,
    period_strategy,
    rank_candidates,
    sample_numeric_share,
    synonym_bank,
)
from tablesmith.operators.matrix import looks_like_matrix
from tablesmith.schema import TARGET_COLUMNS
from tablesmith.sources.cells import catalog_of_cells

_NORM = "trim(regexp_replace(lower(col_name), '[^a-z0-9]+', ' ', 'g'))"
_NUM = r"coalesce(regexp_matches(trim(replace(replace(v, ',', ''), '$', '')), '^(?i)[+-]?(\d+(\.\d*)?(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|nan|inf|infinity)$'), false)"
_SHARE = f"len(list_filter(sample, lambda v: {_NUM})) / len(sample)"


def _best(a: str, b: str) -> str:
    """The longest common block of two texts: longest first, then leftmost in both."""
    blocks = f"flatten(list_transform(range(1, length({a}) + 1), lambda i: list_transform(range(1, length({a}) - i + 2), lambda k: [k, -i])))"
    hits = f"list_filter({blocks}, lambda x: contains({b}, {a}[-x[2] : -x[2] + x[1] - 1]))"
    return f"list_aggregate({hits}, 'max')"


def _ratios(pairs: str) -> str:
    """Ratcliff-Obershelp ratio of every (a, b) in ``pairs``, by recursion on both sides of the best block."""
    return f"""
    blocks as (
      select a as whole_a, b as whole_b, a, b, {_best("a", "b")} as m from {pairs}
      union all
      select whole_a, whole_b, sides.a, sides.b, {_best("sides.a", "sides.b")} from (
        select whole_a, whole_b, unnest([a[1 : -m[2] - 1], a[-m[2] + m[1] :]]) as a,
               unnest([b[1 : strpos(b, a[-m[2] : -m[2] + m[1] - 1]) - 1], b[strpos(b, a[-m[2] : -m[2] + m[1] - 1]) + m[1] :]]) as b
        from blocks where m is not null) as sides where sides.a <> '' and sides.b <> ''),
    ratios as (select whole_a as a, whole_b as b, 2.0e0 * coalesce(sum(m[1]), 0) / (length(whole_a) + length(whole_b)) as ratio
      from blocks group by whole_a, whole_b)"""


def _scores(extra: dict[str, list[str]] | None = None, targets=TARGET_COLUMNS) -> str:
    bank = synonym_bank(extra, targets)
    words = ", ".join(f"({i}, '{t}', '{w}')" for i, t in enumerate(targets) for w in sorted(set(bank[t])))
    return f"""with recursive
    bank(target_pos, target, word) as (values {words}),
    names as (select distinct {_NORM} as a from column_catalog),
    pairs as (select distinct a, word as b from names join bank on a <> ''),
    {_ratios("pairs")},
    best as (select a, target_pos, max(greatest(ratio, case when contains(a, b) or contains(b, a) then 0.82e0 else 0 end)) as score
      from ratios join bank on word = b group by all),
    scores as (select file, sheet, col_pos, col_name, t.target_pos, t.target,
        case when t.target = 'Fact' and {_SHARE} > 0.6 then greatest(coalesce(score, 0), 0.55e0) else coalesce(score, 0e0) end as score
      from column_catalog join (select distinct target_pos, target from bank) as t on true
      left join best on a = {_NORM} and best.target_pos = t.target_pos)
    """


_MAPPED = """,
    grouped as (select file, sheet, list([struct_pack(target_pos, col_pos, target, col_name, score)] order by score desc, target_pos, col_pos) as c
      from scores where score >= 0.55e0 group by all),
    chosen as (select file, sheet, list_reduce(c, lambda acc, x: case when len(list_filter(acc, lambda y: y.target_pos = x[1].target_pos or y.col_pos = x[1].col_pos)) > 0
        then acc else list_concat(acc, x) end) as picks from grouped),
    picked as (select file, sheet, unnest(picks, recursive := true) from chosen),
    mapping as (select k.file, k.sheet, k.target_pos, k.target, p.col_name, p.score,
        case when p.col_name is null then 'No confident source column found for target ''' || k.target || '''.'
             when p.score < 0.7 then printf('Low-confidence mapping: ''%s'' -> %s (score %.2f); please confirm.', p.col_name, k.target, p.score) end as review
      from (select distinct file, sheet, target_pos, target from scores) as k left join picked as p using (file, sheet, target_pos))
"""


def _catalog(spark, sf_dir):
    return view(spark, sf_dir, "column_catalog")


@query(
    "f6_similarity",
    "with recursive pairs as (select distinct "
    + _NORM
    + " as a, lower(sample[1]) as b from column_catalog where "
    + _NORM
    + " <> ''), "
    + _ratios("pairs")
    + f" select file, col_pos, ratio as similarity from column_catalog left join ratios on a = {_NORM} and b = lower(sample[1]) where {_NORM} <> ''",
)
def _(spark, sf_dir):
    name = normalize_header(F.col("col_name"))
    score = similarity(name, F.lower(F.col("sample")[0]))
    return _catalog(spark, sf_dir).where(name != "").select("file", "col_pos", score.alias("similarity"))


_EXTRA = {"Brand": ["Anything"], "Region": ["Regn", "customer zone"]}


@query("m1_extended_bank", _scores(_EXTRA, ["Region", "Brand"]) + "select * from scores")
def _(spark, sf_dir):
    return candidate_scores(_catalog(spark, sf_dir), ["Region", "Brand"], _EXTRA)


@query("m2_column_scores", _scores() + "select * from scores")
def _(spark, sf_dir):
    return candidate_scores(_catalog(spark, sf_dir))


@query("j4_candidate_pairs", _scores() + "select target, count(*) as pairs, count(*) filter (score >= 0.55e0) as candidates from scores group by target")
def _(spark, sf_dir):
    pairs = candidate_scores(_catalog(spark, sf_dir)).groupBy("target")
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(F.col("score") >= 0.55).alias("candidates"))


@query("m3_column_mapping", _scores() + _MAPPED + "select * from mapping")
def _(spark, sf_dir):
    return build_mapping(candidate_scores(_catalog(spark, sf_dir)))


@query(
    "l4_ranked_candidates",
    _scores() + """select file, sheet, target, col_name, score, cast(row_number() over (partition by file, sheet, target_pos order by score desc, col_pos) as int) as rank
        from scores""",
)
def _(spark, sf_dir):
    ranked = rank_candidates(candidate_scores(_catalog(spark, sf_dir)))
    return ranked.select("file", "sheet", "target", "col_name", "score", "rank")


_FLOATS = f"list_transform(list_filter(sample, lambda v: {_NUM}), lambda v: cast(replace(replace(v, ',', ''), '$', '') as double))[1:10]"
_FLAGS = f"""
flags as (select file, sheet, col_pos, col_name,
  regexp_matches({_NORM}, 'year|año|ano|displayyear') or (len({_FLOATS}) > 0 and len(list_filter({_FLOATS}, lambda y: y between 1990 and 2100)) = len({_FLOATS})) as is_year,
  regexp_matches({_NORM}, 'period|periodo|month|mes') or len(list_filter(sample[1:10], lambda v: coalesce(regexp_matches(trim(v), '^[Pp]?\\d{{1,2}}$'), false))) > 0 as is_period,
  regexp_matches(trim(col_name), '(?i)^c\\d{{4}}\\s+[a-z]{{3,}}$|^\\d{{2}}\\.\\d{{4}}$|^(january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)[ /_-]\\d{{4}}$|^\\d{{4}}[-/]\\d{{1,2}}$|^P\\d{{1,2}}$') as is_period_header
  from column_catalog)
"""


@query("m4_year_columns", f"with {_FLAGS} select file, sheet, col_pos, col_name, is_year from flags")
def _(spark, sf_dir):
    return flag_columns(_catalog(spark, sf_dir)).select("file", "sheet", "col_pos", "col_name", "is_year")


@query("m5_period_columns", f"with {_FLAGS} select file, sheet, col_pos, col_name, is_period, is_period_header from flags")
def _(spark, sf_dir):
    return flag_columns(_catalog(spark, sf_dir)).drop("is_year")


_STRATEGY = f"""{_FLAGS},
years as (select file, sheet, min(col_pos) filter (is_year) as y, count(*) filter (is_period_header) as period_headers from flags group by all),
found as (select y.file, y.sheet, y.period_headers, y.y,
  (select min(f.col_pos) from flags as f where f.file = y.file and f.sheet = y.sheet and f.is_period and (y.y is null or f.col_pos <> y.y)) as p from years as y),
strategy as (select s.file, s.sheet, case when y is not null and p is not null then fy.col_name end as year_column,
  case when y is not null and p is not null then fp.col_name end as period_column, period_headers
  from found as s left join flags as fy on fy.file = s.file and fy.sheet = s.sheet and fy.col_pos = y
  left join flags as fp on fp.file = s.file and fp.sheet = s.sheet and fp.col_pos = p),
modes as (select file, sheet, year_column, period_column, case when year_column is not null then 'long_period' when period_headers >= 2 then 'wide_period'
  when file like '%7.csv' then 'matrix' else 'normal' end as dataset_mode from strategy)
"""


def _modes(spark, sf_dir):
    strategy = period_strategy(_catalog(spark, sf_dir))
    matrix = strategy.select("file", "sheet", F.col("file").endswith("7.csv").alias("looks_matrix"))
    return dataset_mode(strategy, matrix)


@query("m6_period_strategy", f"with {_STRATEGY} select * from strategy")
def _(spark, sf_dir):
    return period_strategy(_catalog(spark, sf_dir))


@query("m7_dataset_mode", f"with {_STRATEGY} select * from modes")
def _(spark, sf_dir):
    return _modes(spark, sf_dir)


_CONFIDENCE = """
select m.file, m.sheet, dataset_mode, count(m.col_name) as mapped_targets, count(*) as required_targets,
  case when dataset_mode = 'matrix' then least(round(0.35e0 + 0.55e0 * (count(m.col_name) / count(*)), 2), 0.6e0)
       else round(0.35e0 + 0.55e0 * (count(m.col_name) / count(*)), 2) end as confidence
from mapping as m join modes as d using (file, sheet) group by m.file, m.sheet, dataset_mode
"""


@query("m9_confidence", _scores() + _MAPPED + f", {_STRATEGY} {_CONFIDENCE}")
def _(spark, sf_dir):
    mapping = build_mapping(candidate_scores(_catalog(spark, sf_dir)))
    return confidence(mapping, _modes(spark, sf_dir))


@query("a12_sample_numeric_share", f"select file, col_pos, {_SHARE} as numeric_share from column_catalog")
def _(spark, sf_dir):
    return _catalog(spark, sf_dir).select("file", "col_pos", sample_numeric_share(F.col("sample")).alias("numeric_share"))


# The catalog of real sheets: their detected header rows, names, and first filled values.
_SHEET_CATALOG = f"""
{_SCORES_OF_ROWS},
named as ({_NAMES.format(rows="select sheet, header_row from best where lower(sheet) <> 'guide'")}),
sheet_catalog as (select 'book.xlsx' as file, n.sheet, cast(n.col_idx as int) as col_pos, n.name as col_name,
    coalesce(list(c.value order by c.row_idx) filter (c.value <> ''), []) as sample
  from named as n left join cells as c on c.sheet = n.sheet and c.col_idx = n.col_idx and c.row_idx > n.header_row and c.row_idx <= n.header_row + 12
  group by all)
"""


def _book(spark, sf_dir):
    return view(spark, sf_dir, "cells").select(F.lit("book.xlsx").alias("file"), "*")


@query("s11_catalog", f"with {_SHEET_CATALOG} select * replace (array_to_string(sample, '|') as sample) from sheet_catalog")
def _(spark, sf_dir):
    return catalog_of_cells(_book(spark, sf_dir)).withColumn("sample", F.array_join("sample", "|"))


_SHEET_MODES = _STRATEGY.replace("column_catalog", "sheet_catalog").replace(
    "when file like '%7.csv' then 'matrix'", f"when sheet in (select sheet from ({MATRIX_SHEETS}) as m where looks_matrix) then 'matrix'"
)


@query("m7_sheet_modes", f"with {_SHEET_CATALOG}, {_SHEET_MODES} select * from modes")
def _(spark, sf_dir):
    """Worksheets through catalog, period strategy and matrix test."""
    cells = _book(spark, sf_dir)
    return dataset_mode(period_strategy(catalog_of_cells(cells)), looks_like_matrix(cells))
