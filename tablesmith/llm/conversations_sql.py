"""The repair of damaged conversations as one DuckDB query: shortest paths by a recursive table."""

# The polynomial of crc32 over the characters of ``key``, bit by bit.
_CRC32 = """
xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, n: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)
"""
_BARE = "rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_NO_PATH = "{'c': 1000000000, 'p': '', 'o': ''}"


def _longer(path: str, cost: str, edit: str, turn: str = "''") -> str:
    """``path`` (c: cost, p: edits, o: turns put out) with one edit more."""
    return f"{{'c': {path}.c + {cost}, 'p': {path}.p || '{edit}', 'o': {path}.o || {turn}}}"


def _least(*paths: str) -> str:
    return f"list_min([{', '.join(paths)}])"


def _when(test: str, path: str) -> str:
    return f"case when {test} then {path} else {_NO_PATH} end"


def _kept(initial: str, *paths: str) -> list[str]:
    return [_when(f"free and i = '{initial}'", _longer(p, "late", "K", "own")) for p in paths]


def _reroled(turn: str, *paths: str) -> list[str]:
    return [_when("free", _longer(p, "late + 1", "R", turn)) for p in paths]


_ADD_USER = [_longer(p, "5", "I", "'user:' || chr(10)") for p in ("nothing", "system", "answer")]
_ADD_ANSWER = _longer("user1", "5", "I", "'assistant:' || chr(10)")
_BEFORE_USER = ("nothing", "system", "answer1")

SQL = f"""
with recursive
k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
d as (select conv_id, turn, case when h = 4 then 'user' else role end as role,
    case h when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
    unnest(range(case when h = 3 then 2 else 1 end)) as copy
  from (select *, {_CRC32} % 20 as h from k) where h <> 0),
o as (select *, role[1] as i, {_BARE} as bare,
    row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as n,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as again from d),
f as (select *, lag(i) over (partition by conv_id order by n) as before,
    case when bare = '' then 'b' when again then 'd' when right(bare, 1) not in ('.', '!', '?') then 't' else '' end as fault from o),
stats as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) as n_rows,
    count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate,
    count(*) filter (fault = 't') as truncated,
    count(*) filter (before is not null and before || i not in ('su', 'ua', 'au')) as illegal from f group by conv_id),
v as (
  select conv_id, 0::bigint as n, {{'c': 0, 'p': '', 'o': ''}} as nothing, {_NO_PATH} as system, {_NO_PATH} as user_turn,
    {_NO_PATH} as answer from stats
  union all
  select conv_id, n, {_longer("nothing", "2", "D")}, {_least(_longer("system", "2", "D"), *_kept("s", "nothing"))},
    {_least(_longer("user1", "2", "D"), *_kept("u", *_BEFORE_USER), *_reroled("as_user", *_BEFORE_USER))},
    {_least(_longer("answer1", "2", "D"), *_kept("a", "user1"), *_reroled("as_answer", "user1"))}
  from (select *, {_least("answer", _ADD_ANSWER)} as answer1 from (
    select v.conv_id, f.n, nothing, system, answer, i, fault in ('', 't') as free, 5 * (fault = 't')::int as late,
      role || ':' || text || chr(10) as own, 'user:' || text || chr(10) as as_user,
      'assistant:' || text || chr(10) as as_answer, {_least("user_turn", *_ADD_USER)} as user1
    from v join f on f.conv_id is not distinct from v.conv_id and f.n = v.n + 1))),
best as (select v.conv_id, {_least("nothing", "answer", _longer("user_turn", "5", "I", "'assistant:' || chr(10)"))} as b
  from v join stats on stats.conv_id is not distinct from v.conv_id where n = n_rows)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(b.c, 0) as cost, coalesce(b.p, '') as audit,
  sha256(coalesce(b.o[:-2], '')) as repaired_sha256
from (select distinct conv_id from conversations) as c
left join stats on stats.conv_id is not distinct from c.conv_id left join best on best.conv_id is not distinct from c.conv_id
"""
