"""DuckDB statements that give the same rows as queries, where SQL can express them."""

from __future__ import annotations

from gustframe.llm.chat import CONTROLS
from gustframe.llm.secrets_ledger import BASE_RULES, RULES, Rule


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _pattern(texts: tuple[str, ...]) -> str:
    return "|".join("".join(f"\\{c}" if not c.isalnum() and c not in "_<>/ " else c for c in t) for t in texts)


_ESCAPES = _quoted("\\\\|" + _pattern(CONTROLS))

CHAT = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(17 + length(role) + len(regexp_extract_all(role, {_ESCAPES})) + length(text) + len(regexp_extract_all(text, {_ESCAPES})))::bigint as formatted_chars
from t group by conv_id
"""


def _near(words: int, out: str) -> str:
    return f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents
), s as (
  select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < {words} then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' '))) end as sh from w
), e as (select doc_id, len(sh) as n, unnest(sh) as g from s),
pairs as (select a.doc_id as x, b.doc_id as y, a.n as nx, b.n as ny, count(*) as c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select x, y from pairs where 100 * c >= 80 * (nx + ny - c)),
edges as (select x, y from links union all select y, x from links),
reach(x, y) as (select doc_id, doc_id from documents union select r.x, e.y from reach r join edges e on r.y = e.x),
comp as (select x as doc_id, min(y) as component_id from reach group by x)
select s.doc_id, len(s.sh)::bigint as n_shingles, component_id{out} from s join comp using (doc_id)
"""


NEAR = _near(4, ", s.doc_id = component_id as kept")
JOIN = _near(5, "")


def _spans(rank: int, rule: Rule) -> str:
    p = _quoted(rule.pattern)
    # An empty piece stands before a match at the beginning, as one does after a match at the end.
    return f"""
  select doc_id, {rank} as rank, '{rule.kind}' as kind, unnest(list_transform(list_filter(range(1, len(m) + 1), lambda i: length(v[i]) >= {rule.least}), lambda i: [
    coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
    coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0)])) as place
  from (select doc_id, regexp_extract_all(text, {p}) as m, regexp_extract_all(text, {p}, {rule.value}) as v, string_split_regex(text, {p}) as p from d)"""


SECRETS = f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
found as ({" union all ".join(_spans(i, r) for i, r in enumerate(RULES))}),
said as (select doc_id, rank, kind, place[1] as start, kind || ':' || place[1]::bigint || ':' || place[2]::bigint as span from found)
select d.doc_id, count(*) filter (where kind = 'assign')::bigint as n_assign, count(*) filter (where kind = 'access')::bigint as n_access,
  count(*) filter (where kind = 'hex')::bigint as n_hex,
  sha256(coalesce(string_agg(span, ',' order by start, rank) filter (where rank < {len(BASE_RULES)}), '')) as base_sha256,
  coalesce(string_agg(span, ',' order by start, rank) filter (where span is not null), '') as spans
from d left join said using (doc_id) group by d.doc_id
"""

#: CRC-32 of bytes given as hexadecimal digits `x`, by the table `t` of its 256 single steps.
_CRC_TABLE = "select list(v order by i) as t from (select i, list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::bigint[], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i::bigint) as v from range(256) r(i))"


def _crc(x: str) -> str:
    steps = f"list_transform(range(1, length({x}), 2), lambda i: ('0x' || substr({x}, i, 2))::bigint)"
    return f"xor(list_reduce({steps}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint)"


RESAMPLE = f"""
with tbl as ({_CRC_TABLE}),
words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_quoted("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")}) as w
  from (select doc_id, text from documents union all select -1 - row_number() over () as doc_id, text from benchmark)),
feats as (select doc_id, unnest(w) as f from words
  union all select doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from words
  union all select doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from words),
hashed as (select f, {_crc("x")} % 10000 as b from (select distinct f, hex(encode(f)) as x from feats), tbl),
used as (select doc_id, b, count(*) as n from feats join hashed using (f) group by 1, 2),
tot as (select b, coalesce(sum(n) filter (where doc_id >= 0), 0) as s, coalesce(sum(n) filter (where doc_id < 0), 0) as t from used group by 1),
ends as (select coalesce(sum(s), 0) as ss, coalesce(sum(t), 0) as tt from tot),
gain as (select b, floor(1000 * ln(((t + 1) * (ss + 10000))::double / ((s + 1) * (tt + 10000))::double))::bigint as g from tot, ends),
weights as (select doc_id, sum(n)::bigint as n_features, sum(n * g)::bigint as weight from used join gain using (b) where doc_id >= 0 group by 1),
said as (select doc_id, len(w) as words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, ('0x' || left(sha256('42:' || doc_id), 8))::bigint as h
  from words left join weights using (doc_id) where doc_id >= 0),
scored as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from said),
line as (select doc_id, row_number() over (order by score desc, doc_id) as r from scored where words >= 20)
select doc_id, n_features::bigint as n_features, weight::bigint as weight, score::bigint as score,
  case when r <= 5 * (select count(*) from line) // 100 then r end as rank from scored left join line using (doc_id)
"""


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"


_LEAF = "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {text})"


def _tree(name: str, leaves: str, key: str) -> str:
    """Nodes (key, level, i, n of that level, h) of the trees over leaves (key, i, n, h)."""
    return f"""{name}(k, level, i, n, h) as (select {key} as k, 0 as level, i, n, h from {leaves}
  union all select k, level + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' order by i)) from {name} where n > 1 group by k, level, i // 3)"""


def _siblings(name: str, key: str, at: str, leaves: str) -> str:
    """For each leaf and level, the digests left and right of its ancestor."""
    return f"""select l.{key} as k, l.{at} as p, a.level, coalesce(string_agg(s.h, '' order by s.i) filter (where s.i < a.i), '') as l, coalesce(string_agg(s.h, '' order by s.i) filter (where s.i > a.i), '') as r
  from {leaves} l join {name} a on a.k = l.{key} and a.n > 1 and a.i = l.{at} // (3 ** a.level)::bigint
  join {name} s on s.k = a.k and s.level = a.level and s.i // 3 = a.i // 3 group by l.{key}, l.{at}, a.level, a.i"""


MERKLE = f"""
with recursive tbl as ({_CRC_TABLE}),
named as (select dense_rank() over (order by source nulls first) - 1 as k, *,
  case when {_crc("hex(encode(doc_id::varchar))")} % 2 = 0 then replace(text, chr(10), '') else text end as altered from documents, tbl),
leaves as (select k, doc_id, row_number() over (partition by k order by doc_id) - 1 as i, count(*) over (partition by k) as n,
  {_LEAF.format(text=_field("text"))} as h, {_LEAF.format(text=_field("altered"))} as now from named),
{_tree("node", "leaves", "k")},
subs as (select 0 as z, k as i, count(*) over () as n, h from node where n = 1),
{_tree("upper", "subs", "z")},
steps as (select s.k, s.p, s.level, s.l, s.r from ({_siblings("node", "k", "i", "leaves")}) s
  union all select l.k, l.i, 1000 + u.level, u.l, u.r from leaves l join ({_siblings("upper", "z", "i", "subs")}) u on u.p = l.k),
paths as (select k, p, list(l order by level) as ls, list(r order by level) as rs, sha256(string_agg(l || r, '' order by level)) as proof from steps group by 1, 2),
fold(doc_id, j, h, ls, rs) as (select doc_id, 1, now, coalesce(ls, []), coalesce(rs, []) from leaves left join paths on paths.k = leaves.k and paths.p = leaves.i
  union all select doc_id, j + 1, sha256(ls[j] || h || rs[j]), ls, rs from fold where j <= len(ls))
select doc_id, leaves.h as leaf, subs.h as subroot, top.h as root, coalesce(proof, sha256('')) as proof_sha256, fold.h as folded_root, fold.h = top.h as verified
from leaves join subs on subs.i = leaves.k join (select h from upper where n = 1) top on true left join paths on paths.k = leaves.k and paths.p = leaves.i
join fold using (doc_id) where fold.j = len(fold.ls) + 1
"""
