"""SQL, by brute force and written by hand, for the operators' queries whose whole result SQL can say."""

from __future__ import annotations

from .secret_scan import BASE_RULES, MORE_RULES

_W = r"[^\x20\x09-\x0D]+"
_WORDS = rf"regexp_extract_all(t, '{_W}')"

#: All pairs that share a shingle are counted, and links followed as far as they lead.
NEAR_DUPLICATES = f"""with recursive d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
  w as (select doc_id, {_WORDS} as ws from d), s as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from w where len(ws) > 0)),
  n as (select doc_id, count(*) as n from s group by doc_id), p as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
  l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 85 * (x.n + y.n - common)), r as (select a as doc_id, b as other from l union select r.doc_id, l.b from r join l on l.a = r.other),
  c as (select doc_id, min(other) as least from r group by doc_id)
  select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) as component_id, d.doc_id <= coalesce(c.least, d.doc_id) as kept from d left join n on n.doc_id = d.doc_id left join c on c.doc_id = d.doc_id"""

QUALITY = f"""with d as (select doc_id, coalesce(source, '') as host, coalesce(text, '') as t from documents), w as (select *, {_WORDS} as ws from d),
  v as (select doc_id, i, array_to_string(ws[i:i + 7], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8)),
  f as (select *, count(*) over (partition by doc_id, g) as n from v), o as (select doc_id, count(distinct i + k) as n from f, range(0, 8) z(k) where n > 1 group by doc_id),
  l as (select doc_id, host, line, lower(trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) as norm, len(regexp_extract_all(line, '{_W}')) as n from (select doc_id, host, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '{_W}')),
  m as (select host, norm from l group by host, norm having count(distinct doc_id) > 30), g as (select doc_id, count(*) - count(distinct line) as dup, coalesce(sum(l.n) filter (where m.norm is not null), 0) as gone from l left join m on l.host = m.host and l.norm = m.norm group by doc_id),
  b as (select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars, cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols,
    coalesce(dup, 0) as n_dup_lines, coalesce(o.n, 0) as n_repeat_words, cast(len(ws) - coalesce(gone, 0) as bigint) as n_left from w left join o on o.doc_id = w.doc_id left join g on g.doc_id = w.doc_id)
  select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
    not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or n_left < 20 or n_left < 0.2 * n_words) as kept, n_left from b"""


def _matches(place: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of a kind: a match starts after all pieces and matches before it."""
    quoted = pattern.replace("'", "''")
    return f"""select doc_id, {place} as place, '{kind}' as kind, list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) as start, length(m[k]) as size
    from (select doc_id, regexp_extract_all(t, '{quoted}') as m, regexp_split_to_array(t, '{quoted}') as p, unnest(range(1, len(m) + 1)) as k from d) where length(regexp_extract(m[k], '{quoted}', {group})) >= {least}"""


_SPANS = " union all ".join([_matches(k, *rule) for k, rule in enumerate(BASE_RULES)] + [_matches(k, kind, pattern, 0, 1) for k, (kind, pattern, _) in enumerate(MORE_RULES, len(BASE_RULES))])
SECRETS = f"""with d as (select doc_id, coalesce(text, '') as t from documents), s as ({_SPANS}), a as (select doc_id, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
  coalesce(string_agg(kind || ':' || start || ':' || (start + size), ',' order by start, place) filter (where place < {len(BASE_RULES)}), '') as base, string_agg(kind || ':' || start || ':' || (start + size), ',' order by start, place) as spans from s group by doc_id)
  select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join a on a.doc_id = d.doc_id"""

#: Every document scored for every item.
RANKED = r"""with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
  x as (select doc_id, ts, len(ts) as n, row_number() over () as row from d where len(ts) > 0), c as (select count(*) as nn, cast(sum(n) as bigint) as ll from x),
  q as (select item_id, row_number() over () as item, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
  p as (select row, t, count(*) as tf from (select row, unnest(ts) as t from x) group by all), f as (select t, count(*) as df from p group by t),
  w as (select t, cast(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) as bigint) as w from f, c),
  s as (select item, item_id, x.row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)))) as score from q join p on q.t = p.t join w on w.t = q.t join x on x.row = p.row, c group by all),
  r as (select *, row_number() over (partition by item order by score desc, doc_id) as rank from s where score > 0)
  select item_id, cast(rank as integer) as rank, doc_id, cast(score as bigint) as score from r where rank <= 20"""

ORACLES = {"op2_minmax_near_dedup": NEAR_DUPLICATES, "op5_secret_ledger": SECRETS, "op7_line_frequency_quality": QUALITY, "op12_wand_search": RANKED}
