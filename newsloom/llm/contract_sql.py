"""SQL (DuckDB) for what SQL can state of the training-data operators' results: plain restatements, without their methods."""

from __future__ import annotations

#: A word, as a regular expression in SQL.
WORD = r"'[^\x20\x09-\x0D]+'"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Rows with a number of their own, since doc_ids may repeat, and their words by place.
_WORDS = f"""
d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
l as (select rid, doc_id, t, regexp_extract_all(t, {WORD}) as w from d),
words as (select rid, doc_id, unnest(w) as word, unnest(range(len(w))) as i from l)"""

#: Every window of 50 words is written out; a window goes if a smaller doc_id holds it too.
SUBSTRING_DEDUP = f"""
with {_WORDS},
win as (
  select rid, doc_id, i, md5(array_to_string(list(word) over (partition by rid order by i rows between current row and 49 following), ' ')) as h,
    count(*) over (partition by rid order by i rows between current row and 49 following) as n from words),
first_ as (select h, min(coalesce(doc_id, 9223372036854775807)) as least from win where n = 50 group by h),
gone as (select rid, i as s from win join first_ using (h) where n = 50 and coalesce(doc_id, 9223372036854775807) > least),
starts as (select words.rid, words.i, word, max(s) over (partition by words.rid order by words.i rows between unbounded preceding and current row) as last from words left join gone on words.rid = gone.rid and words.i = gone.s),
marked as (select rid, i, word, last is not null and i - last < 50 as lost from starts),
told as (select rid, count(*) as n_words, count(*) filter (lost) as n_removed, coalesce(string_agg(word, ' ' order by i) filter (not lost), '') as kept from marked group by rid)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join told using (rid)
"""

#: All pairs that share a shingle, and the closure of the links.
JACCARD_JOIN = f"""
with recursive {_WORDS},
low as (select rid, i, {LOWER.format('word')} as word from words),
run as (select rid, i, array_to_string(list(word) over (partition by rid order by i rows between current row and 4 following), ' ') as s,
  count(*) over (partition by rid order by i rows between current row and 4 following) as n, count(*) over (partition by rid) as total from low),
sets as (select distinct rid, s from run where n = 5 or (i = 0 and total < 5)),
sizes as (select rid, count(*) as n from sets group by rid),
named as (select rid, n, md5(string_agg(s, chr(10) order by s)) as node from sets join sizes using (rid) group by rid, n),
nodes as (select node, n, min(rid) as rid from named group by node, n),
shared as (select x.rid as a, y.rid as b, count(*) as common from sets x join sets y on x.s = y.s and x.rid < y.rid
  where x.rid in (select rid from nodes) and y.rid in (select rid from nodes) group by all),
links as (select na.node as a, nb.node as b from shared join nodes na on na.rid = shared.a join nodes nb on nb.rid = shared.b where 100 * common >= 75 * (na.n + nb.n - common)),
both_ as (select a, b from links union all select b, a from links),
reach as (select node as a, node as b from nodes union select reach.a, both_.b from reach join both_ on reach.b = both_.a),
least as (select node, min(coalesce(doc_id, 9223372036854775807)) as doc from named join d using (rid) group by node),
comp as (select reach.a as node, min(doc) as doc from reach join least on reach.b = least.node group by reach.a)
select d.doc_id, coalesce(named.n, 0) as n_shingles, case when named.n is null then d.doc_id else nullif(comp.doc, 9223372036854775807) end as component_id
from d left join named using (rid) left join comp using (node)
"""

QUALITY_BASE = f"""
with {_WORDS},
of_words as (select rid, count(*) as n_words, sum(length(word)) as word_chars from words group by rid),
tri as (select rid, i, word || ' ' || lead(word, 1) over o || ' ' || lead(word, 2) over o as k from words window o as (partition by rid order by i)),
again as (select rid, i from (select rid, i, count(*) over (partition by rid, k) as n from tri where k is not null) where n > 1),
cover as (select distinct rid, i + o as i from again, (select unnest([0, 1, 2]) as o)),
of_repeats as (select rid, count(*) as n_repeat_words from cover group by rid),
lines as (select rid, unnest(string_split(t, chr(10))) as line from d),
of_lines as (select rid, count(*) - count(distinct line) as n_dup_lines from lines where regexp_matches(line, {WORD}) group by rid),
c as (
  select doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from d left join of_words using (rid) left join of_lines using (rid) left join of_repeats using (rid))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c
"""


def _found(kind: str, place: int, pattern: str, checked: str) -> str:
    """Spans of one kind: what lies between the matches and the matches themselves add up to their places."""
    return f"""
{kind}_m as (select rid, unnest(regexp_extract_all(t, {pattern})) as m, unnest(regexp_extract_all(t, {pattern}, {2 if kind == 'assign' else 0})) as v,
  unnest(string_split_regex(t, {pattern})) as gap, unnest(range(len(string_split_regex(t, {pattern})))) as i from d),
{kind}_s as (select rid, '{kind}' as kind, {place} as place, m, v, sum(length(gap) + length(coalesce(m, ''))) over (partition by rid order by i) as e from {kind}_m),
{kind}_f as (select rid, kind, place, e - length(m) as s, e from {kind}_s where m is not null and {checked})"""


_ASSIGN = r"""'(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'"""
SECRET_BASE = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
{_found('assign', 0, _ASSIGN, 'length(v) >= 6')},
{_found('access', 1, "'AKIA[A-Z0-9]+'", 'length(m) >= 20')},
{_found('hex', 2, "'[0-9a-f]+'", 'length(m) >= 24')},
spans as (select * from assign_f union all select * from access_f union all select * from hex_f),
told as (select rid, count(*) filter (place = 0) as n_assign, count(*) filter (place = 1) as n_access, count(*) filter (place = 2) as n_hex,
  string_agg(kind || ':' || s::bigint::varchar || ':' || e::bigint::varchar, ',' order by s, place) as said from spans group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(said, '')) as base_sha256 from d left join told using (rid)
"""


def _remainder(modulus: int) -> str:
    """crc32 of each doc_id's digits, bit by bit, modulo `modulus`."""
    return f"""
ids as (select distinct doc_id, doc_id::varchar as s from documents where doc_id is not null),
crc as (
  select doc_id, s, 0 as k, 4294967295::bigint as c from ids
  union all
  select doc_id, s, k + 1, case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end
  from (select doc_id, s, k, case when k % 8 = 0 then xor(c, ascii(s[k // 8 + 1])::bigint) else c end as x from crc where k < 8 * length(s))),
rest as (select doc_id, xor(c, 4294967295::bigint) % {modulus} as r from crc where k = 8 * length(s))"""


LM_BASE = f"""
with recursive {_remainder(7)}, {_WORDS},
marked as (select rid, l.doc_id, coalesce(r = 2, false) as held_out from l left join rest on l.doc_id = rest.doc_id),
tokens as (select rid, 'w' || {LOWER.format('word')} as token from words union all select rid, 'end' from l),
counts as (select token, count(*) as c from tokens join marked using (rid) where not held_out group by token),
total as (select coalesce(sum(c), 0)::bigint as n, count(*) as v from counts)
select doc_id, held_out, count(*) as n_tokens, count(c) as n_known, n as train_tokens, round(sum(log10((coalesce(c, 0) + 1.0::double) / (n + v + 1))), 4) as base_score
from tokens join marked using (rid) left join counts using (token) cross join total group by rid, doc_id, held_out, n
"""

HELD_OUT = f"""
with recursive {_remainder(4)}
select documents.doc_id, coalesce(r = 2, false) as held_out from documents left join rest using (doc_id)
"""

#: A term: ASCII letters and digits and all characters beyond ASCII.
_TERMS = r"regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: Every feature is written out; crc32 of the distinct ones comes byte by byte from a table that the rule makes.
RESAMPLING = f"""
with tab as (select list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
d as (select row_number() over () as rid, 's' as side, doc_id, list_transform({_TERMS}, lambda x: {LOWER.format('x')}) as w from documents),
b as (select row_number() over () as rid, 't' as side, null::bigint as doc_id, list_transform({_TERMS}, lambda x: {LOWER.format('x')}) as w from benchmark),
f as (select side, rid, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as feature from (select * from d union all select * from b)),
names as (select distinct feature, hex(encode(feature)) as x from f),
crcs as (select feature, xor(list_reduce([4294967295] || list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) % 10000 as bucket from names cross join tab),
g as (select side, rid, bucket, count(*) as n from f join crcs using (feature) group by all),
sums as (select k as bucket, coalesce(sum(n) filter (side = 's'), 0) as s, coalesce(sum(n) filter (side = 't'), 0) as t from range(10000) r(k) left join g on g.bucket = k group by k),
gains as (select bucket, floor(1000 * ln(((t + 1)::double * (sum(s) over () + 10000)::double) / ((s + 1)::double * (sum(t) over () + 10000)::double)))::bigint as gain from sums),
per as (select rid, sum(n * gain) as gain, sum(n) as n from g join gains using (bucket) where side = 's' group by rid),
e as (select doc_id, coalesce(n, 0)::bigint as n_features, coalesce(floor(gain::double / n), 0)::bigint as weight, len(w) as words, (('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5) / 4294967296 as u, d.rid from d left join per using (rid)),
o as (select *, weight + floor(-1000 * ln(-ln(u::double)))::bigint as score from e),
r as (select rid, row_number() over (order by score desc, doc_id nulls last) as place, count(*) over () as n from o where words >= 20)
select doc_id, n_features, weight, score, case when place <= n * 25 // 100 then place end as rank from o left join r using (rid)
"""

RANKED_SEARCH = f"""
with d as (select row_number() over () as rid, doc_id, list_transform({_TERMS}, lambda x: {LOWER.format('x')}) as w from documents),
sized as (select rid, doc_id, w, len(w) as n from d where len(w) > 0),
q as (select distinct item_id, unnest(list_transform({_TERMS}, lambda x: {LOWER.format('x')})) as term from benchmark),
tf as (select rid, term, count(*) as tf from (select rid, unnest(w) as term from sized) where term in (select term from q) group by all),
total as (select count(*)::bigint as docs, sum(n)::bigint as terms from sized),
df as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w from tf cross join total group by term, docs),
s as (select item_id, rid, sum(df.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::bigint as score
  from q join tf using (term) join df using (term) join sized using (rid) cross join total group by all)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id nulls last))::int as rank, doc_id, score from s join sized using (rid) where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id nulls last) <= 10
"""

#: All pairs of a query and a candidate. The search is approximate; it gives these rows where it misses none, as it should on a table of one shard.
NEAREST = """
with v as (select distinct vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
  where len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
q as (select vec_id as query_id, min(v) as q from v where vec_id % 100 = 0 group by vec_id),
pairs as (select distinct query_id, vec_id, sqrt(list_reduce(list_transform(range(1, len(q) + 1), lambda i: (v[i] - q[i]) * (v[i] - q[i])), lambda a, x: a + x)) as score
  from q join v on len(q) = len(v) and vec_id is distinct from query_id),
ranked as (select *, row_number() over (partition by query_id order by score, vec_id nulls last) as rank from pairs)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 10
"""
