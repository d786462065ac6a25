"""SQL that queries of this subpackage are held against, where SQL can express them (DuckDB)."""

from emberway.llm.chat_format import BODY, CLOSE, ESCAPES, OPEN
from emberway.llm.queries import PROBE

WORDS = r"""regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"""
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def escaped(column: str) -> str:
    """The backslash comes first in ESCAPES; no other control string overlaps another one or an escape."""
    for control, code in ESCAPES.items():
        column = f"replace({column}, {quoted(control)}, {quoted(code)})"
    return column


OP1 = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', {quoted(PROBE)}), (-7, 1, 'assistant', {quoted(PROBE)})
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls last, role, text)) as turns_sha256,
  cast(sum(if(role = 'assistant', length(text), 0)) as bigint) as loss_chars,
  sha256(string_agg(if(role = 'assistant', text, ''), '' order by turn nulls last, role, text)) as loss_sha256,
  cast(sum({len(OPEN) + len(BODY) + len(CLOSE)} + length({escaped('role')}) + length({escaped('text')})) as bigint) as formatted_chars
from turns group by conv_id
"""

OP2 = """
with bodies as (select page_id, coalesce(html, '') as html from pages),
told as (select page_id, html, max(page_id) over (partition by html) as first_id from bodies),
bits as (
  select page_id, html, first_id, list_aggregate(list_transform(split(sha1(html), ''), lambda x: right(bin(cast('0x' || x as int)), 4).lpad(4, '0')), 'string_agg', '') as b
  from told
)
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + 16 * cast(b[5 * i + 1] as int) + 8 * cast(b[5 * i + 2] as int) + 4 * cast(b[5 * i + 3] as int) + 2 * cast(b[5 * i + 4] as int) + cast(b[5 * i + 5] as int) as bigint), 1)), 'string_agg', '') as payload_digest,
  if(page_id = first_id, 'response', 'revisit') as record_type, if(page_id = first_id, null, first_id) as refers_to, true as digest_ok
from bits
"""

OP3 = f"""
with recursive words as (select doc_id, {WORDS.format(LOWER)} as w from documents),
sets as (
  select doc_id, case when len(w) >= 5 then list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: md5_number_lower(array_to_string(w[i:i + 4], ' '))))) when len(w) > 0 then [md5_number_lower(array_to_string(w, ' '))] else [] end as s
  from words
),
distinct_sets as (select s, min(doc_id) as rep, len(s) as n, count(*) as copies from sets where len(s) > 0 group by s),
tokens as (select rep, n, unnest(s) as token from distinct_sets),
shared as (select a.rep as a, b.rep as b, count(*) as common, any_value(a.n) as an, any_value(b.n) as bn from tokens a join tokens b on a.token = b.token and a.rep < b.rep where 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by 1, 2),
links as (select a, b from shared where 100 * common >= 80 * (an + bn - common)),
arcs as (select a, b from links union all select b, a from links),
reach as (select rep as node, rep as seen from distinct_sets union select r.node, arcs.b from reach r join arcs on arcs.a = r.seen),
named as (select node, min(seen) as component_id from reach group by node),
near as (select arcs.a as rep, sum(copies) as n from arcs join distinct_sets d on d.rep = arcs.b group by arcs.a)
select sets.doc_id, len(sets.s) as n_shingles, coalesce(named.component_id, sets.doc_id) as component_id,
  cast(coalesce(d.copies - 1 + coalesce(near.n, 0), 0) as bigint) as n_links
from sets left join distinct_sets d on sets.s = d.s left join named on named.node = d.rep left join near on near.rep = d.rep
"""

OP5 = """
with levels as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as v from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scores as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score from levels q join levels c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
ranked as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from scores)
select * from ranked where rank <= 20
"""

OP8 = r"""
with texts as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as t from documents),
named as (
  select doc_id, sha256(t) as text_sha256, count(*) over (partition by t) as group_size,
    first_value(doc_id) over (partition by t order by n desc, doc_id) as keep_id from texts
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from named
"""

OP9 = f"""
with words as (select doc_id, {WORDS.format('text')} as w from documents),
windows as (select doc_id, i, md5_number_lower(array_to_string(w[i:i + 34], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from words)),
again as (select doc_id, i from (select doc_id, i, count(*) over (partition by h) as n from windows) where n > 1),
spans as (select doc_id, i, least(35, coalesce(lead(i) over (partition by doc_id order by i) - i, 35)) as n from again),
gone as (select doc_id, unnest(range(i, i + n)) as place from spans),
each as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as place from words),
kept as (select doc_id, string_agg(word, ' ' order by place) as kept, count(*) as n from each anti join gone using (doc_id, place) group by doc_id)
select words.doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from words left join kept using (doc_id)
"""

# crc32 bit by bit, then for every period the stretches of words that recur so many words on
OP11 = f"""
with raw as (select doc_id, {WORDS.format('text')} as w,
  xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(cast(doc_id as varchar)) + 1), lambda i: cast(ord(cast(doc_id as varchar)[i]) as bigint))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: if(x % 2 = 1, xor(x // 2, 3988292384), x // 2))), 4294967295) as h from documents),
bent as (select doc_id, w, len(w) as n, if(h % 10 = 0 and len(w) > 0, (h // 10) % len(w), null) as a, h // 10 as g from raw),
docs as (select doc_id, n, if(a is null, w, list_transform(range(n), lambda i: w[1 + if(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))])) as w from bent),
words as (select doc_id, n, unnest(w) as word, unnest(range(n)) as i from docs),
pairs as (select x.doc_id, x.i, y.i - x.i as q from words x join words y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i and 4 * (y.i - x.i) <= x.n),
streaks as (select doc_id, q, min(i) as start, max(i) + q - min(i) + 1 as length from (select *, i - row_number() over (partition by doc_id, q order by i) as island from pairs) group by doc_id, q, island having max(i) + q - min(i) + 1 >= greatest(6, 4 * q)),
runs as (select doc_id, start, length, min(q) as period from streaks group by doc_id, start, length),
best as (select doc_id, count(*) as n_runs, arg_min({{'s': start, 'l': length, 'p': period}}, {{'e': -(length * 1000000000000 // period), 's': start, 'p': period}}) as b,
  sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period)) as runs_sha256 from runs group by doc_id),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from runs),
kept as (select doc_id, string_agg(word, ' ' order by i) as kept, count(*) as n from words anti join gone using (doc_id, i) group by doc_id)
select docs.doc_id, coalesce(n_runs, 0) as n_runs, b.s as start, b.l as length, b.p as period, 1000 * b.l // b.p as exponent_milli,
  coalesce(runs_sha256, sha256('')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256, docs.n - coalesce(kept.n, 0) as n_dropped
from docs left join best using (doc_id) left join kept using (doc_id)
"""

OP12 = rf"""
with tokens as (select doc_id, unnest(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
asked as (select distinct item_id, unnest(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
sizes as (select doc_id, count(*) as n from tokens group by doc_id),
whole as (select cast(count(*) as bigint) as docs, cast(sum(n) as bigint) as terms from sizes),
held as (select doc_id, term, count(*) as tf from tokens where term in (select term from asked) group by doc_id, term),
weights as (select term, cast(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) as bigint) as w from held, whole group by term),
scores as (
  select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) as bigint) as score
  from asked join held using (term) join weights using (term) join sizes using (doc_id), whole group by item_id, doc_id
),
ranked as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from scores where score > 0)
select * from ranked where rank <= 50
"""

# without SQL: a trained model (4), merges (6, 13), layout (7) and hashed draws (10); tests hold them against plain versions
ORACLES: dict[str, str] = {"op1_chat_format": OP1, "op2_warc": OP2, "op3_jaccard_join": OP3, "op5_exact_top_k": OP5, "op8_exact_dedup": OP8, "op9_substring_dedup": OP9, "op11_periodic_runs": OP11, "op12_lexical_search": OP12}
