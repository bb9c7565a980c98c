"""SQL for the queries that SQL can express; the names match the queries' columns."""

from trajlake.llm.mixing import EPOCHS, LEVELS, SEED, WEIGHTS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

NEAR_DUPLICATES = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents)
, s as (select distinct doc_id, case when len(w) = 1 then w[1] else w[i] || ' ' || w[i + 1] end as g from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 1, 1))) as i from d where len(w) > 0))
, n as (select doc_id, count(*) as n from s group by doc_id)
, p as (select a.doc_id as a, b.doc_id as b, count(*) as m from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2)
, l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * m >= 80 * (x.n + y.n - m))
, e as (select a, b from l union all select b, a from l)
, r(id, root) as (select doc_id, doc_id from documents union select r.id, e.b from r join e on e.a = r.root)
, c as (select id, min(root) as component_id from r group by id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, c.component_id = d.doc_id as kept from d left join n using (doc_id) join c on c.id = d.doc_id
"""


def _weight(level: str) -> str:
    listed = WEIGHTS[level]
    return "case " + " ".join(f"when {level} = '{v}' then {w}e0" for v, w in listed.items()) + " else 1.0e0 end" if listed else "1.0e0"


def _mixing() -> str:
    """One step per level of the tree: capacities by weight in order, the level that spends the rest, the budgets."""
    steps, given = [], "leaf0"
    for depth, level in enumerate(LEVELS):
        node, parent = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth]) or "1"
        steps.append(f"""h{depth} as (select {node}, sum(cap) as cap, {_weight(level)} as weight, any_value(total) as total from {given} group by {node})
, q{depth} as (select *, cap / weight as ratio, (total - coalesce(sum(cap) over (partition by {parent} order by cap / weight, {node} rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (partition by {parent} order by cap / weight, {node} rows between current row and unbounded following) as level from h{depth})
, z{depth} as (select *, arg_min(level, ratio) filter (level < ratio) over (partition by {parent}) as stop from q{depth})
, leaf{depth + 1} as (select l.* replace (greatest(case when z.stop is null or z.ratio <= z.stop then z.cap else z.stop * z.weight end, 0) as total) from {given} l join z{depth} z using ({node}))""")
        given = f"leaf{depth + 1}"
    return rf"""
with t as (select doc_id, ['web', 'books', 'code'][1 + coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})', 1), '') as int), 0) % 3] as domain, lang, source, cast(len({_WORDS}) as bigint) as tokens from documents)
, k as (select * from t where tokens > 0)
, u as (select domain, lang, source, cast(sum(tokens) as bigint) as tokens, count(*) as docs from k group by all)
, leaf0 as (select *, cast(tokens * {EPOCHS} as double) as cap, cast(sum(tokens) over () as double) as total from u)
, {', '.join(steps)}
, b as (select domain, lang, source, cast(floor(total / tokens) as bigint) as whole, total - floor(total / tokens) * tokens as rest from {given})
, o as (select k.*, whole, rest, ('0x' || substr(md5(concat_ws(':', '{SEED}', whole, doc_id)), 1, 15))::bigint as place from k join b using (domain, lang, source))
, f as (select *, sum(tokens) over (partition by domain, lang, source order by place) - tokens < rest as more from o)
select doc_id, domain, lang, source, tokens, cast(whole + case when more then 1 else 0 end as int) as copies from f where whole > 0 or more
"""


MIXING = _mixing()


_CONTROL = r"<\\*/?s>|\[\\*/?(INST|ROLE)\]"

CHAT = rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]')
, m as (select *, length(text) + len(regexp_extract_all(text, '{_CONTROL}')) as said from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
    cast(3 + sum(said + case role when 'user' then 15 when 'assistant' then 6 else 16 + length(replace(replace(role, '\', '\\'), chr(10), '\n')) end) as bigint) as formatted_chars
from m group by conv_id
"""


# CRC-32 from its polynomial: a table by eight shifts a byte, then one look-up for each byte of the text.
SPELLING_VARIANTS = r"""
with recursive bits(i, k, v) as (select i, 0, i::bigint from range(256) t(i) union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8)
, tab as (select list(v order by i) as t from bits where k = 8)
, runs as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run from documents)
, counted as (select doc_id, run, count(*) as c from runs where length(run) >= 5 group by all)
, coded as (select *, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as x from counted)
, bytes as (select doc_id, run, c, list_transform(range(0, length(x) // 2), lambda k: 16 * (strpos('0123456789ABCDEF', substr(x, 2 * k + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(x, 2 * k + 2, 1)) - 1) as b from coded)
, hashed as (select run, c, xor(list_reduce(b, lambda a, y: xor(a >> 8, t[1 + (xor(a, y) & 255)]), 4294967295::bigint), 4294967295) as h from bytes, tab)
, spelled as (select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, 2 + h % length(run)) else run end as word, c from hashed)
, w as (select word, sum(c)::bigint as n from spelled where length(word) >= 5 group by word having sum(c) >= 3)
, cut as (select word, i, substr(word, 1, i - 1) as head, substr(word, i + 1) as tail from (select word, unnest(range(1, length(word) + 1)) as i from w))
, pairs as (
  select a.word, b.word as near from cut a join cut b on a.i = b.i and a.head = b.head and a.tail = b.tail and a.word <> b.word
  union select c.word, w.word from cut c join w on w.word = c.head || c.tail
  union select w.word, c.word from cut c join w on w.word = c.head || c.tail)
, ranked as (select p.word, p.near, w.n, count(*) over (partition by p.word) as n_near, row_number() over (partition by p.word order by w.n desc, p.near) as place from pairs p join w on w.word = p.near)
, known as (select w.word, w.n, coalesce(r.n_near, 0) as n_near, case when r.n >= 2 * w.n then r.near end as form, case when r.n >= 2 * w.n then r.n end as form_n from w left join ranked r on r.word = w.word and r.place = 1)
, walk(word, here) as (select word, word from known union all select k.word, f.form from walk k join known f on f.word = k.here where f.form is not null)
, ends as (select walk.word, walk.here as root from walk join known f on f.word = walk.here where f.form is null)
select k.word, k.form, e.root, k.n, k.n_near, k.form_n from known k join ends e on e.word = k.word
"""

# The given pages have one article each; its inline tags are b and br, its entities these four, one of them cut short.
HTML_EXTRACTION = r"""
with a as (select page_id, url, string_split_regex(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(b|br)>', ' ', 'g'), '<[^>]*>') as parts from pages)
, d as (select page_id, url, list_transform(parts, lambda x: replace(replace(replace(replace(regexp_replace(x, '&amp$', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) as parts from a)
, t as (select page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) as text from d)
select page_id, url, text, length(text) as n_chars from t
"""
