"""The same results in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

from .licenses import COPYRIGHT_LINE, KNOWN, PUNCTUATION, SPELLINGS
from .quality import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _squeezed(text: str) -> str:
    plain = f"regexp_replace(lower({text}), {_quoted(COPYRIGHT_LINE)}, chr(10), 'g')"
    return f"regexp_replace({plain}, {_quoted(PUNCTUATION)}, ' ', 'g')"


def _spelled(text: str) -> str:
    text = f"regexp_replace({text}, '[ \\n]+', ' ', 'g')"
    for word, same in SPELLINGS:
        text = f"regexp_replace({text}, '\\b{word}\\b', '{same}', 'g')"
    return f"trim({text})"


_KNOWN = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in KNOWN)


def _codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Product quantisation, a round after the other; ids are unique in the given tables."""
    near = """select c.vec_id, c.part, arg_min(b.entry, {far} * 1000 + b.entry) as entry, min({far}) as far
  from cut c join book{k} b on b.part = c.part group by c.vec_id, c.part"""
    far = "list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for k in range(rounds):
        steps.append(f"""near{k} as (
  {near.format(far=far, k=k)}
), total{k} as (
  select part, entry, place, sum(c) as s, count(*) as n
  from (select n.part, n.entry, unnest(range(len(c.v))) as place, unnest(c.v) as c
    from near{k} n join cut c on c.vec_id = n.vec_id and c.part = n.part) x
  group by part, entry, place
), book{k + 1} as (
  select b.part, b.entry, coalesce(t.v, b.v) as v from book{k} b left join (
    select part, entry, list(cast((s - ((s % n) + n) % n) // n as bigint) order by place) as v
    from total{k} group by part, entry) t on t.part = b.part and t.entry = b.entry
)""")
    return f"""
with kept as (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), cut as (
  select vec_id, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] as v
  from kept, (select unnest(range({parts})) as part) p
), book0 as (
  select part, entry, v from cut
  join (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept) f using (vec_id)
  where entry < {entries}
), {", ".join(steps)}, near as (
  {near.format(far=far, k=rounds)}
), coded as (
  select vec_id, string_agg(format('{{:02x}}', entry), '' order by part) as code,
    cast(sum(far) as bigint) as error from near group by vec_id
)
select c.vec_id, code, error,
  cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(cast(c as varchar), ',' order by part, entry, place)) from (
    select part, entry, unnest(range(len(v))) as place, unnest(v) as c from book{rounds}) x) as codebooks_sha256
from coded c join kept k on k.vec_id = c.vec_id
"""


SQL: dict[str, str] = {
    "op12_vector_codes": _codes(),
    "op5_quality_rules": rf"""
with d as (
  select doc_id, coalesce(text, '') as t from documents
), w as (
  select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls
  from d
), pos as (
  select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8
), twice as (
  select doc_id, unnest(list(i)) as i from (
    select doc_id, i, array_to_string(ws[i:i + 7], ' ') as win from pos) x
  group by doc_id, win having count(*) > 1
), covered as (
  select doc_id, count(distinct i + k) as n
  from twice, (select unnest(range(0, 8)) as k) o group by doc_id
), m as (
  select w.doc_id, len(ws) as n_words,
    length(array_to_string(ws, '')) as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines,
    coalesce(c.n, 0) as n_repeat_words,
    len(list_filter(ws, lambda x: lower(regexp_replace(x, '[.,;:!?]', '', 'g')) in ({_STOP}))) as n_stop_words,
    len(list_filter(ls, lambda l: regexp_matches(l, '^ *[-*•]'))) as n_bullet_lines,
    len(list_filter(ls, lambda l: regexp_matches(l, '(\.\.\.|…) *$'))) as n_cut_lines
  from w left join covered c on c.doc_id = w.doc_id
), b as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m
)
select *, not base_failed
  and 100 * word_chars between 200 * n_words and 1500 * n_words
  and 100 * n_symbols <= 50 * n_words
  and 100 * n_stop_words >= 2 * n_words
  and 100 * n_dup_lines <= 50 * n_lines
  and 100 * n_bullet_lines <= 90 * n_lines
  and 100 * n_cut_lines <= 30 * n_lines as kept
from b
""",
    "op8_decontamination": r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark
), ln as (
  select distinct least(10, len(ws)) as n from b where len(ws) > 0
), win as (
  select distinct item_id, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') as win,
    least(10, len(ws)) as n
  from (select *, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as i from b where len(ws) > 0) x
), pos as (
  select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, ln where len(ws) >= n
), hit as (
  select p.doc_id, p.i, p.n, w.item_id
  from (select doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') as win from pos) p
  join win w on w.win = p.win and w.n = p.n
), cov as (
  select doc_id, count(distinct k) as n_hit
  from (select doc_id, unnest(range(i, i + n)) as k from hit) x group by doc_id
), its as (
  select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256
  from (select distinct doc_id, cast(item_id as varchar) as item from hit) x group by doc_id
)
select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit,
  coalesce(n_items, 0) as n_items, coalesce(items_sha256, sha256('')) as items_sha256,
  n_hit is not null as contaminated
from d left join cov on cov.doc_id = d.doc_id left join its on its.doc_id = d.doc_id
""",
    "op3_license_scan": f"""
with known as (
  select sha256({_spelled(_squeezed("text"))}) as digest, min(license) as license
  from (values {_KNOWN}) k(license, text) group by 1
), d as (
  select doc_id, {_squeezed("coalesce(text, '')")} as s from documents
), unit as (
  select doc_id, true as entire, 0 as place, s from d
  union all
  select doc_id, false, unnest(range(len(string_split(s, chr(10))))), unnest(string_split(s, chr(10))) from d
), hit as (
  select doc_id, entire, place, license
  from (select doc_id, entire, place, sha256({_spelled("s")}) as digest from unit where length(s) < 10000) u
  join known on known.digest = u.digest
), found as (
  select doc_id, min(case when entire then license end) as license,
    count(distinct place) filter (not entire) as n,
    string_agg(distinct license, ',' order by license) filter (not entire) as names
  from hit group by doc_id
)
select d.doc_id, license, coalesce(n, 0) as n_license_lines, coalesce(names, '') as line_licenses
from d left join found f on f.doc_id = d.doc_id
""",
}
