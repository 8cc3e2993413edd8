"""SQL that says the same as a numbered operator's query, where SQL can."""

from __future__ import annotations

#: Lines are cut, stripped and folded as the operator does; translate changes A-Z alone.
LINE_DEDUP = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i
  from documents),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines),
gone as (select k from keyed where length(k) >= 1 group by k having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (where k in (select k from gone)) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where k not in (select k from gone)), '')) as kept_sha256
from keyed group by doc_id
"""

#: Every group meets every kept term of its language; hugeint arithmetic, so nothing is rounded.
DIVERGENCE = r"""
with docs as (
  select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents),
said as (select rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as (select lang, term, count(*) as n from said group by lang, term having count(distinct rid) >= 30),
langs as (select lang, count(*) as v, sum(n) as total from kept group by lang),
groups as (select distinct lang, source from docs),
counts as (select lang, source, term, count(*) as n from said group by lang, source, term),
full_counts as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, k.n as lang_n
  from groups g join kept k on g.lang = k.lang
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
sized as (select *, sum(n) over (partition by lang, source) as total from full_counts),
p as (
  select s.lang, s.source, s.term, s.n,
         1 + (1000000000::hugeint * (s.n + 5)) // (s.total + 5 * l.v)::hugeint as p,
         1 + (1000000000::hugeint * (s.lang_n + 5)) // (l.total + 5 * l.v)::hugeint as q
  from sized s join langs l on s.lang = l.lang),
pairs as (
  select g.lang, g.source, h.source as item, coalesce(d.value, 0)::bigint as value
  from groups g join groups h on g.lang = h.lang and g.source <> h.source
  left join (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
             from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all) d
    on d.lang = g.lang and d.source = g.source and d.item = h.source),
terms as (select lang, source, term as item, (p - q)::bigint as value from p where n > 0 and p > q),
parts as (
  select lang, source, 'pair' as part, item, value from pairs
  union all select lang, source, 'term', item, value from terms)
select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
from parts qualify part = 'pair' or rank <= 50
"""

#: Windows are compared as texts; the thresholds are written out once more.
QUALITY_RULES = r"""
with docs as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
cut as (
  select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
         [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as lines
  from docs),
windows as (
  select rid, i, array_to_string(words[i:i + 4], ' ') as g
  from (select rid, words, unnest(range(1, greatest(len(words) - 3, 1))) as i from cut)),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as k from windows) where k > 1),
covered as (
  select rid, sum(c) as n from (
    select rid, least(5, coalesce(lead(i) over (partition by rid order by i) - i, 5)) as c from twice) group by rid),
m as (
  select doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols,
         len([w for w in words if lower(trim(w, '.,;:!?"''()')) in (
           'the', 'and', 'of', 'to', 'a', 'in', 'is', 'that', 'it', 'was', 'for', 'on', 'with', 'as', 'be', 'by', 'are',
           'this', 'at', 'from', 'de', 'la', 'et', 'le', 'les', 'des', 'en', 'du', 'un', 'une', 'que', 'pour', 'est',
           'qui', 'dans', 'par', 'sur', 'pas', 'avec', 'au', 'der', 'die', 'und', 'den', 'von', 'das', 'zu', 'mit',
           'sich', 'für', 'nicht', 'auf', 'ist', 'dem', 'im', 'ein', 'eine', 'als', 'el', 'las', 'y', 'los', 'se',
           'del', 'no', 'con', 'por', 'para', 'su', 'al', 'lo', 'como', 'más')]) as n_stop,
         len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines,
         len([x for x in lines if regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]')]) as n_bullet,
         len([x for x in lines if regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')]) as n_cut,
         coalesce(c.n, 0) as n_repeat_words
  from cut left join covered c using (rid)),
judged as (
  select *, n_words < 10 as few, 100 * n_repeat_words > 20 * n_words as rep, 100 * word_chars < 200 * n_words as short,
         100 * word_chars > 1400 * n_words as long, 100 * n_symbols > 10 * n_words as sym,
         100 * n_stop < n_words and n_words >= 100 as stop, 100 * n_dup_lines > 40 * n_lines as dup,
         100 * n_bullet > 90 * n_lines and n_words >= 50 as bul, 100 * n_cut > 30 * n_lines and n_words >= 50 as cutl
  from m)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, few or rep as base_failed,
       not (few or rep or short or long or sym or stop or dup or bul or cutl) as kept,
       concat_ws(',', case when few then 'few_words' end, case when rep then 'repeated_words' end,
         case when short then 'short_words' end, case when long then 'long_words' end, case when sym then 'symbols' end,
         case when stop then 'few_stop_words' end, case when dup then 'repeated_lines' end,
         case when bul then 'bullet_lines' end, case when cutl then 'cut_lines' end) as failed
from judged
"""


def _levels(tree: str, per: str, levels: int) -> str:
    """{tree}0 has the leaves (i, d); each level's nodes with their siblings, and the level above, while a tree has more than one."""
    each, also = (f"partition by {per}", f"{per}, ") if per else ("", "")
    run = f"partition by {also}i // 3 order by i rows between"
    return ",".join(
        f"""
{tree}{k}s as materialized (
  select *, count(*) over ({each}) as size,
         coalesce(string_agg(d, '') over ({run} unbounded preceding and 1 preceding), '') as l,
         coalesce(string_agg(d, '') over ({run} 1 following and unbounded following), '') as r
  from {tree}{k}),
{tree}{k + 1} as (select {also}i // 3 as i, sha256(string_agg(d, '' order by i)) as d from {tree}{k}s where size > 1 group by {also}i // 3)"""
        for k in range(levels)
    )


def _climb(start: str, tree: str, per: str, levels: int) -> str:
    """The leaves of {start} go up level by level: siblings so far, and the leaf folded with them."""
    same = f"t.{per} = x.{per} and " if per else ""
    return ",".join(
        f"""
{tree}{k}f as (
  select x.* replace (x.sib || coalesce(t.l || t.r, '') as sib, case when t.size > 1 then sha256(t.l || x.fold || t.r) else x.fold end as fold)
  from {f"{tree}{k - 1}f" if k else start} x left join {tree}{k}s t on {same}t.i = x.{tree}_i // {3**k})"""
        for k in range(levels)
    )


def merkle(levels: int = 12, top_levels: int = 6) -> str:
    """Levels written out: enough for 3^11 documents of a source and 3^5 sources."""
    return f"""
with fields as (
  select doc_id, coalesce('=' || source, '') as src,
         array_to_string([coalesce(strlen(v)::varchar || ':' || v, '-') for v in [doc_id::varchar, source, lang, n_chars::varchar]], '') as f,
         text, replace(text, chr(10), '') as cut,
         flatten([[ord(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(doc_id::varchar, '')]) as steps
  from documents),
leaves as materialized (
  select doc_id, src, sha256(f || coalesce(strlen(text)::varchar || ':' || text, '-')) as leaf,
         sha256(f || coalesce(strlen(cut)::varchar || ':' || cut, '-')) as bad,
         (list_reduce(steps, lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end,
                      4294967295::bigint) & 1) = 1 as altered
  from fields),
ranked as materialized (
  select *, row_number() over (partition by src order by doc_id nulls first, leaf) - 1 as i from leaves),
a0 as (select src, i, leaf as d from ranked),{_levels("a", "src", levels)},
subroots as materialized (
  select src, d, row_number() over (order by src) - 1 as i from ({" union all ".join(f"select src, d from a{k}s where size = 1" for k in range(levels))})),
b0 as (select i, d from subroots),{_levels("b", "", top_levels)},
root as ({" union all ".join(f"select d from b{k}s where size = 1" for k in range(top_levels))}),
start as (
  select x.doc_id, x.leaf, x.src, x.i as a_i, s.i as b_i, s.d as subroot, '' as sib, case when altered then bad else leaf end as fold
  from ranked x join subroots s on s.src = x.src),{_climb("start", "a", "src", levels)},{_climb(f"a{levels - 1}f", "b", "", top_levels)}
select x.doc_id, x.leaf, x.subroot, root.d as root, sha256(x.sib) as proof_sha256, x.fold as folded_root, x.fold = root.d as verified
from b{top_levels - 1}f x cross join root
"""


MERKLE = merkle()
