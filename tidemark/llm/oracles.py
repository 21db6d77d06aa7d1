"""DuckDB counterparts of the corpus queries that SQL can express."""

from __future__ import annotations


ORACLES: dict[str, str] = {}


ORACLES["op2_ngram_jaccard_join"] = r"""
with recursive words as (
    select doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
    from documents
), sets as (
    select doc_id, list_distinct(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                      when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as grams
    from words
), grams as materialized (
    select doc_id, unnest(grams) as gram from sets
), common as (
    select a.doc_id as a, b.doc_id as b, count(*) as common
    from grams as a join grams as b on a.gram = b.gram and a.doc_id <> b.doc_id
    group by all
), links as materialized (
    select a, b from common join sets as s on s.doc_id = a join sets as t on t.doc_id = b
    where 100 * common >= 85 * (len(s.grams) + len(t.grams) - common)
), reached as (
    select doc_id, doc_id as other from sets
    union
    select doc_id, b from reached join links on other = a
)
select doc_id, any_value(len(grams)) as n_shingles, min(other) as component_id
from sets join reached using (doc_id)
group by doc_id
"""


ORACLES["op9_warc"] = """
with payloads as (
    select page_id, encode(coalesce(html, '')) as payload from pages
), sized as (
    select page_id, octet_length(payload) as payload_bytes, sha256(payload) as payload_digest from payloads
), first as (
    select *, min(page_id) over (partition by payload_digest) as first_id from sized
)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
from first
"""

ORACLES["op7_quality_rules"] = (
    r"""
with words as (
    select doc_id, lang, coalesce(text, '') as t,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
    from documents
), seen as (
    select lang, word, count(*) as n from (select lang, unnest(list_distinct(list_transform(w, lambda x: lower(x)))) as word from words)
    where lang is not null group by all
), learned as (
    select lang, list(word order by n desc, word)[1:26] as listed
    from seen join (select lang, count(*) as documents from words where len(w) > 0 group by lang) using (lang)
    where n > 1 and 100 * n >= 20 * documents group by lang
), windows as (
    select doc_id, unnest(range(1, len(w) - 3)) as i, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) as g
    from words
), repeated as (
    select doc_id, count(distinct p) as n_repeat_words
    from (select doc_id, unnest(range(i, i + 5)) as p from (select doc_id, i, count(*) over (partition by doc_id, g) as n from windows) where n > 1)
    group by doc_id
), lines as (
    select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from words
), base as materialized (
    select doc_id, lang, t, w, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
           length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines,
           coalesce(n_repeat_words, 0) as n_repeat_words
    from words join lines using (doc_id) left join repeated using (doc_id)
), judged as (
    select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, list_transform(w, lambda x: lower(x)) as lw,
           listed
    from base left join learned using (lang)
), stripped as (
    select doc_id, t, r1, r2, r3, r4, r5, regexp_replace(r5, '[.,;:!?''"()-]+', '', 'g') as r6
    from (select *, regexp_replace(r4, '\p{N}+', '', 'g') as r5
    from (select *, regexp_replace(r3, '[\p{L}\p{M}]+', '', 'g') as r4
    from (select *, regexp_replace(r2, '[A-Z]+', '', 'g') as r3
    from (select *, regexp_replace(r1, '[ \t\n\x0B\f\r]+', '', 'g') as r2
    from (select doc_id, t, regexp_replace(t, '[a-z]+', '', 'g') as r1 from base)))))
), counted as (
    select doc_id, lang, base_failed, list_transform(coalesce(listed, []), lambda c: len(list_filter(lw, lambda x: x = c))) as common, n_words
    from judged
), histograms as (
    select doc_id, 'class' as kind, list_transform(
        [length(t) - length(r1), length(r1) - length(r2), length(r2) - length(r3), length(r3) - length(r4),
         length(r4) - length(r5), length(r5) - length(r6), length(r6)], lambda x: cast(x as double)) as h
    from stripped
    union all
    select doc_id, 'word', case when len(common) = 0 then [0.0] else
           list_transform(list_append(common, n_words - list_sum(common)), lambda x: cast(x as double)) end
    from counted
), cells as (
    select doc_id, lang, base_failed, kind, unnest(h) as v, generate_subscripts(h, 1) as k, list_sum(h) as total
    from histograms join counted using (doc_id)
), reference as (
    select lang, kind, k, sum(v) as v from cells where not base_failed group by all
), shares as (
    select lang, kind, k, v / nullif(sum(v) over (partition by lang, kind), 0) as q from reference
), terms as (
    select doc_id, cells.kind, total, v / nullif(total, 0) as p, q
    from cells left join shares on cells.lang is not distinct from shares.lang and cells.kind = shares.kind and cells.k = shares.k
), distances as (
    select doc_id, kind, any_value(total) as total, case when count(p) = count(*) and count(q) = count(*) then sqrt(greatest(0, round(sum(
        (case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end) / 2), 12))) end as d
    from terms group by doc_id, kind
), farthest as (
    -- Of a text without any listed word, whose words are all in the last cell.
    select lang, sqrt(greatest(0, round(sum(case when k < top then q / 2 else
        (log2(2 / (1 + q)) + case when q > 0 then q * log2(2 * q / (1 + q)) else 0 end) / 2 end), 12))) as most
    from (select lang, k, q, max(k) over (partition by lang) as top from shares where kind = 'word') group by lang
), far as (
    select doc_id, bool_or(case when kind = 'class' then total >= 200 and d > 0.2 + 3 / sqrt(total)
                                else total >= 50 and d > least(0.12 + 2 / sqrt(total), 0.97 * most) end) as far
    from distances join judged using (doc_id) left join farthest on farthest.lang is not distinct from judged.lang group by doc_id
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce(far, false) as kept
from judged join far using (doc_id)
"""
)


# Every filter order by itself, over counts of the sets of filters that texts fail.
ORACLES["op13_filter_audit"] = r"""
with texts as (
    select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
           coalesce(doc_id > min(doc_id) over (partition by coalesce(text, '')), false) as e
    from documents
), marked as (
    select part, list_filter([
               case when len(w) < 50 then 'A' end,
               case when 100 * len(list_distinct(w)) < 65 * len(w) then 'B' end,
               case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) then 'C' end,
               case when regexp_matches(t, '[#$%&*|]') then 'D' end,
               case when e then 'E' end], lambda x: x is not null) as fails,
           doc_id in (select doc_id from labels where quality = 1 and doc_id is not null) as good,
           doc_id in (select doc_id from labels where toxic = 1 and doc_id is not null) as toxic
    from texts
), kinds as (
    select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from marked group by all
), letters as (
    select unnest(['A', 'B', 'C', 'D', 'E']) as f
), orders as (
    select a.f || b.f || c.f || d.f || e.f as filter_order from letters a, letters b, letters c, letters d, letters e
    where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps as (
    select filter_order, step, filter_order[step:step] as f, string_split(filter_order[1:step - 1], '') as before
    from orders, range(1, 6) as r(step)
), audit as (
    select part, filter_order, step, f,
           sum(case when list_has_any(fails, list_append(before, f)) then 0 else n end) as kept,
           sum(case when list_contains(fails, f) and not list_has_any(fails, before) then n else 0 end) as removed,
           sum(case when list_contains(fails, f) and list_has_any(fails, before) then n else 0 end) as redundant,
           sum(case when fails = [f] then n else 0 end) as unique_fails,
           sum(case when list_contains(fails, f) and not list_has_any(fails, before) then good else 0 end) as good_lost,
           sum(case when list_contains(fails, f) and not list_has_any(fails, before) then toxic else 0 end) as toxic_lost
    from kinds, steps group by all
)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
       cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
       cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) as shapley
from audit
"""

# The repair one row at a time: cost and audit of the four states of a dialogue.
ORACLES["op11_conversation_repair"] = r"""
with recursive keyed as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
           coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key
    from conversations
), fates as (
    select conv_id, turn, role, text, xor(4294967295, list_reduce(
        list_prepend(4294967295::bigint, list_transform(range(1, length(key) + 1), lambda i: ascii(key[i:i])::bigint)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
                                 lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))) % 20 as fate
    from keyed
), damaged as (
    select conv_id, turn, case when fate = 4 then 'user' else role end as role,
           case fate when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
    from fates, range(2) as copies(copy) where fate <> 0 and (copy = 0 or fate = 3)
), placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(octet_length(encode(role)) || ':' || role || text)) as k
    from damaged
), rows_ as materialized (
    select conv_id, turn, k, role, text, role[1:1] as initial,
           case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
                when row_number() over (partition by conv_id, role, text order by k) > 1 then 'duplicate'
                when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' else '' end as fault,
           lag(role[1:1]) over (partition by conv_id order by k) as earlier
    from placed
), costs as (
    select *, fault in ('', 'truncated') as keeps, case when fault = 'truncated' then 1 else 0 end as extra from rows_
), dp as (
    select conv_id, 0::bigint as k, {'c': 0, 'a': ''} as o, {'c': 1000000, 'a': ''} as s, {'c': 1000000, 'a': ''} as u, {'c': 1000000, 'a': ''} as a
    from (select distinct conv_id from rows_)
    union all
    select conv_id, k,
           {'c': o.c + 3, 'a': o.a || 'D'},
           least({'c': s.c + 3, 'a': s.a || 'D'}, case when keeps and initial = 's' then {'c': o.c + extra, 'a': o.a || 'K'} else {'c': 2000000, 'a': ''} end),
           least({'c': u2.c + 3, 'a': u2.a || 'D'},
                 case when keeps then {'c': least(o, s, a2).c + extra + case when initial = 'u' then 0 else 2 end,
                                       'a': least(o, s, a2).a || case when initial = 'u' then 'K' else 'R' end} else {'c': 2000000, 'a': ''} end),
           least({'c': a2.c + 3, 'a': a2.a || 'D'},
                 case when keeps then {'c': u2.c + extra + case when initial = 'a' then 0 else 2 end,
                                       'a': u2.a || case when initial = 'a' then 'K' else 'R' end} else {'c': 2000000, 'a': ''} end)
    from (select d.conv_id, r.k, o, s, initial, keeps, extra,
                 least(u, {'c': o.c + 2, 'a': o.a || 'I'}, {'c': s.c + 2, 'a': s.a || 'I'}, {'c': a.c + 2, 'a': a.a || 'I'}) as u2,
                 least(a, {'c': u.c + 2, 'a': u.a || 'I'}, {'c': o.c + 4, 'a': o.a || 'II'}, {'c': s.c + 4, 'a': s.a || 'II'}) as a2
          from dp d join costs r on r.conv_id is not distinct from d.conv_id and r.k = d.k + 1)
), ends as (
    select conv_id, least(o, a, {'c': u.c + 2, 'a': u.a || 'I'}, {'c': s.c + 4, 'a': s.a || 'II'}) as best
    from dp qualify k = max(k) over (partition by conv_id)
), pieces as (
    -- The edits of every row: turns put in before it, and what becomes of it.
    select e.conv_id, r.k, r.role, r.text, best.a as audit, regexp_extract_all(best.a, 'I*[KRD]')[r.k] as edits
    from ends e join rows_ r on r.conv_id is not distinct from e.conv_id
), emitted as (
    select conv_id, k, i, case when edits[i:i] = 'I' then '' else text end as text, role, edits[i:i] as edit
    from pieces, range(1, 1000) as r(i) where i <= length(edits) and edits[i:i] <> 'D'
    union all
    select conv_id, 1000000000, i, '', '', 'I' from ends, range(1, 3) as r(i) where i <= length(best.a) - length(rtrim(best.a, 'I'))
), numbered as (
    select *, row_number() over w - max(case when edit = 'K' and role[1:1] = 's' then 1 else 0 end) over w as n
    from emitted window w as (partition by conv_id order by k, i rows unbounded preceding)
), repaired as (
    select conv_id, string_agg(case when edit = 'K' then role when n % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by k, i) as repaired
    from numbered group by conv_id
), counts as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
           count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
           count(*) filter (earlier is not null and earlier || initial not in ('su', 'ua', 'au')) as illegal
    from rows_ group by conv_id
)
select i.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(best.c, 0)::bigint as cost,
       coalesce(best.a, '') as audit, sha256(coalesce(repaired, '')) as repaired_sha256
from (select distinct conv_id from conversations) i
left join counts c on c.conv_id is not distinct from i.conv_id
left join ends e on e.conv_id is not distinct from i.conv_id
left join repaired r on r.conv_id is not distinct from i.conv_id
"""
