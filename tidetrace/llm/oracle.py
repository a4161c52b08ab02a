"""SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {}

ORACLE["op1_warc"] = """
with p as (select page_id, coalesce(html, '') as html from pages),
f as (select html, max(page_id) as first from p group by html),
b as (select page_id, first, strlen(html) as payload_bytes,
        array_to_string(list_transform(string_split(sha1(html), ''),
          lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111',
                      4 * (strpos('0123456789abcdef', c)::int - 1) + 1, 4)), '') as bits
      from p join f using (html))
select page_id, payload_bytes::bigint as payload_bytes,
  array_to_string(list_transform(range(32),
    lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                (16 * substr(bits, 5 * i + 1, 1)::int + 8 * substr(bits, 5 * i + 2, 1)::int + 4 * substr(bits, 5 * i + 3, 1)::int
                 + 2 * substr(bits, 5 * i + 4, 1)::int + substr(bits, 5 * i + 5, 1)::int + 1)::int, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id = first then null else first end as refers_to
from b
"""

ORACLE["op5_unit_dedup"] = r"""
with cut as (select doc_id, string_split(text, chr(10)) as lines from documents where text is not null),
l as (select doc_id, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as n from cut),
s as (select *, (sum(length(line) + 1) over (partition by doc_id order by n) - length(line) - 1)::bigint as start,
        regexp_extract_all(lower(line), '[^\s]+') as w from l),
u as (select doc_id, n, start, start + length(line) as "end", len(w) as words, array_to_string(w, ' ') as norm from s where len(w) > 0),
k as (select norm, count(*) as n_copies, min({'d': doc_id, 's': start}) as kept from u group by norm),
gone as (select doc_id, n, words, start, concat_ws(':', start, "end", n_copies, kept.d, kept.s) as span
         from u join k using (norm) where (doc_id, start) <> (kept.d, kept.s)),
spans as (select doc_id, count(*) as n_removed, sum(words)::bigint as words_removed, string_agg(span, ',' order by start) as spans
          from gone group by doc_id),
rest as (select s.doc_id, string_agg(case when gone.n is null then line else '' end, chr(10) order by s.n) as text
         from s left join gone on gone.doc_id = s.doc_id and gone.n = s.n group by s.doc_id)
select doc_id, coalesce(n_removed, 0)::bigint as n_removed, coalesce(words_removed, 0)::bigint as words_removed,
  coalesce(spans, '') as spans, rest.text
from documents left join spans using (doc_id) left join rest using (doc_id)
"""

ORACLE["op6_host_rules"] = rf"""
with t as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text, {_WORDS} as w from documents),
g as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
      from (select r, w, unnest(range(1, len(w) - 1)) as i from t where len(w) > 2)),
again as (select r, g from g group by r, g having count(*) > 1),
rep as (select r, count(distinct i + k) as n from (select r, i, unnest([0, 1, 2]) as k from g join again using (r, g)) group by r),
line as (select r, unnest(string_split(text, chr(10))) as line from t),
dup as (select r, sum(c - 1) as n from (select r, line, count(*) as c from line group by r, line)
        where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
s as (select doc_id, source, len(w)::bigint as n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
        coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words
      from t left join rep using (r) left join dup using (r)),
b as (select *, n_words < 50 as f1, 100 * n_repeat_words > 50 * n_words as f2, 2 * n_symbols > n_words as f3,
        word_chars > 20 * n_words as f4, 10 * n_dup_lines > n_words as f5 from s),
h as (select source, count(*) as n, [sum(f1::int), sum(f2::int), sum(f3::int), sum(f4::int), sum(f5::int)] as bad
      from b group by source),
x as (select source, n, k, bad[k] as bad, bad[k] / n as rate from (select *, unnest([1, 2, 3, 4, 5]) as k from h)),
m as (select k, least(greatest(avg(rate), 1e-6), 1 - 1e-6) as mean, coalesce(var_samp(rate), 0) as v, avg(1 / n) as per
      from x group by k),
z as (select k, mean, greatest(mean * (1 - mean) / least(greatest(v - mean * (1 - mean) * per, mean * (1 - mean) * 1e-4),
        mean * (1 - mean) * 0.9999) - 1, 1e-3) as size from m),
verdict as (select source, max((bad + mean * size) / (n + size)) > 0.5 as failed from x join z using (k) group by source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 or f2 as base_failed,
  not (f1 or f2) and not failed as kept
from b join verdict on b.source is not distinct from verdict.source
"""

ORACLE["op7_fair_queue"] = rf"""
with d as (select doc_id, source, len({_WORDS})::bigint as size from documents),
q as (select *, ('0x' || substr(md5(concat_ws(':', 7, doc_id, size)), 1, 12))::bigint as turn from d),
c as (select source, sum(size)::bigint as source_size,
        [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from d group by source),
cap as (select *, source_size * 3 as cap, sum(source_size) over () as budget from c),
lev as (select *, budget - coalesce(sum(cap) over f, 0) as rest, sum(weight) over () - coalesce(sum(weight) over f, 0) as share
        from cap window f as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
first as (select rest, share from lev where cap * share > rest * weight order by cap / weight, source nulls last limit 1),
tg as (select lev.source, source_size, lev.budget,
         case when first.rest is null or cap * first.share <= first.rest * weight then cap::double
              else first.rest::double * weight / first.share end as target
       from lev left join first on true),
w as (select q.*, source_size, target, budget,
        row_number() over o as place, sum(size) over (o rows between unbounded preceding and current row) as upto
      from q join tg on q.source is not distinct from tg.source
      window o as (partition by q.source order by turn, doc_id nulls first, size)),
p as (select *, case when target > 0 then ((pass - 1) * source_size + upto)::double / target else 0.0 end as finish
      from (select *, unnest([1, 2, 3]) as pass from w)),
z as (select *, sum(size) over (order by finish, coalesce('=' || source, ''), pass, place
                                rows between unbounded preceding and current row) as position from p)
select doc_id, size, source_size, target, sum(case when position <= budget then size else 0 end)::bigint as taken
from z group by source, place, doc_id, size, source_size, target
"""

ORACLE["op8_minhash"] = rf"""
with recursive d as (
  select doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w
  from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) >= 5
        then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
        else [array_to_string(w, ' ')] end)) as g from d where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
link as (select x, y from shared join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 75 * (a.n + b.n - c)),
edge as (select x, y from link union all select y, x from link),
reach(x, y) as (select x, y from edge union select r.x, e.y from reach r join edge e on r.y = e.x),
low as (select x, min(y) as y from reach group by x)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(low.y, d.doc_id)) as component_id,
  d.doc_id = least(d.doc_id, coalesce(low.y, d.doc_id)) as kept
from d left join n on n.doc_id = d.doc_id left join low on low.x = d.doc_id
"""
