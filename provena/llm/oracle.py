"""SQL for the operators that SQL can express, written from their contracts."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Hexadecimal stands for bytes: byte i is the two digits at 2 * i + 1.
SUFFIX_DEDUP = """
with docs as (select doc_id, row_number() over () as r, hex(encode(coalesce(text, ''))) as h from documents),
sized as (select *, length(h) // 2 as n from docs),
starts as (select r, unnest(generate_series(0, n - 400)) as s, h from sized where n >= 400),
hashed as (select r, s, md5_number(substr(h, 2 * s + 1, 800)) as k from starts),
again as (select r, s from hashed where k in (select k from hashed group by k having count(*) > 1)),
heads as (select r, s, case when s - lag(s) over (partition by r order by s) <= 400 then 0 else 1 end as new from again),
runs as (select r, s, sum(new) over (partition by r order by s) as g from heads),
spans as (select r, g, min(s) as a, max(s) + 400 as b from runs group by r, g),
gaps as (select r, a, coalesce(lag(b) over (partition by r order by a), 0) as last from spans),
parts as (select g.r, g.a, substr(h, 2 * last + 1, 2 * (a - last)) as part from gaps g join sized using (r)
  union all select s.r, 1e18, substr(h, 2 * max(b) + 1) from spans s join sized using (r) group by s.r, h),
kept as (select r, string_agg(part, '' order by a) as h from parts group by r),
total as (select r, sum(b - a) as removed, count(*) as spans from spans group by r)
select doc_id, n as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(coalesce(kept.h, sized.h))) as kept_sha256
from sized left join total using (r) left join kept using (r)
"""

_BASE32 = ", ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(((cast(concat('0x', substr(sha, {5 * g + 1}, 5)) as bigint) >> {s}) & 31) as int) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))
WARC = f"""
with rows as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as sha from pages),
firsts as (select sha, min(page_id) as first from rows group by sha)
select page_id, cast(strlen(html) as bigint) as payload_bytes,
  concat({_BASE32}) as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from rows join firsts using (sha)
"""

NEAR_DEDUP = f"""
with recursive docs as (select doc_id, {_WORDS.format(_FOLD)} as w from documents),
shingles as (select distinct doc_id, unnest(case when len(w) = 1 then [w[1]] else [concat(w[i], ' ', w[i + 1]) for i in range(1, len(w))] end) as s from docs where len(w) > 0),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as x, b.doc_id as y, count(*) as shared from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
linked as (select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * shared >= 80 * (p.n + q.n - shared)),
ways as (select x, y from linked union all select y, x from linked),
reach(doc_id, r) as (select doc_id, doc_id from docs union select reach.doc_id, ways.y from reach join ways on ways.x = reach.r),
least_of as (select doc_id, min(r) as component_id from reach group by doc_id)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from least_of left join sizes using (doc_id)
"""

PHRASE_DEDUP = f"""
with docs as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
windows as (select doc_id, unnest(generate_series(1, len(w) - 19)) as s, w from docs where len(w) >= 20),
hashed as (select doc_id, s, sha256(array_to_string(w[s:s + 19], ' ')) as k from windows),
later as (select doc_id, s from hashed qualify row_number() over (partition by k order by doc_id, s) > 1),
gone as (select distinct doc_id, unnest(generate_series(s, s + 19)) as i from later),
words as (select doc_id, unnest(generate_series(1, len(w))) as i, unnest(w) as word from docs),
kept as (select words.doc_id, count(gone.i) as n_removed, count(*) as n_words, string_agg(word, ' ' order by words.i) filter (gone.i is null) as t from words left join gone using (doc_id, i) group by words.doc_id)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from docs left join kept using (doc_id)
"""
