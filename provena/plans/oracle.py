"""The queries once more as SQL for another engine, from the same tables.

Written from the rules, not from the Spark plans: parsing with ordinal unnesting and
windows, walks as one common table expression per level.
"""

from __future__ import annotations

from ..schema import CAUSE_RELATIONS, GENERIC_NAMES, HEADING_TAGS, KOREAN_RELATIONS, NEARBY_RELATIONS, STOP_TAILS, TEXT_TAGS, UNITS, WATCH_BREAKERS, WATCHED_NAMES
from .corpus import NOTES_SQL
from .queries import BUDGET, PATH, QUESTION


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(words) -> str:
    return "(" + ", ".join(_q(w) for w in words) + ")"


_HEAD = r"'^#{1,6}\s+.*\S\s*$'"
_TITLE = r"'^#{1,6}\s+(.*\S)\s*$'"
_ITEM = r"'^\s*[-*]\s+(.*\S)\s*$'"
_REL = r"'^\s*[-*]\s+([\p{L}][\p{L}\p{N}_]*)\s+\[\[([^\]|]+)(?:\|[^\]]*)?\]\]\s*$'"
_LINK = r"'\[\[([^\]|]+)(?:\|[^\]]*)?\]\]'"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_KOREAN = "case {0} " + " ".join(f"when {_q(k)} then {_q(v)}" for k, v in KOREAN_RELATIONS.items()) + " else {0} end"


def _lines(source: str, key: str, only: str = "true") -> str:
    """CTEs all_lines and lines (without front matter) of source(key, text), and stmts of the rows with `only`."""
    return f"""
all_lines as (select {key}, unnest(generate_series(1, len(a))) as line, unnest(a) as raw from (select {key}, string_split(text, chr(10)) as a from {source})),
fences as (select {key}, min(line) filter (line = 1 and {_STRIP.format('raw')} = '---') as op, min(line) filter (line > 1 and {_STRIP.format('raw')} = '---') as cl from all_lines group by {key}),
lines as (select a.{key}, a.line, a.raw, regexp_matches(a.raw, {_HEAD}) as head from all_lines a join fences f using ({key}) where f.op is null or a.line > f.cl),
body as (select {key}, line, raw, case when regexp_matches(raw, {_ITEM}) then regexp_extract(raw, {_ITEM}, 1) else {_STRIP.format('raw')} end as statement from lines where not head and {only}),
stmts as (select {key}, cast(row_number() over (partition by {key} order by line) - 1 as int) as idx, cast(line as int) as line, statement from body where statement <> '')"""


_MARKDOWN = "path like '%.md'"
_NOTES = f"notes as materialized ({NOTES_SQL}), src as (select rel_path as path, text from notes), " + _lines("src", "path", _MARKDOWN)
_MD = f"with {_NOTES}"

_SECTIONS = f"sects as (select path, cast(row_number() over (partition by path order by line) - 1 as int) as idx, cast(line as int) as line, regexp_extract(raw, {_TITLE}, 1) as title from lines where head and {_MARKDOWN})"
_LINKS = f"""
rels as (select path, line, 0 as n, {_STRIP.format(f'regexp_extract(raw, {_REL}, 2)')} as target, {_KOREAN.format(f'regexp_extract(raw, {_REL}, 1)')} as relation from lines where not head and {_MARKDOWN} and regexp_matches(raw, {_REL})),
ments as (select path, line, unnest(generate_series(1, len(a))) as n, {_STRIP.format('unnest(a)')} as target, cast(null as varchar) as relation from (select path, line, regexp_extract_all(raw, {_LINK}, 1) as a from lines where not head and {_MARKDOWN} and not regexp_matches(raw, {_REL}))),
lks as (select path, cast(row_number() over (partition by path order by line, n) - 1 as int) as idx, cast(line as int) as line, target, relation from (select * from rels union all select * from ments))"""
# HTML: runs of tokens between tracked start tags
_TOKEN = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|<[!?][^>]*>|</?[a-z](?:\"[^\"]*\"|'[^']*'|[^'\">])*>|[^<]+|<"
_HREF = r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
_TRACKED = _in(HEADING_TAGS + TEXT_TAGS)
_UNESCAPE = "replace(replace(replace(replace({0}, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;', '&')"
_href = "concat(" + ", ".join(f"coalesce(regexp_extract(tok, {_q(_HREF)}, {i}), '')" for i in (1, 2, 3)) + ")"


def _html(source: str, key: str) -> str:
    """CTEs marked (blocks) and hrefs (anchors) of source(key, html)."""
    return f"""toks as (select {key}, unnest(generate_series(1, len(a))) as pos, unnest(a) as tok from (select {key}, regexp_extract_all(html, {_q(_TOKEN)}) as a from {source})),
tags as (select {key}, pos, tok, lower(nullif(regexp_extract(tok, '^</?([A-Za-z][^\\s/>]*)', 1), '')) as tag, 1 + coalesce(sum(length(tok) - length(replace(tok, chr(10), ''))) over (partition by {key} order by pos rows between unbounded preceding and 1 preceding), 0) as line from toks),
sided as (select *, case when tag is null then case when regexp_matches(tok, '^<[!?]') then 'other' else 'text' end when tag in ('script', 'style') then 'other' when starts_with(tok, '</') then 'end' when ends_with(tok, '/>') then 'self' else 'start' end as side from tags),
grouped as (select *, sum(case when tag in {_TRACKED} and side in ('start', 'self') then 1 else 0 end) over (partition by {key} order by pos) as g from sided),
owned as (select *, first_value(tag) over (partition by {key}, g order by pos) as own from grouped where g > 0),
ended as (select {key}, g, min(pos) as fe from owned where (side = 'end' and tag = own) or (side = 'self' and tag in {_TRACKED}) group by {key}, g),
blocks0 as (select o.{key}, o.g, min(pos) as pos, min(line) as line, min(own) as tag, string_agg(tok, '' order by pos) filter (side = 'text' and pos < fe) as raw from owned o join ended using ({key}, g) group by o.{key}, o.g),
blocks as (select {key}, pos, cast(line as int) as line, tag, trim(regexp_replace({_UNESCAPE.format('raw')}, '\\s+', ' ', 'g')) as text from blocks0 where raw is not null),
marked as (select *, tag in {_in(HEADING_TAGS)} as head from blocks where text <> ''),
hrefs as (select {key}, pos, cast(line as int) as line, trim({_UNESCAPE.format(_href)}) as target from sided where tag = 'a' and side in ('start', 'self') and {_href} <> '')"""

_KEY = r"trim(regexp_replace(translate(lower(trim({0})), '/:\', '---'), '\s+', ' ', 'g'))"
_GRAPH = f"""{_MD}, {_SECTIONS}, {_LINKS},
web as (select rel_path as path, text as html from notes where rel_path like '%.html'), {_html('web', 'path')},
web_stmts as (select path, cast(row_number() over (partition by path order by pos) - 1 as int) as idx, line, text as statement from marked where not head),
web_sects as (select path, cast(row_number() over (partition by path order by pos) - 1 as int) as idx, line, text as title from marked where head),
web_lks as (select path, cast(row_number() over (partition by path order by pos) - 1 as int) as idx, line, target, cast(null as varchar) as relation from hrefs),
all_stmts as (select path, idx, line, statement from stmts union all select * from web_stmts),
all_sects as (select path, idx, line, title from sects union all select * from web_sects),
all_lks as (select path, idx, line, target, relation from lks union all select * from web_lks),
docs as (select src_ord, rel_path as path, regexp_replace(regexp_extract(rel_path, '([^/]+)$', 1), '\\.[^.]*$', '') as name from notes),
docs2 as (select *, {_KEY.format('name')} as key, concat('doc_', replace({_KEY.format('name')}, ' ', '_')) as doc_id from docs),
keys as (select key, arg_max(doc_id, (src_ord, path)) as to_doc from docs2 group by key),
res as (select l.path, l.idx, l.line, l.target, {_KEY.format('l.target')} as key, l.relation from all_lks l),
resolved as materialized (select r.path, d.doc_id, d.src_ord, r.idx, r.line, r.target, r.key, r.relation, coalesce(k.to_doc, concat('name_', replace(r.key, ' ', '_'))) as to_id, k.to_doc is not null as found from res r join docs2 d using (path) left join keys k on k.key = r.key),
nodes as materialized (
  select doc_id as id, name as label, 'document' as kind, path as source_file, cast(1 as int) as source_location, 0 as phase, src_ord, path as p, 0 as sub, 0 as i from docs2
  union all select concat(doc_id, '_s', idx), title, 'section', path, line, 1, src_ord, path, 0, idx from all_sects join docs2 using (path)
  union all select concat(doc_id, '_t', idx), statement, 'statement', path, line, 1, src_ord, path, 1, idx from all_stmts join docs2 using (path)
  union all select concat('name_', replace(key, ' ', '_')), arg_min(target, (src_ord, path, idx)), 'name_only', '', null, 1, min(src_ord), arg_min(path, (src_ord, path, idx)), 2, arg_min(idx, (src_ord, path, idx)) from resolved where not found group by key),
edges0 as materialized (
  select concat(doc_id, '_s', idx) as source, doc_id as target, 'part_of' as relation from all_sects join docs2 using (path)
  union all select concat(doc_id, '_t', idx), doc_id, 'part_of' from all_stmts join docs2 using (path)
  union all select doc_id, to_id, coalesce(relation, 'mentions') from resolved),
pairs as materialized (select distinct source, target from edges0 where relation <> 'mentions'),
links as materialized (select * from edges0 where relation <> 'mentions' union all select e.* from (select * from edges0 where relation = 'mentions') e anti join pairs using (source, target))"""

_NODE = "phase, src_ord, p, sub, i"

_NUM = r"(-?\d{1,3}(?:,\d{3})*(?:\.\d+)?|-?\d+(?:\.\d+)?)"
_UNIT = "(" + "|".join(UNITS) + ")"
_AFTER = "(?:[^A-Za-z0-9]|$)"
_VAL = rf"^((?:.*?[^\d.\-–])?){_NUM}\s*{_UNIT}{_AFTER}"
_PAIR = rf"([A-Za-z가-힣][A-Za-z0-9 _\-/()가-힣]{{1,38}}?)\s*[:=]\s*(-?\d+(?:\.\d+)?)\s*{_UNIT}{_AFTER}"
_SCALED = "round(cast(replace({n}, ',', '') as double) * case {u} when 'mm' then 0.001 when 'cm' then 0.01 when 'km' then 1000.0 when 'ms' then 0.001 else 1.0 end, 3)"
_BASE = "case when {u} in ('mm', 'cm', 'm', 'km') then 'm' when {u} in ('ms', 's') then 's' else {u} end"
_OBS = f"""{_GRAPH},
texts as (select label as text, coalesce(nullif(source_file, ''), '?') as file, coalesce(cast(source_location as varchar), '?') as line, id, {_NODE} from nodes),
named0 as (select *, lower(trim(regexp_replace(regexp_extract(text, {_q(_PAIR)}, 1), '\\s+', ' ', 'g'))) as name, regexp_extract(text, {_q(_PAIR)}, 2) as n, regexp_extract(text, {_q(_PAIR)}, 3) as u from texts where regexp_matches(text, {_q(_PAIR)})),
named as (select * from named0 where name not in {_in(GENERIC_NAMES)} and length(name) >= 2),
watch0 as (select t.*, w.name, substr(text, strpos(lower(text), w.name) + length(w.name), 22) as win from texts t, (select unnest([{', '.join(_q(n) for n in WATCHED_NAMES)}]) as name) w where strpos(lower(text), w.name) > 0),
watch1 as (select *, regexp_extract(win, {_q(_VAL)}, 1) as pre, regexp_extract(win, {_q(_VAL)}, 2) as n, regexp_extract(win, {_q(_VAL)}, 3) as u from watch0 where regexp_matches(win, {_q(_VAL)})),
watched as (select * from watch1 where length(pre) < 18 and not ({' or '.join(f"contains(pre, {_q(b)})" for b in WATCH_BREAKERS)})),
ctx0 as (select *, right(regexp_extract(text, {_q(_VAL)}, 1), 60) as pre, regexp_extract(text, {_q(_VAL)}, 2) as n, regexp_extract(text, {_q(_VAL)}, 3) as u from texts where regexp_matches(text, {_q(_VAL)})),
ctx1 as (select *, [w for w in regexp_extract_all(pre, '[A-Za-z가-힣][A-Za-z0-9_\\-가-힣]*')[-4:] if length(w) > 1] as ws from ctx0),
ctx as (select *, lower(array_to_string(ws[-3:], ' ')) as name from ctx1 where len(ws) > 0 and lower(ws[-1]) not in {_in(STOP_TAILS)} and length(array_to_string(ws[-3:], ' ')) >= 4 and lower(array_to_string(ws[-3:], ' ')) not in {_in(GENERIC_NAMES)})"""


def _obs(table: str) -> str:
    return f"select name, {_SCALED.format(n='n', u='u')} as number, {_BASE.format(u='u')} as unit, file, line from {table}"


_STRONG = f"""{_OBS},
wobs as ({_obs('watched').replace('select name', f'select id, {_NODE}, name')}),
strong as (select * from ({_obs('named').replace('select name', f'select id, {_NODE}, name')}) where name not in {_in(WATCHED_NAMES)} union all select * from wobs),
weak as (select * from ({_obs('ctx').replace('select name', f'select id, {_NODE}, name')}) where name not in (select name from strong)),
held as (select * from (values ('tray width', '1.0m|2.0m|3.0m|4.0m'), ('bend radius', '0.1m|0.2m')) h(name, held))"""


def _split(table: str) -> str:
    return f"(select name, count(*) as n_values, count(distinct unit) as n_units, string_agg(concat(cast(number as varchar), unit), '|' order by number, unit) as signature from (select distinct name, number, unit from {table}) group by name) join (select name, count(distinct file) as n_files from {table} group by name) using (name)"


def _conflicts(table: str, held: bool) -> str:
    mark = "coalesce(held = signature, false)" if held else "false"
    join = "left join held using (name)" if held else ""
    return f"select name, n_values, signature, {mark} as suppressed from {_split(table)} {join} where n_values > 1 and n_units = 1 and n_files > 1"


def _walk(direction: str, name: str) -> str:
    forward = direction != "led_to"
    kinds = NEARBY_RELATIONS if direction == "nearby" else CAUSE_RELATIONS
    head, tail = ("source", "target") if forward else ("target", "source")
    out = [f"{name}_e as (select distinct {head} as id, {tail} as nx, relation, concat(source, chr(1), target, chr(1), relation) as e from links where relation in {_in(kinds)})"]
    out.append(f"{name}_0 as (select distinct id as start, id, cast([] as varchar[]) as rank from nodes where kind = 'document')")
    for level in (1, 2, 3):
        seen = " union all ".join(f"select start, id from {name}_{i}" for i in range(level))
        out.append(f"{name}_{level} as (select f.start, e.nx as id, min(list_append(f.rank, e.e)) as rank, arg_min(e.relation, list_append(f.rank, e.e)) as relation from {name}_{level - 1} f join {name}_e e on e.id = f.id where not exists (select 1 from ({seen}) s where s.start = f.start and s.id = e.nx) group by f.start, e.nx)")
    return ", ".join(out)


def _levels(name: str, extra: str = "") -> str:
    return " union all ".join(f"select start, id, relation, cast({i} as int) as level{extra} from {name}_{i}" for i in (1, 2, 3))


_TOKENS = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'))"
_SEEDS = f"""{_GRAPH},
scored as (select id, label, {_NODE}, len(list_intersect(t, {_TOKENS.format(_q(QUESTION))})) as score, len(t) as label_tokens from (select *, {_TOKENS.format('label')} as t from nodes)),
seeds as (select id, label, cast(score as int) as score, cast(label_tokens as int) as label_tokens, cast(row_number() over (order by score desc, label_tokens, id, {_NODE}) as int) as seed_rank from scored where score > 0 qualify row_number() over (order by score desc, label_tokens, id, {_NODE}) <= 3)"""
_BOTH = "both_ways as (select distinct source as id, target as nx, concat(source, chr(1), target, chr(1), relation) as e from links union select distinct target, source, concat(source, chr(1), target, chr(1), relation) from links)"
_ANSWER = f"""{_SEEDS}, {_BOTH},
a_0 as (select id, [concat(lpad(cast(min(seed_rank) as varchar), 9, '0'), chr(1), chr(1))] as rank from seeds group by id),
a_1 as (select nx as id, min(list_append(rank, e)) as rank from a_0 join both_ways using (id) where nx not in (select id from a_0) group by nx),
a_2 as (select nx as id, min(list_append(rank, e)) as rank from a_1 join both_ways using (id) where nx not in (select id from a_0 union all select id from a_1) group by nx),
near as (select id, 0 as level, rank from a_0 union all select id, 1, rank from a_1 union all select id, 2, rank from a_2),
last_node as (select id, arg_max(label, ({_NODE})) as label, arg_max(kind, ({_NODE})) as kind, arg_max(source_file, ({_NODE})) as source_file, max(source_location) as source_location from nodes group by id),
placed as (select cast(row_number() over (order by level, rank, id) as int) as place, id, label, kind, source_file, source_location, cast(level as int) as level, sum(length(label)) over (order by level, rank, id rows unbounded preceding) as used from near join last_node using (id)),
answer as (select place, id, label, kind, source_file, source_location, level, (select max(used) > {BUDGET} from placed) as truncated from placed where used <= {BUDGET})"""


def _path() -> str:
    out = [f"p_0 as (select id, cast([] as varchar[]) as rank from nodes where lower(trim(label)) = {_q(PATH[0].lower())} order by id, {_NODE} limit 1)"]
    for level in range(1, 7):
        seen = " union all ".join(f"select id from p_{i}" for i in range(level))
        out.append(f"p_{level} as (select nx as id, min(list_append(rank, e)) as rank from p_{level - 1} join both_ways using (id) where nx not in ({seen}) group by nx)")
    union = " union all ".join(f"select {i} as level, id, rank from p_{i}" for i in range(7))
    out.append(f"goal as (select id from nodes where lower(trim(label)) = {_q(PATH[1].lower())} order by id, {_NODE} limit 1)")
    out.append(f"best as (select rank from ({union}) where id in (select id from goal) order by level, rank limit 1)")
    out.append("hops as (select unnest(generate_series(1, len(rank))) as hop, string_split(unnest(rank), chr(1)) as e from best)")
    return ", ".join(out)


_ADJ = "adj as (select distinct source as a, target as b from links where source in (select id from nodes) and target in (select id from nodes))"
_COMP = f"""with recursive {_GRAPH.removeprefix('with ')}, {_ADJ},
sym as (select a, b from adj union select b, a from adj),
docs_only as (select a, b from sym where a not like 'doc\\_%\\_s%' escape '\\' and a not like 'doc\\_%\\_t%' escape '\\' and b not like 'doc\\_%\\_s%' escape '\\' and b not like 'doc\\_%\\_t%' escape '\\'),
reach(id, r) as (select distinct id, id from nodes where kind in ('document', 'name_only') union select reach.id, d.b from reach join docs_only d on d.a = reach.r),
whole as (select id, min(r) as component from reach group by id),
parts as (select id, id as owner from nodes where kind in ('document', 'name_only') union select source, target from links where relation = 'part_of'),
comp as (select p.id, w.component from parts p join whole w on w.id = p.owner)"""


_CHOSEN = f"""{_STRONG}, c as (select *, 1 as pass from ({_conflicts('strong', False)}) union all select *, 2 from ({_conflicts('weak', False)})),
pg as (select cast(row_number() over (order by pass, name) as int) as index, name from c qualify row_number() over (order by pass, name) <= 10),
obs as (select * from strong union all select * from weak),
v as (select name, number, unit, count(distinct concat(file, ':', line)) as n_sources from obs group by name, number, unit),
chosen as (select index, name, cast(row_number() over (partition by index order by number, unit) as int) as choice, number, unit, n_sources from pg join v using (name))"""
_G = "case when {0} = floor({0}) then cast(cast({0} as bigint) as varchar) else cast({0} as varchar) end"
_SPELLED = f"""array_to_string(list_concat([concat({_G.format('number')}, ' ', unit), concat({_G.format('number')}, unit)],
  case when unit = 'm' and abs(number * 1000 - round(number * 1000)) < 1e-6 then [concat(cast(cast(round(number * 1000) as bigint) as varchar), ' mm'), concat(cast(cast(round(number * 1000) as bigint) as varchar), 'mm')] else [] end,
  case when unit = 'm' and abs(number * 100 - round(number * 100)) < 1e-6 then [concat(cast(cast(round(number * 100) as bigint) as varchar), ' cm'), concat(cast(cast(round(number * 100) as bigint) as varchar), 'cm')] else [] end), '|')"""


def sql() -> dict[str, str]:
    docs = f"with src as (select doc_id, text from documents), {_lines('src', 'doc_id')}"
    node = "id, label, kind, source_file, source_location"
    found = " union all ".join(f"(select {node}, {_q(w)} as wanted from (select *, case when lower(trim(label)) = {_q(w)} then 0 when contains(lower(label), {_q(w)}) then 1 end as r from nodes) where r is not null order by r, case when r = 1 then length(label) else 0 end, id, {_NODE} limit 1)" for w in ("adr 7", "fixed at 200 mm", "no such name"))
    walks = {n: f"{_GRAPH}, {_walk(n, n)} {_levels(n)}" for n in ("came_from", "led_to", "nearby")}
    decorated = f"{_GRAPH}, " + ", ".join(_walk(n, n) for n in walks) + ", allw as (" + " union all ".join(_levels(n, f", '{n}' as direction") for n in walks) + f"), last_node as (select id, arg_max(label, ({_NODE})) as l, arg_max(source_file, ({_NODE})) as f, max(source_location) as s from nodes group by id) select start, allw.id, relation, level, direction, coalesce(nullif(l, ''), allw.id) as label, concat(coalesce(nullif(f, ''), '?'), ':', coalesce(cast(s as varchar), '?')) as location from allw left join last_node using (id)"
    metrics = f"{_COMP}, touched as (select a as id from adj union select b from adj) select (select count(*) from nodes) as nodes, (select avg(case when source_location is not null then 1.0 else 0.0 end) from nodes) as located_ratio, (select avg(case when kind = 'document' then 1.0 else 0.0 end) from nodes) as document_ratio, (select count(*) from links) as links, (select count(distinct relation) from links) as relation_kinds, (select count(distinct component) from comp) as components, (select count(distinct id) from nodes where id not in (select id from touched)) as isolated"
    values = "select name, number, unit, count(distinct concat(file, ':', line)) as n_sources"
    mtime = "epoch_us(ts) / 1e6"
    return {
        "md_statements": f"{docs} select * from stmts",
        "md_sections": f"{_MD}, {_SECTIONS} select * from sects",
        "md_section_attribution": f"{_MD}, titled as (select path, line, raw, head, last_value(case when head then regexp_extract(raw, {_TITLE}, 1) end ignore nulls) over (partition by path order by line) as t from lines) select s.path, s.line, s.statement, coalesce(t.t, '') as section from stmts s join titled t using (path, line)",
        "md_section_bodies": f"{_MD}, {_SECTIONS} select s.path, s.line, s.title, coalesce((select string_agg(concat(m.statement, chr(10)), '' order by m.line) from stmts m where m.path = s.path and m.line > s.line and m.line < coalesce(s.nxt, 1000000)), '') as body from (select *, lead(line) over (partition by path order by line) as nxt from sects) s",
        "md_front_matter": f"{_MD} select a.path, cast(count(*) as int) as n_lines, cast(coalesce(max(k.n), 0) as int) as n_kept from all_lines a left join (select path, count(*) as n from lines group by path) k using (path) group by a.path",
        "md_relations": f"{_MD}, {_LINKS} select path, line, target, relation from lks where relation is not null",
        "md_mentions": f"{_MD}, {_LINKS} select path, idx, line, target from lks where relation is null",
        "html_statements": f"with {_html('pages', 'page_id')} select page_id, cast(sum(case when head then 0 else 1 end) over (partition by page_id order by pos) - 1 as int) as idx, line, tag, text as statement, coalesce(last_value(case when head then text end ignore nulls) over (partition by page_id order by pos), '') as section from marked qualify not head",
        "html_headings": f"with {_html('pages', 'page_id')} select page_id, cast(row_number() over (partition by page_id order by pos) - 1 as int) as idx, line, text as title from marked where head",
        "html_links": f"with {_html('pages', 'page_id')} select page_id, cast(row_number() over (partition by page_id order by pos) - 1 as int) as idx, line, target from hrefs",
        "html_section_bodies": f"with {_html('pages', 'page_id')}, nums as (select *, sum(case when head then 1 else 0 end) over (partition by page_id order by pos) as h from marked) select page_id, max(case when head then line end) as line, max(case when head then text end) as title, coalesce(string_agg(concat(text, chr(10)), '' order by pos) filter (not head), '') as body from nums where h > 0 group by page_id, h",
        "title_key_resolution": f"{_GRAPH} select path, idx, line, target, key, to_id, found from resolved",
        "map_nodes": f"{_GRAPH} select {node} from nodes",
        "map_links": f"{_GRAPH} select source, target, relation from links",
        "mention_suppression": f"{_GRAPH} select source, count(*) as mentions, coalesce(max(k), 0) as kept from edges0 e left join (select source, count(*) as k from links where relation = 'mentions' group by source) using (source) where relation = 'mentions' group by source",
        "build_summary": f"{_GRAPH} select (select count(*) from nodes where kind = 'document') as documents, (select count(*) from nodes) as nodes, (select count(*) from nodes where source_location is not null) as located, (select count(*) from links) as links, (select count(distinct relation) from links) as relation_kinds",
        "score_metrics": metrics,
        "score_hints": f"select components, array_to_string([x for x in [case when located_ratio < 0.8 then 'few nodes have a location' end, case when document_ratio > 0.5 then 'most nodes are whole documents' end, case when relation_kinds <= 2 then 'few kinds of relation' end, case when components > greatest(1, nodes // 50) then 'many separate components' end] if x is not null], '; ') as hints from ({metrics})",
        "connected_components": f"{_COMP} select component, count(distinct id) as nodes from comp group by component",
        "isolated_nodes": f"{_GRAPH}, {_ADJ} select distinct id from nodes where id not in (select a from adj union all select b from adj)",
        "score_samples": f"{_GRAPH} select {node} from nodes where kind = 'statement' and regexp_matches(label, '[0-9]') order by id, {_NODE} limit 5",
        "verify_samples": f"{_GRAPH} select n.id, n.source_file, n.source_location, contains(l.raw, n.label) as verified from nodes n join lines l on l.path = n.source_file and l.line = n.source_location where n.kind = 'statement'",
        "find_node": f"{_GRAPH} {found}",
        "chain_came_from": walks["came_from"],
        "chain_led_to": walks["led_to"],
        "chain_nearby": walks["nearby"],
        "chain_decorated": decorated,
        "conflicts_named": f"{_OBS} {_obs('named')}",
        "conflicts_watched": f"{_OBS} {_obs('watched')}",
        "conflicts_context": f"{_OBS} {_obs('ctx')}",
        "conflicts_strong": f"{_STRONG} {_conflicts('strong', False)}",
        "conflicts_weak": f"{_STRONG} {_conflicts('weak', False)}",
        "suppressed_conflicts": f"{_STRONG} {_conflicts('strong', True)}",
        "conflict_counts": f"{_STRONG} select (select count(distinct name) from strong) as names, (select count(*) from {_split('strong')} where n_values > 1) as split, (select count(distinct name) from weak) as context_names, (select count(*) from ({_conflicts('strong', True)} union all {_conflicts('weak', True)}) where suppressed) as suppressed",
        "conflict_values": f"{_STRONG} {values}, arg_min(concat(file, ':', line), (id, {_NODE})) as first_source from strong group by name, number, unit",
        "value_spellings": f"{_STRONG} select distinct number, unit, case when number = floor(number) then cast(cast(number as bigint) as varchar) else cast(number as varchar) end as shown, {_SPELLED} as spellings from strong",
        "settle_choices": f"{_CHOSEN} select index, name, choice, number, unit, n_sources from chosen",
        "settle_plan": f"""{_CHOSEN},
spelled as (select *, {_SPELLED} as forms from chosen),
kept as (select index, split_part(forms, '|', 1) as new_text from spelled where choice = 1),
gone as (select s.index, s.name, s.number, s.unit, k.new_text, o.file, o.line as recorded, concat('(^|[^0-9.,])(', replace(s.forms, '.', '[.]'), ')([^A-Za-z0-9]|$)') as rx from spelled s join kept k using (index) join (select distinct name, number, unit, file, line from obs) o on o.name = s.name and o.number = s.number and o.unit = s.unit where s.choice > 1),
hits as (select g.*, l.line, l.raw, case when cast(l.line as varchar) = g.recorded then 0 when len([w for w in string_split(g.name, ' ') if length(w) > 1]) > 0 and len([w for w in string_split(g.name, ' ') if length(w) > 1 and not contains(lower(l.raw), lower(w))]) = 0 then 1 else 2 end as worth from gone g join all_lines l on l.path = g.file where regexp_matches(l.raw, g.rx)),
best as (select * from hits qualify worth = min(worth) over (partition by index, file, recorded, number, unit))
select index, name, file, cast(line as int) as line, number, unit, new_text, min(worth) = 0 as at_source from best group by index, name, file, line, number, unit, new_text""",
        "answer_seeds": f"{_SEEDS} select id, label, score, label_tokens, seed_rank from seeds",
        "answer_budget": f"{_ANSWER} select * from answer",
        "answer_condensed": f"{_ANSWER} select place, label, source_file, source_location, truncated from answer where source_location is not null and source_file <> '' and source_location <> 1",
        "answer_documents": f"{_ANSWER}, d as (select label, min(place) as place from answer where source_location = 1 and source_file <> '' group by label) select (select string_agg(label, ', ' order by place) from (select * from d order by place limit 4)) as documents, greatest(count(*) - 4, 0) as more from d",
        "shortest_path": f"{_GRAPH}, {_BOTH}, {_path()} select cast(hop as int) as hop, e[1] as source, e[3] as relation, e[2] as target from hops",
        "explain_node": f"{_GRAPH} select source, relation, target, 'out' as direction from links where source = 'doc_adr_40' union all select source, relation, target, 'in' from links where target = 'doc_adr_40' and source <> target",
        "fingerprint": f"select count(*) as documents, round(max({mtime}), 3) as newest from events",
        "stale_documents": f"select cast(event_id as varchar) as name from events where {mtime} > (select floor(avg({mtime})) from events)",
    }

