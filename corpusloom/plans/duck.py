"""The oracle's side of the catalogue: statements in DuckDB's dialect, put together from common table expressions."""

from __future__ import annotations

from corpusloom.functions import text as t
from corpusloom.operators import routing


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches(pattern: str, fold: bool = True, column: str = "line") -> str:
    """A regular expression test; RE2 knows neither lookaround nor Unicode word boundaries."""
    return f"regexp_matches({column}, {quoted(('(?i)' if fold else '') + pattern)})"


def rendered(template: str, values: dict[str, str]) -> str:
    import re

    parts = [values[p] if k % 2 else quoted(p) for k, p in enumerate(re.split(r"\{([a-z_]+)\}", template))]
    return " || ".join(parts)


_RULES = "regexp_replace(line, '[._]{4,}|(?:[.·] ){3,}[.·]', '...', 'g')"
for _c in "-=*~#•·":
    _RULES = f"regexp_replace({_RULES}, '[{_c}]{{4,}}', '{_c * 3}', 'g')"
PLAIN = r"length(regexp_replace(line, '[^\p{L}\p{N}]', '', 'g'))"
TABLE_LIKE = "(line like '%|%' or line like '%  %')"
_TOKEN = matches(t.PAGE_TOKEN)
NOISE = f"(length(line) > 0 and length(translate(line, '{t.MEANINGFUL}', '')) = length(line) and ({PLAIN} = 0 or (length(line) >= 6 and {PLAIN} < 0.25 * length(line))))"
PROTECTED = f"(not {_TOKEN} and ({matches(t.VALUE)} or lower(rtrim(line, '.,;')) in ({', '.join(map(quoted, t.INTERVALS))})))"
MAY_BE_HEADER = rf"({_TOKEN} or (not regexp_matches(line, '[.!?;:,]$') and (not regexp_matches(line, '^\p{{Ll}}') or {matches('^' + t.URL_OR_MAIL)})))"


def lines(source: str) -> str:
    """src -> col (collapsed lines) -> cl (page numbers dropped, is_barrier)."""
    return rf"""with src as ({source}),
pg as (select doc_id, unnest(string_split(coalesce(text, ''), chr(12))) as page, generate_subscripts(string_split(coalesce(text, ''), chr(12)), 1) - 1 as page_no from src),
raw as (select doc_id, page_no, unnest(string_split(page, chr(10))) as line, generate_subscripts(string_split(page, chr(10)), 1) - 1 as line_no from pg),
col as (select doc_id, page_no, line_no, trim(regexp_replace({_RULES}, '[ \t]*\t[ \t]*| {{3,}}', '  ', 'g')) as line from raw),
cl as (select doc_id, page_no, line_no, case when {NOISE} then '' else line end as line, {NOISE} as is_barrier from col where not {matches(t.PAGE_NUMBER)})
"""


def digest(table: str) -> str:
    return f"select doc_id, count(*) as n_lines, sum(length(line))::bigint as chars, sha256(string_agg(line, chr(10) order by page_no, line_no)) as digest from {table} group by doc_id"


def _key(counter: bool) -> str:
    counts = _TOKEN + (f" or {matches(t.COUNTER_END, False)}" if counter else "")
    key = r"regexp_replace(lower(line), '\s+', ' ', 'g')"
    return rf"case when {counts} then regexp_replace({key}, '\d+', '#', 'g') else {key} end"


_EDGE = """, ct as (select *, line <> '' and not is_barrier as content from cl),
ed as (select *, content and (row_number() over (partition by doc_id, page_no, content order by line_no) <= 3
  or row_number() over (partition by doc_id, page_no, content order by line_no desc) <= 3) as is_edge from ct)"""

PAGE_EDGES = f"""{_EDGE}, ky as (select *, case when is_edge and length(line) <= 120 and not {PROTECTED} then {_key(True)} end as key from ed),
np as (select doc_id, max(page_no) + 1 as pages from ky group by 1),
kp as (select doc_id, key, count(distinct page_no) as on_pages from ky where key is not null group by 1, 2),
rk as (select ky.*, pages, on_pages, row_number() over (partition by ky.doc_id, ky.key order by page_no, line_no) as rn from ky join np using (doc_id) left join kp on ky.doc_id = kp.doc_id and ky.key = kp.key),
kept as (select * from rk where not (key is not null and pages >= 2 and on_pages >= greatest(3, ceil(pages / 2)) and rn > 1))
"""

PAGE_NUMBERS = f"""{_EDGE}, sh as (select *, case when is_edge and regexp_matches(line, '{t.EDGE_NUMBER}') then
  (regexp_extract(line, '{t.EDGE_NUMBER}', 1)::int - page_no)::varchar || '/' || regexp_extract(line, '{t.EDGE_NUMBER}', 2) end as shift from ed),
cs as (select *, count(shift) over (partition by doc_id, shift) as seen, max(page_no) over (partition by doc_id) + 1 as pages from sh),
kept as (select * from cs where not (pages >= 2 and shift is not null and seen >= greatest(2, ceil(pages / 2))))
"""

_TOC = quoted("(?i)" + t.TOC_ENTRY)
CONTENTS = rf""", so as (select *, line <> '' or is_barrier as solid, line <> '' and not is_barrier and regexp_matches(line, {_TOC}) as entry from cl),
tk as (select *, case when entry then regexp_extract(line, {_TOC}, 2)::int end as toc_page,
  lower(trim(regexp_replace(case when entry then regexp_extract(line, {_TOC}, 1) else line end, '\s+', ' ', 'g'))) as key from so),
br as (select *, not entry or not coalesce(lag(entry) over w, false) or toc_page < lag(toc_page) over w as breaks from tk window w as (partition by doc_id, solid order by page_no, line_no)),
rn as (select *, sum(breaks::int) over (partition by doc_id, solid order by page_no, line_no) as run from br),
hd as (select distinct doc_id, key from tk where not entry and line <> '' and not is_barrier),
fd as (select rn.*, case when entry then (hd.key is not null)::int end as found from rn left join hd on rn.doc_id = hd.doc_id and rn.key = hd.key),
sz as (select *, count(found) over (partition by doc_id, solid, run) as size, sum(found) over (partition by doc_id, solid, run) as hits from fd),
kept as (select * from sz where not (entry and size >= 3 and 3 * hits >= 2 * size))
"""

REPEATS = f""", ps as (select *, coalesce(sum(greatest(length(line), is_barrier::int) + 1) over (partition by doc_id order by page_no, line_no rows between unbounded preceding and 1 preceding), 0) as pos from cl),
ky as (select *, case when line <> '' and not is_barrier and length(line) between 8 and 120 and {MAY_BE_HEADER} and not {PROTECTED} then {_key(False)} end as key from ps),
gp as (select *, pos - lag(pos) over (partition by doc_id, key order by page_no, line_no) as gap, row_number() over (partition by doc_id, key order by page_no, line_no) as rn from ky),
ag as (select *, count(key) over (partition by doc_id, key) as n, min(gap) over (partition by doc_id, key) as least from gp),
kept as (select * from ag where not coalesce(key is not null and n >= 3 and least >= 1000 and rn > 1, false))
"""

CONSECUTIVE = rf""", so as (select *, line <> '' or is_barrier as solid, case when is_barrier then chr(1) else regexp_replace(line, '\s+', ' ', 'g') end as key from cl),
fr as (select *, (key is distinct from lag(key) over (partition by doc_id, solid order by page_no, line_no))::int as fresh from so),
il as (select *, sum(fresh) over (partition by doc_id, solid order by page_no, line_no) as island from fr),
pr as (select *, coalesce(max((not {TABLE_LIKE})::int) over (partition by doc_id, solid, island order by page_no, line_no rows between unbounded preceding and 1 preceding), 0) as prose from il),
kept as (select * from pr where not (solid and length(key) >= 30 and prose = 1))
"""

CLEANED = f"""select k.doc_id, sum(length(line))::bigint as clean_chars, count(*) as n_lines, sum({PLAIN})::bigint as meaningful_chars,
  any_value(length(d.text))::bigint as raw_chars, sum({PLAIN}) >= 30 as sufficient from kept k join documents d on k.doc_id = d.doc_id group by k.doc_id"""

PARAGRAPHS = """, il as (select *, line = '' and not is_barrier as blank, sum((line = '' and not is_barrier)::int) over (partition by doc_id order by page_no, line_no) as island from cl),
par as (select * from il where not blank)
"""

DUPLICATE_PARAGRAPHS = rf""", pa as (select doc_id, island, string_agg(line, chr(10) order by page_no, line_no) as body, regexp_replace(string_agg(line, ' ' order by page_no, line_no), '\s+', ' ', 'g') as key,
  bool_and(length(line) >= 30 and not {TABLE_LIKE}) as prose from par where not is_barrier group by 1, 2),
cp as (select *, row_number() over (partition by doc_id, key order by island) as copy from pa),
s1 as (select *, lag(key) over (partition by doc_id order by island) as before from cp where length(key) < 200 or copy = 1)
select doc_id, count(*) as n_paragraphs, sum(length(body))::bigint as chars from s1
where not coalesce(before = key and length(key) between 40 and 199 and prose, false) group by doc_id"""


def scores(source: str, groups) -> str:
    """Pages as blocks: s (doc_id, block_no, grp, grp_no, score, strong, heading_strong)."""
    arms = []
    for order, g in enumerate(groups):
        strong = ", ".join(f"case when {matches(p, True, 'chunk')} then '{i}' end" for i, p in enumerate(g.strong))
        heading = ", ".join(f"case when {matches(p, True, 'heading')} then '{i}' end" for i, p in enumerate(g.strong))
        points = " + ".join([f"10 * {matches(p, True, 'chunk')}::int" for p in g.strong] + [f"{matches(p, True, 'chunk')}::int" for p in g.weak])
        arms.append(f"select doc_id, block_no, '{g.name}' as grp, {order} as grp_no, ({points})::int as score, concat_ws(',', {strong}) as strong, concat_ws(',', {heading}) as heading_strong from hd")
    return f"""with src as ({source}),
pg as (select doc_id, unnest(string_split(text, chr(12))) as chunk, generate_subscripts(string_split(text, chr(12)), 1) - 1 as block_no from src),
hd as (select *, case when instr(chunk, chr(10)) > 0 and length(split_part(chunk, chr(10), 1)) <= 80 then split_part(chunk, chr(10), 1) else '' end as heading from pg),
s as ({' union all '.join(arms)})
"""


def _any_of(keywords) -> str:
    return "(" + " or ".join(f"contains(lower(question), {quoted(k)})" for k in keywords) + ")"


def _cases(k: int, default: str) -> str:
    return "case " + " ".join(f"when {_any_of(r[2])} then {quoted(r[k])}" for r in routing.RULES) + f" else {quoted(default)} end"


def route(source: str) -> str:
    return f"""with q as ({source}), r as (select *, {_cases(1, routing.DEFAULT_MODE)} as mode, {_cases(0, 'fallback')} as matched_rule,
  list_filter(string_split(domains, ','), lambda x: x <> '') as ds from q) """


_DEFAULTS = " ".join(f"when ds[1] = '{d}' then '{m or routing.CROSS_MODE}'" for d, (m, _) in routing.DOMAINS.items())
_ALLOWS = ", ".join(f"'{d}'" for d, (_, a) in routing.DOMAINS.items() if a)
_DOC = _any_of(routing.RULES[0][2])
ROUTE_DOMAINS = f"""select question_id, case when len(ds) = 0 or domains = 'hotel_health' then mode when len(ds) > 1 then '{routing.CROSS_MODE}'
  when ds[1] in ({_ALLOWS}) and {_DOC} then 'document_question' {_DEFAULTS} end as mode,
  case when len(ds) = 0 or domains = 'hotel_health' then matched_rule when len(ds) > 1 then 'domains:' || replace(domains, ',', '+')
  when ds[1] in ({_ALLOWS}) and {_DOC} then 'domain:' || ds[1] || '+document_keywords' else 'domain:' || ds[1] end as matched_rule from r"""


def warmup(source: str) -> str:
    return route(source) + f"select question_id, case when len(ds) = 0 or domains = 'hotel_health' then 'hotel_health_summary' when len(ds) > 1 then '{routing.CROSS_MODE}' {_DEFAULTS} end as mode from r"


RESOLVE = """with c as (select c_custkey as request_id, 'k' || (c_custkey % 5) as api_key, c_custkey % 4 as m from customer),
e as (select *, case when api_key = 'k1' then 'a' when api_key = 'k2' then 'b' when api_key = 'k3' then 'c' end as client_id,
  case when m = 0 and api_key = 'k1' then 'large' when m = 0 and api_key = 'k2' then 'gone' when m in (0, 1) then 'small' when m = 2 then 'missing' end as p from c),
f as (select *, case when client_id is null then 'unauthorized' when client_id = 'c' then 'client_disabled' when m = 3 then 'unknown_mode'
  when p not in ('small', 'large') then 'model_profile_unavailable' end as error_code from e)
select request_id, client_id, case when error_code is null then p end as profile, error_code from f"""

VERSIONS = """with v as (select 'mode_' || (p_partkey % 7) as subdir, case when p_partkey % 13 = 0 then 'draft' else 'v' || (p_partkey % 12) end as version,
  (p_partkey % 2)::int as layer, 'text ' || p_partkey as content, p_partkey,
  case when p_partkey % 13 <> 0 and p_partkey % 12 > 0 then p_partkey % 12 end as n from part) """

ACTIVE = """select 'mode_' || i as subdir, case when exists (select 1 from v where v.subdir = 'mode_' || i and v.version = 'v' || (i * 3)) then 'v' || (i * 3) else 'v1' end as version
from range(9) r(i)"""


def answers(source: str) -> str:
    """m (doc_id, field, value, conflict): merged answers."""
    return rf"""with a as ({source}), o as (select *, max(owner::int) over (partition by doc_id, field) as owners from a),
k as (select *, lower(trim(regexp_replace(value, '\s+', ' ', 'g'))) as key from o where owner or owners = 0),
m as (select doc_id, field, case when count(distinct key) = 1 then arg_min(value, call_no::bigint * 1000000000000 + seq) filter (where value is not null) end as value, count(distinct key) > 1 as conflict from k group by 1, 2) """


DEPENDENTS = """, has as (select doc_id, list(field) filter (where value is not null) as filled from m group by 1)
select doc_id, field, case when field = 'currency' and not list_contains(coalesce(filled, []), 'amount') then null
  when field = 'notice_period_value' and not list_contains(coalesce(filled, []), 'notice_period_unit') then null else value end as value from m join has using (doc_id)"""

NOTES = """, n as (select doc_id, 0 as kind, min(call_no)::varchar as place, value as note from a where field = 'vendor_name' and trim(value) <> '' group by doc_id, value
  union all select doc_id, 1, field, 'Conflicting values for ' || field || '.' from m where conflict)
select doc_id, string_agg(note, chr(10) order by kind, place, note) as notes from n group by doc_id"""

GOLD = """, g as (select c_custkey as doc_id, unnest(['amount', 'vendor_name', 'currency', 'notice_period_value']) as field from customer)
select g.doc_id, g.field, case g.field when 'amount' then value is not distinct from '450' when 'vendor_name' then contains(lower(coalesce(value, '')), 'muster') and contains(lower(coalesce(value, '')), 'gmbh')
  when 'currency' then coalesce(value in ('EUR', 'CHF'), false) else not contains(coalesce(value, ''), '1') end as passed from g left join m on g.doc_id = m.doc_id and g.field = m.field"""

ITEMS = """with i as (select o_custkey as doc_id, o_orderkey % 3 as call_no, o_orderkey as pos, 'Lift ' || (o_orderkey % 3) as name, case when o_orderkey % 2 = 0 then 'sn-' || (o_orderkey % 5) else '' end as sn from orders),
k as (select *, case when sn <> '' then '#' || upper(replace(sn, '-', '')) else lower(name) end as key from i),
r as (select *, row_number() over (partition by doc_id, key order by call_no, pos) as rn from k),
p as (select *, row_number() over (partition by doc_id order by call_no, pos) as place from r where rn = 1)
select doc_id, string_agg(name || '/' || sn, ',' order by place) as items from p where place <= 50 group by doc_id"""
