from __future__ import annotations

from pagemill.operators.html import EDGES, INLINE_TAGS, OPTIONAL_ENDS, PAGE_END, PARAGRAPH_ENDS, REACH
from pagemill.operators.rules import JUNK_RULES
from pagemill.sources.derived import DIRTY_SQL, MISNESTED_SQL, RICH_SQL, ROBOTS_SQL, SEEDS_SQL, SITE_SQL, optional_sql

_WS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def _derived(sql: str, **tables: str) -> str:
    for name, value in {"text": "varchar", **tables}.items():
        sql = sql.replace("{" + name + "}", value)
    return f"({sql})"


SEEDS = _derived(SEEDS_SQL, pages="pages")
RICH = _derived(RICH_SQL, pages="pages")
# The same pages with every end tag written.
CLOSED = _derived(optional_sql(True), pages="pages")
MISNESTED = _derived(MISNESTED_SQL, pages="pages")
DIRTY = _derived(DIRTY_SQL, documents="documents")
PAGE_ROBOTS = _derived(ROBOTS_SQL, column="url", urls="pages")

_ABSOLUTE = "lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*')) || rtrim(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#;]*)', 1), '/')"
_NUMBERED = f"""(select page_id, requested_url, url, host, row_number() over (partition by host order by page_id) - 1 as j
    from (select page_id, url, {_ABSOLUTE} as requested_url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) as host from pages
      qualify row_number() over (partition by requested_url order by page_id) = 1))"""
SITE = _derived(SITE_SQL, pages="pages", numbered=_NUMBERED)
SITE_ROBOTS = _derived(ROBOTS_SQL, column="requested_url", urls=SITE)


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{_WS}]+', ''), '[{_WS}]+$', '')"


def norm(u: str) -> str:
    """Normalised form of an absolute web URL."""
    host = f"lower(regexp_extract({u}, '^[A-Za-z]+://[^/?#]*'))"
    path = f"regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#;]*)', 1)"
    return f"({host} || rtrim({path}, '/'))"


def entities(x: str) -> str:
    x = f"regexp_replace({x}, '&copy;?', '©', 'g')"
    x = f"regexp_replace({x}, '&middot;?', '·', 'g')"
    x = f"regexp_replace({x}, '&quot;?', '\"', 'g')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


_TOK = (
    r"(?is)<!--.*?-->|<script[\s/>].*?</script\s*>|<style[\s/>].*?</style\s*>"
    r"|<title[\s/>].*?</title\s*>|</?[a-z][^>]*>|<![^>]*>|</?[a-z][^>]*$|[^<]+|<"
)


def tokens(source: str, key: str = "page_id", html: str = "html") -> str:
    """CTEs ending in ``typed``."""
    return f"""
raw as (select {key}, regexp_extract_all({html}, '{_TOK}') as l from {source}),
tok as (select {key}, unnest(range(len(l))) as pos, unnest(l) as tok from raw),
kinds as (select *, case
    when tok not like '<%' or tok = '<' then 'text'
    when tok like '<!--%' then 'comment'
    when tok like '<!%' then 'decl'
    when regexp_matches(tok, '(?i)^<(script|style|title)[\\s/>]') then 'raw'
    when tok not like '%>' then 'cut'
    when tok like '</%' then 'close' else 'open' end as kind from tok),
typed as (select *, case when kind in ('open', 'close', 'raw')
    then lower(regexp_extract(tok, '^</?([A-Za-z][^\\s/>]*)', 1)) else '' end as tag from kinds)"""


_VOID = "('area','base','br','col','embed','frame','hr','img','input','link','meta','param','source','track','wbr')"
_END = 2147483647

# A close tag's partner is the last open tag of the same level: levels are counts of what is open.
SPANS = f"""
leveled as (select *, case when tag in {_VOID} then 0 when kind = 'open' then 1 when kind = 'close' then -1 else 0 end as step from typed),
summed as (select *, sum(step) over (partition by page_id, tag order by pos rows unbounded preceding) as s from leveled),
ends as (select page_id, tag, pos, s from summed where step = -1),
spans as (select o.page_id, o.pos, o.tag, o.kind, o.tok,
    case when o.step = 0 then o.pos
         else (select min(e.pos) from ends e where e.page_id = o.page_id and e.tag = o.tag and e.pos > o.pos and e.s = o.s - 1) end as close_pos
  from summed o where o.kind in ('open', 'raw'))"""


def _tag_value(values: dict[str, int], other: int) -> str:
    return "case tag " + " ".join(f"when '{t}' then {v}" for t, v in values.items()) + f" else {other} end"


# The same by a walk over the tags of a page with a stack of what is open, innermost first; one step per tag.
WALKED = f"""
tags as materialized (select page_id, row_number() over (partition by page_id order by pos) as k, pos, tag, kind = 'open' as opens,
    {_tag_value(OPTIONAL_ENDS | {t: 8 for t in INLINE_TAGS}, 0)} as rnk,
    case when kind = 'open' then {_tag_value(EDGES, 0)} else {_tag_value(REACH, 0)} end as edge,
    case when kind = 'open' then {_tag_value({t: 4 for t in PARAGRAPH_ENDS} | OPTIONAL_ENDS, 9)} else 9 end as ends
  from typed where kind = 'close' or (kind = 'open' and tag not in {_VOID} and tok not like '%/>')),
walk as (
  select page_id, 0::bigint as k, []::struct(pos bigint, tag varchar, rnk int, edge int)[] as stack, []::struct(pos bigint, fin bigint)[] as ended
    from (select distinct page_id from tags)
  union all
  select page_id, k,
    case when opens then list_concat([{{'pos': pos, 'tag': tag, 'rnk': rnk, 'edge': edge}}], stack[n + 1:]) else stack[n + 1:] end,
    list_transform(stack[:n], lambda e, i: {{'pos': e.pos, 'fin': case when i = n and not opens then pos when e.tag in ('html', 'body') then {PAGE_END} else pos - 1 end}})
  from (select *, case when opens and ends < 9 then
          coalesce(list_max(list_transform(range(1, 1 + case when stop is null then len(stack) else stop - 1 end), lambda i: case when stack[i].rnk < 8 then i else 0 end)), 0)
        when opens or own is null or len(list_filter(stack[:own - 1], lambda e: e.edge > edge)) > 0 then 0 else own end as n
    from (select w.page_id, t.k, w.stack, t.pos, t.tag, t.rnk, t.edge, t.ends, t.opens,
            list_position(list_transform(w.stack, lambda e: e.rnk < t.ends), true) as stop,
            list_position(list_transform(w.stack, lambda e: e.tag), t.tag) as own
          from walk w join tags t on t.page_id = w.page_id and t.k = w.k + 1))),
found as (select page_id, unnest(ended, recursive := true) from walk),
spans as (select o.page_id, o.pos, o.tag, o.kind, o.tok,
    case when t.pos is null then o.pos else coalesce(f.fin, {PAGE_END}) end as close_pos
  from typed o left join tags t on t.page_id = o.page_id and t.pos = o.pos
  left join found f on f.page_id = o.page_id and f.pos = o.pos where o.kind in ('open', 'raw'))"""


def _attr(name: str) -> str:
    return f"regexp_extract(tok, '(?i)\\s{name}=\"([^\"]*)\"', 1)"


def _rule(kind: str, name: str, value: str | None) -> str:
    if kind == "tag":
        return f"tag = '{name}'"
    if kind == "equals":
        return f"kind = 'open' and {_attr(name)} = '{value}'"
    return f"kind = 'open' and contains({_attr(name)}, '{value}')"


_JUNK = " or ".join(f"({_rule(*r)})" for r in JUNK_RULES)
_BEST = f"""case when kind <> 'open' then null when tag = 'main' then 0 when tag = 'article' then 1
    when {_attr('role')} = 'main' then 2
    when list_contains(string_split({_attr('class')}, ' '), 'main-content') then 3
    when list_contains(string_split({_attr('class')}, ' '), 'content') then 4
    when {_attr('id')} = 'main' then 5 when {_attr('id')} = 'content' then 6
    when tag = 'body' then 7 end"""

CONTENT = f"""
junk as (select page_id, pos, coalesce(close_pos, {_END}) as close_pos from spans where {_JUNK}),
clean as (select t.* from typed t where kind <> 'comment' and not exists
    (select 1 from junk j where j.page_id = t.page_id and t.pos between j.pos and j.close_pos)),
ranked as (select s.page_id, s.pos, coalesce(s.close_pos, {_END}) as close_pos, {_BEST} as rnk
    from spans s semi join clean c on c.page_id = s.page_id and c.pos = s.pos),
best as (select * from ranked where rnk is not null
    qualify row_number() over (partition by page_id order by rnk, pos) = 1),
content as (select c.* from clean c join best b on b.page_id = c.page_id and c.pos between b.pos and b.close_pos)"""

# Blocks: text between two block edges.  Lists are placed by the tags that are open around them.
BLOCKS = f"""
cs as (select c.*, s.close_pos from content c left join spans s on s.page_id = c.page_id and s.pos = c.pos),
pre as (select page_id, pos, close_pos from cs where tag = 'pre' and kind = 'open'),
code as (select page_id, pos, close_pos from cs where tag in ('code', 'pre') and kind = 'open'),
lists as (select page_id, pos, coalesce(close_pos, {_END}) as close_pos, tag, coalesce(try_cast(nullif(regexp_extract(tok, 'start="([0-9]+)"', 1), '') as int), 1) as start
    from cs where tag in ('ul', 'ol') and kind = 'open'),
st as (select c.*,
    exists (select 1 from pre p where p.page_id = c.page_id and c.pos > p.pos and c.pos < p.close_pos) as in_pre,
    exists (select 1 from code p where p.page_id = c.page_id and c.pos > p.pos and c.pos < p.close_pos) as in_code
  from cs c),
edged as (select *, kind in ('open', 'close') and not in_pre
    and tag in ('h1','h2','h3','h4','h5','h6','p','ul','ol','li','pre') as edge from st),
numbered as (select *, sum(edge::int) over (partition by page_id order by pos rows unbounded preceding) as block,
    case when kind = 'text' and in_code then {entities('tok')}
         when kind = 'text' then regexp_replace({entities('tok')}, '([*_])', '\\\\\\1', 'g')
         when tag = 'a' and kind = 'open' and not in_code then '['
         when tag = 'a' and kind = 'close' and not in_code then (select arg_max(']('
              || regexp_extract(o.tok, 'href="([^"]*)"', 1)
              || case when o.tok like '% title=%' then ' "' || {entities("regexp_extract(o.tok, 'title=\"([^\"]*)\"', 1)")} || '"' else '' end || ')', o.pos)
              from cs o where o.page_id = edged.page_id and o.tag = 'a' and o.kind = 'open' and o.pos < edged.pos)
         when tag = 'img' then '![' || {entities("regexp_extract(tok, 'alt=\"([^\"]*)\"', 1)")} || '](' || regexp_extract(tok, 'src="([^"]*)"', 1) || ')'
         when tag = 'code' and not in_pre then '`' else '' end as piece from edged),
grouped as (select page_id, block, string_agg(piece, '' order by pos) as raw, min(pos) as pos,
    arg_min(case when edge then kind || ' ' || tag else '' end, pos) as opener from numbered group by all),
shown as (select *, case when opener = 'open pre' then raw else {strip(f"regexp_replace(raw, '[{_WS}]+', ' ', 'g')")} end as text from grouped),
placed as (select g.*,
    (select arg_max(l.pos, l.pos) from lists l where l.page_id = g.page_id and l.pos <= g.pos and g.pos < l.close_pos) as list_pos,
    (select count(*) from lists l where l.page_id = g.page_id and l.pos <= g.pos and g.pos < l.close_pos) as depth,
    (select min(l.pos) from lists l where l.page_id = g.page_id and l.pos <= g.pos and g.pos < l.close_pos) as root
  from shown g),
counted as (select p.*, sum((opener = 'open li')::int) over (partition by page_id, list_pos order by block rows unbounded preceding) as n from placed p),
filled as (select c.*, l.tag as list_tag, l.start from counted c left join lists l on l.page_id = c.page_id and l.pos = c.list_pos where text <> ''),
ordered as (select *, lag(root) over w as prev_root, lag(block) over w as prev_block from filled window w as (partition by page_id order by block)),
rendered as (select page_id, block,
    case when opener = 'open pre' then 'code' when opener like 'open h%' then 'heading'
         when opener = 'open li' then 'item' else 'text' end as kind,
    case when prev_block is null then '' when opener = 'open li' and prev_root = root then chr(10) else chr(10) || chr(10) end as sep,
    case when opener = 'open pre' then '```' || chr(10) || text || chr(10) || '```'
         when opener like 'open h%' then repeat('#', right(opener, 1)::int) || ' ' || text
         when opener = 'open li' then repeat('  ', (depth - 1)::int)
              || case when list_tag = 'ol' then (n + start - 1)::varchar || '. ' else '- ' end || text
         else text end as line
  from ordered)"""

def lines(source: str, key: str, text: str) -> str:
    """CTEs ending in ``judged`` and ``cleaned``."""
    return f"""
split_lines as (select {key}, unnest(range(len(l))) as line_no, unnest(l) as line
    from (select {key}, string_split({text}, chr(10)) as l from {source})),
stripped as (select *, {strip('line')} as s from split_lines),
fenced as (select *, s like '```%' as is_fence,
    sum((s like '```%')::int) over (partition by {key} order by line_no rows unbounded preceding) % 2 = 1 as in_code from stripped),
judged as (select *,
    not in_code and regexp_matches(line, '\\b[A-Za-z0-9+/=]{{100,}}\\b') as gibberish,
    not in_code and s <> '' and length(s) < 5 and not regexp_matches(s, '^([*-]|[123]\\.)') as short,
    length(s) > 10 and len(list_distinct(regexp_extract_all(s, '(?s).'))) < 3 as monotone from fenced),
cleaned as (select {key}, {strip("regexp_replace(coalesce(string_agg(case when not (gibberish or short or monotone) then line end, chr(10) order by line_no), ''), chr(10) || '{3,}', chr(10) || chr(10), 'g')")} as markdown
    from judged group by {key})"""


_MD = f"{tokens('SRC')}, {SPANS}, {CONTENT}, {BLOCKS}"


def rendered(source: str) -> str:
    return "with " + _MD.replace("SRC", source)


def page_md(source: str) -> str:
    """CTEs ending in ``cleaned``: page_id, markdown, one row per page."""
    joined = f"""
joined as (select p.page_id, coalesce(string_agg(sep || line, '' order by block), '') as md
    from {source} p left join rendered r on r.page_id = p.page_id group by p.page_id)"""
    return f"{_MD.replace('SRC', source)}, {joined}, {lines('joined', 'page_id', 'md')}"


_TITLE = f"""coalesce({strip(entities("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)"))}, '')"""

DOCS = f"""
docs as (select p.page_id, p.url, {_TITLE} as title,
    case when c.markdown = '' then ''
         when {_TITLE} = '' then c.markdown
         else '# ' || {_TITLE} || chr(10) || '**Source:** `' || p.url || '`' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || c.markdown end as markdown
  from pages p join cleaned c using (page_id))"""


def count_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{_WS}]+'))::bigint"


# --- robots -------------------------------------------------------------------------------------


def robots(bodies: str, p: str) -> str:
    """CTEs ending in ``{p}rules``, ``{p}chosen`` (rules of our agent) and ``{p}policy``."""
    return f"""
{p}bodies as (select * from {bodies}),
{p}policy as (select origin, case when http_status is null then 'allow_all'
    when http_status between 200 and 299 and body is null then 'allow_all'
    when http_status between 200 and 299 then 'rules' when http_status in (401, 403) then 'deny_all'
    when http_status between 400 and 499 then 'allow_all' else 'deny_all' end as policy from {p}bodies),
{p}lines as (select origin, unnest(range(len(l))) as line_no, unnest(l) as line
    from (select origin, string_split(body, chr(10)) as l from {p}bodies where http_status between 200 and 299 and body is not null)),
{p}events as (select origin, line_no, case when line = '' then 'blank'
      when regexp_matches(line, '(?i)^\\s*user-agent\\s*:') then 'agent'
      when regexp_matches(line, '(?i)^\\s*(dis)?allow\\s*:') then 'rule'
      when regexp_matches(line, '(?i)^\\s*(crawl-delay|request-rate)\\s*:') then 'delay' end as event,
    replace(trim(regexp_replace(regexp_replace(line, '#.*', ''), '^[^:]*:', '')), '%65', 'e') as value,
    regexp_matches(line, '(?i)^\\s*allow') as allows from {p}lines),
{p}marked as (select *, lag(event) over (partition by origin order by line_no) as before from {p}events where event is not null),
{p}cut as (select *, sum((event = 'blank' or (event = 'agent' and coalesce(before, '') <> 'agent'))::int)
    over (partition by origin order by line_no rows unbounded preceding) as entry_no from {p}marked),
{p}entries as (select origin, entry_no, string_agg(value, ',' order by value) filter (event = 'agent') as agents
    from {p}cut group by all having arg_min(event, line_no) = 'agent' and count(*) filter (event in ('rule', 'delay')) > 0),
{p}rules as (select e.origin, e.entry_no::bigint as entry_no, e.agents, r.line_no::bigint as rule_no, r.value as path,
    case when r.line_no is null then null else r.allows or r.value = '' end as allow
    from {p}entries e left join {p}cut r on r.origin = e.origin and r.entry_no = e.entry_no and r.event = 'rule'),
{p}ranked as (select *, case when list_contains(string_split(agents, ','), '*') then 1
    when len(list_filter(string_split(agents, ','), lambda a: contains('pagemill', lower(a)))) > 0 then 0 end as rnk from {p}rules),
{p}chosen as (select * from {p}ranked where rnk is not null
    qualify rank() over (partition by origin order by rnk, entry_no) = 1)"""


def verdict(p: str, url: str) -> str:
    """Scalar: may our agent fetch this normalised URL?"""
    origin = f"regexp_extract({url}, '^[a-z]+://[^/]*')"
    path = f"coalesce(nullif(regexp_extract({url}, '^[a-z]+://[^/]*(.*)$', 1), ''), '/')"
    return f"""(case coalesce((select any_value(policy) from {p}policy q where q.origin = {origin}), 'allow_all')
      when 'allow_all' then true when 'deny_all' then false
      else coalesce((select arg_min(c.allow, c.rule_no) from {p}chosen c where c.origin = {origin} and c.path is not null and starts_with({path}, c.path)), true) end)"""


# --- crawls -------------------------------------------------------------------------------------

_DEEPEST = 8


def crawl() -> str:
    """CTEs ending in ``results``: a first-in first-out walk, one common table per level."""
    parts = [
        robots(SITE_ROBOTS, "r_"),
        f"""
site as materialized (select *, {norm('final_url')} as final_norm from {SITE}),
a as (select requested_url, final_norm, unnest(range(len(l))) as i, unnest(l) as href from (
    select requested_url, final_norm, regexp_extract_all(content, 'href="([^"]*)"', 1) as l from site where status_code = 200)),
resolved as (select *, case when href like '%:%' then href
     when href like '/%' then regexp_extract(final_norm, '^[a-z]+://[^/]*') || href
     else regexp_replace(final_norm, '[^/]*$', '') || href end as absolute from a),
hops as materialized (select requested_url as source, i, {norm('absolute')} as target from resolved
    where regexp_matches(absolute, '^https?://')
      and regexp_extract({norm('absolute')}, '//([^/]*)', 1) = regexp_extract(final_norm, '//([^/]*)', 1)),
urls as materialized (select u, {verdict('r_', 'u')} as allowed from (
    select requested_url as u from site union select target from hops union select {norm('start_url')} from {SEEDS})),
lvl0 as materialized (select crawl_id, {norm('start_url')} as u, 0 as depth, 1::bigint as rnk, max_depth, respect_robots, delay_ms, start_url from {SEEDS})""",
    ]
    for d in range(1, _DEEPEST + 1):
        seen = "".join(
            f" and not exists (select 1 from lvl{k} s where s.crawl_id = f.crawl_id and s.u = h.target)"
            for k in range(d)
        )
        parts.append(f"""
lvl{d} as materialized (select crawl_id, u, {d} as depth, row_number() over (partition by crawl_id order by o) as rnk,
    max_depth, respect_robots, delay_ms, start_url from (
  select f.crawl_id, h.target as u, min(f.rnk * 100000 + h.i) as o, any_value(f.max_depth) as max_depth,
    any_value(f.respect_robots) as respect_robots, any_value(f.delay_ms) as delay_ms, any_value(f.start_url) as start_url
  from lvl{d - 1} f join hops h on h.source = f.u join urls w on w.u = f.u
  where f.max_depth >= {d} and (w.allowed or not f.respect_robots){seen} group by f.crawl_id, h.target))""")
    union = " union all ".join(f"select * from lvl{k}" for k in range(_DEEPEST + 1))
    parts.append(f"""
visits as materialized (select *, row_number() over (partition by crawl_id order by depth, rnk) as visit_no from ({union})),
results as materialized (select s.page_id, v.crawl_id, v.depth::bigint as depth, v.visit_no, v.u as requested_url, v.max_depth, v.respect_robots, v.delay_ms, v.start_url,
    case when v.respect_robots and not w.allowed then v.u when s.status_code = 200 then s.final_norm else v.u end as url,
    case when v.respect_robots and not w.allowed then 403 when s.requested_url is null then 0 else s.status_code end::bigint as status_code,
    case when v.respect_robots and not w.allowed then null when s.status_code = 200 then {strip(entities("regexp_extract(s.content, '(?is)<title[^>]*>(.*?)</title', 1)"))} end as title,
    case when v.respect_robots and not w.allowed then 'Blocked by robots.txt' when s.requested_url is null then 'Page was not captured' else s.error end as error,
    case when v.respect_robots and not w.allowed then null else s.content end as content
  from visits v join urls w on w.u = v.u left join site s on s.requested_url = v.u)""")
    return "with " + ", ".join(parts)


# Markdown of the answered pages of the site, by the same steps as that of captured pages.
DOCUMENTS = f"""
site_pages as materialized (select page_id, content as html from site where status_code = 200),
{page_md('site_pages')},
documents_of as materialized (select r.*, case when error is not null then
      '# Error Processing Page' || chr(10) || chr(10) || '**URL:** `' || url || '`' || chr(10) || '**Error:** ' || error || chr(10)
    when c.markdown = '' then ''
    when title = '' then c.markdown
    else '# ' || title || chr(10) || '**Source:** `' || url || '`' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || c.markdown end as markdown
  from results r left join cleaned c on c.page_id = r.page_id),
counted_docs as materialized (select *, {count_words('markdown')} as token_count,
    case when error is null then strlen(content) else 0 end::bigint as byte_size from documents_of),
stats as materialized (select crawl_id, any_value(start_url) as start_url, any_value(max_depth)::bigint as max_depth, any_value(delay_ms) as delay_ms,
    any_value(respect_robots) as respect_robots, count(*) filter (error is null)::bigint as n_success,
    count(*) filter (error is not null)::bigint as n_failed, sum(byte_size)::bigint as total_size_bytes,
    sum(token_count)::bigint as estimated_tokens from counted_docs group by crawl_id)"""


def _report() -> str:
    n = "chr(10)"
    head = f"""'# Crawl Statistics for `' || start_url || '`' || {n} || '**Crawl Date:** `2026-01-02 03:04:05`' || {n} || {n} || '---' || {n} || {n}
 || '## Summary' || {n} || '- **Total URLs Processed:** `' || (n_success + n_failed) || '`' || {n}
 || '- **Successful Pages:** `' || n_success || '`' || {n} || '- **Failed Pages:** `' || n_failed || '`' || {n}
 || '- **Total Duration:** `0.00 seconds`' || {n} || '- **Total Content Size:** `' || printf('%.2f', total_size_bytes / 1024.0::double) || ' KB`' || {n}
 || '- **Estimated Tokens:** `' || format('{{:,}}', estimated_tokens) || '`' || {n} || {n} || '---' || {n} || {n}
 || '## Configuration' || {n} || '- **Start URL:** `' || start_url || '`' || {n} || '- **Max Depth:** `' || max_depth || '`' || {n}
 || '- **Delay Between Requests:** `' || delay_ms::bigint || ' ms`' || {n}
 || '- **Respect robots.txt:** `' || case when respect_robots then 'True' else 'False' end || '`' || {n} || {n} || '---' || {n} || {n}
 || '## Successful URLs (' || n_success || ')'"""
    middle = f"""{n} || '---' || {n} || {n} || '## Failed URLs (' || n_failed || ')' || case when n_failed = 0 then {n} || 'None.' else '' end"""
    return f"""{crawl()}, {DOCUMENTS},
texts as (select crawl_id, 0::bigint as part, string_split({head}, {n}) as l from stats
  union all select crawl_id, 2::bigint, string_split({middle}, {n}) from stats),
said as (select crawl_id, part, unnest(range(len(l)))::bigint as place, unnest(l) as line from texts
union all select crawl_id, 1, visit_no, '- `' || url || '`' from results where error is null
union all select crawl_id, 3, visit_no, '- `' || url || ' (Status: ' || status_code || ', Error: ' || error || ')`' from results where error is not null)
select crawl_id, part, row_number() over (partition by crawl_id order by part, place) as line_no, line from said"""


def _kept(step: str) -> str:
    """Tokens left of captured and of rich pages after a step."""
    one = "select '{n}' as source, page_id, pos, tok from ({q})"
    return " union all ".join(
        one.format(n=name, q=f"with {tokens(src)}, {SPANS}, {CONTENT} select page_id, pos, tok from {step}")
        for name, src in (("pages", "pages"), ("rich", RICH))
    )


def oracle_sql() -> dict[str, str]:
    both = f"(select page_id, html from pages union all select page_id, html from {RICH})"
    rules = " union all ".join(
        f"select '{label}' as rule, count(*) as n_elements from typed where kind in ('open', 'raw') and ({_rule(*rule)})"
        for rule, label in ((r, _label(r)) for r in JUNK_RULES)
    )
    dirty = f"with {lines(DIRTY, 'doc_id', 'md')}"
    site_links = (
        f"with {tokens(SITE, 'requested_url, final_url', 'content')}, "
        f"f as (select requested_url, pos::bigint as pos, regexp_extract(tok, 'href=\"([^\"]*)\"', 1) as href, {norm('final_url')} as fn from typed where tag = 'a' and kind = 'open'), "
        "g as (select *, case when href like '%:%' then href when href like '/%' then regexp_extract(fn, '^[a-z]+://[^/]*') || href "
        "else regexp_replace(fn, '[^/]*$', '') || href end as absolute from f) "
    )
    name = "replace(replace(regexp_extract(url, '//([^/?#]*)', 1), '.', '_'), '-', '_')"
    return {
        "normalized_urls": f"select page_id, url, {norm('url')} as normalized from pages",
        "pages_per_host": "select lower(regexp_extract(url, '//([^/?#]*)', 1)) as host, count(*) as n_pages from pages group by 1",
        "fetches": f"select page_id, {norm('url')} as requested_url, url as final_url, 200 as status_code, length(html)::bigint as n_chars "
        f"from pages qualify row_number() over (partition by {norm('url')} order by page_id) = 1",
        "fetch_outcomes": f"""select requested_url, case when status_code = 200 then {norm('final_url')} else requested_url end as url, status_code,
            case when status_code = 200 then {strip(entities("regexp_extract(content, '(?is)<title[^>]*>(.*?)</title', 1)"))} end as title, error,
            status_code = 200 and {norm('final_url')} <> {norm('requested_url')} as is_redirect, strlen(content)::bigint as n_bytes from {SITE}""",
        "redirects": f"select requested_url, {norm('final_url')} as url from {SITE} where status_code = 200 and {norm('final_url')} <> {norm('requested_url')}",
        "page_titles": f"select page_id, {_TITLE} as title from pages",
        "html_tokens": f"with {tokens('pages')} select page_id, pos, kind, tag, tok from typed",
        "element_spans": f"with {tokens('pages')}, {SPANS} select page_id, pos, tag, close_pos from spans",
        "comments_dropped": f"with {tokens('pages')} select page_id, count(*) as n_tokens from typed where kind <> 'comment' group by page_id",
        "page_links": f"""with {tokens('pages', 'page_id, url')} select page_id, pos, regexp_extract(tok, 'href="([^"]*)"', 1) as href,
            regexp_extract({norm('url')}, '^[a-z]+://[^/]*') || rtrim(regexp_extract(tok, 'href="([^"]*)"', 1), '/') as target
            from typed where tag = 'a' and kind = 'open'""",
        "links_resolved": site_links + "select requested_url, pos, href, absolute from g",
        "links_scoped": site_links + f"select requested_url, pos, {norm('absolute')} as target from g where absolute like 'http%' "
        f"and regexp_extract({norm('absolute')}, '//([^/]*)', 1) = regexp_extract(fn, '//([^/]*)', 1)",
        "junk_removed": _kept("clean"),
        "main_content": _kept("content"),
        "optional_end_tags": f"""with {tokens(CLOSED)}, {SPANS}, {CONTENT}
            select page_id, row_number() over (partition by page_id order by pos) as place, tok from content where kind = 'text'""",
        "misnested_tags": f"""with recursive {tokens(MISNESTED)}, {WALKED}, {CONTENT}
            select page_id, row_number() over (partition by page_id order by pos) as place, tok from content where kind = 'text'""",
        "misnested_spans": f"with recursive {tokens(MISNESTED)}, {WALKED} select page_id, pos, tag, close_pos as end_pos from spans",
        "junk_by_rule": f"with {tokens(both)}, counts as ({rules}) select rule, n_elements from counts where n_elements > 0",
        "md_blocks": f"{rendered('pages')} select page_id, (dense_rank() over (partition by page_id order by block))::bigint as place, kind, sep, line from rendered",
        "md_headings": f"{rendered('pages')} select page_id, line from rendered where kind = 'heading'",
        "md_lists": f"{rendered(RICH)} select page_id, sep, line from rendered where kind = 'item'",
        "md_links": f"{rendered(RICH)} select page_id, line from rendered where contains(line, '](x?p=')",
        "md_images": f"{rendered(RICH)} select page_id, line from rendered where contains(line, '![')",
        "md_code": f"{rendered(RICH)} select page_id, kind, line from rendered where contains(line, '`')",
        "rich_markdown": f"with {page_md(RICH)} select page_id, markdown from cleaned",
        "fence_state": f"{dirty} select doc_id, line_no, is_fence, in_code from fenced",
        "gibberish_lines": f"{dirty} select doc_id, line_no, line from judged where gibberish",
        "short_lines": f"{dirty} select doc_id, line_no, line from judged where short",
        "low_variety_lines": f"{dirty} select doc_id, line_no, line from judged where monotone",
        "clean_lines": f"{dirty} select doc_id, markdown from cleaned",
        "page_documents": f"with {page_md('pages')}, {DOCS} select page_id, url, title, markdown from docs",
        "token_counts": f"with {page_md('pages')}, {DOCS} select page_id, {count_words('markdown')} as token_count from docs",
        "byte_sizes": "select page_id, strlen(html)::bigint as byte_size from pages",
        "robots_rules": f"with {robots(PAGE_ROBOTS, '')} select origin, entry_no, agents, rule_no, path, allow from rules",
        "robots_policy": f"with {robots(PAGE_ROBOTS, '')} select origin, policy from policy",
        "robots_verdicts": f"with {robots(PAGE_ROBOTS, '')}, u as (select page_id, {norm('url')} as url from pages) select page_id, url, {verdict('', 'url')} as allowed from u",
        "robots_verdicts_by_prefix": f"with {robots(PAGE_ROBOTS, '')}, u as (select page_id, {norm('url')} as url from pages) select page_id, url, {verdict('', 'url')} as allowed from u",
        "result_links": f"""{crawl()} select r.crawl_id, row_number() over (partition by r.crawl_id order by r.visit_no, h.i) as place, r.requested_url, h.target
            from results r join hops h on h.source = r.requested_url where r.error is null""",
        "crawl_site": f"{crawl()} select crawl_id, depth, requested_url, url, status_code, title, error, error is null and url <> requested_url as is_redirect from results",
        "crawl_depths": f"{crawl()} select crawl_id, depth, count(*) as n_urls from results group by all",
        "crawl_order": f"{crawl()} select crawl_id, visit_no, requested_url from results",
        "crawl_progress": f"""{crawl()}, {DOCUMENTS} select crawl_id, url, visit_no as pages_so_far,
            (sum(token_count) over w)::bigint as tokens_so_far, (sum(byte_size) over w)::bigint as bytes_so_far from counted_docs
            window w as (partition by crawl_id order by visit_no rows unbounded preceding)""",
        "fetch_plan": f"""{crawl()}, p as (select *, case when error is null then delay_ms else 0.0::double end as pause_ms from results)
            select crawl_id, requested_url, pause_ms, coalesce(sum(pause_ms) over (partition by crawl_id order by visit_no rows between unbounded preceding and 1 preceding), 0.0::double) as offset_ms from p""",
        "crawl_documents": f"{crawl()}, {DOCUMENTS} select crawl_id, requested_url, markdown, token_count, byte_size from counted_docs",
        "crawl_stats": f"{crawl()}, {DOCUMENTS} select * from stats",
        "crawl_outcomes": f"""{crawl()} select crawl_id, visit_no, error is null as succeeded, case when error is null then url
            else url || ' (Status: ' || status_code || ', Error: ' || error || ')' end as label from results""",
        "stats_summary": f"{crawl()}, {DOCUMENTS} select crawl_id, n_success + n_failed as n_total, n_success, n_failed, total_size_bytes / 1024.0::double as total_kb, estimated_tokens from stats",
        "combined_corpus": f"""{crawl()}, {DOCUMENTS} select crawl_id, row_number() over (partition by crawl_id order by visit_no) as place, case when visit_no = min(visit_no) over (partition by crawl_id) then markdown
            else chr(10) || chr(10) || '---' || chr(10) || chr(10) || markdown end as chunk from counted_docs where markdown <> ''""",
        "stats_report": _report(),
        "output_names": f"select page_id, {name} || '-020126.md' as file_name, {name} || '-020126_stats.md' as report_name from pages",
    }


def _label(rule: tuple[str, str, str | None]) -> str:
    kind, name, value = rule
    return name if kind == "tag" else f"[{name}{'=' if kind == 'equals' else '*='}{value}]"
