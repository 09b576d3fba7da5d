"""The same questions in plain SQL over the same tables, for the correctness gate."""

from __future__ import annotations

from factsieve.functions import kinds as K
from factsieve.functions.ontology import ENTRIES, SOCIAL_RULES, SINGULAR_WORDS, TYPE_RULES
from factsieve.functions.text import STOP_WORDS
from factsieve.functions.urls import NON_HTML_EXTENSIONS, TRACKING_PARAM
from factsieve.workloads.rendered import CARDS_PER_PAGE, ORDERS_PER_PAGE, PAGES_PER_WALK

SPACES = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def squish(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACES}', ' ', 'g'))"


def squish_block(x: str) -> str:
    x = f"regexp_replace({x}, '[\\x{{00a0}}\\x{{2000}}-\\x{{200b}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', ' ', 'g')"
    x = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    x = f"regexp_replace({x}, '\\s*\\n\\s*\\n\\s*', chr(10) || chr(10), 'g')"
    x = f"regexp_replace({x}, '[ \\t]*\\n[ \\t]*', chr(10), 'g')"
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def raw_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({squish(x)}), '[^a-z0-9]+'), lambda t: t <> '')"


STOPS = "[" + ", ".join(q(w) for w in STOP_WORDS) + "]"


def tokens(x: str) -> str:
    raw = raw_tokens(x)
    kept = f"list_filter({raw}, lambda t: not list_contains({STOPS}, t))"
    return f"(case when len({kept}) > 0 then {kept} else {raw} end)"


def alnum(x: str) -> str:
    return f"regexp_replace(lower({squish(x)}), '[^a-z0-9]+', '', 'g')"


def grams(w: str) -> str:
    return f"list_distinct(list_transform(range(1, length({w}) + 2), lambda i: substr('  ' || {w} || ' ', i, 3)))"


def dice(a: str, b: str) -> str:
    shared = f"len(list_intersect({grams(a)}, {grams(b)}))"
    return (
        f"(case when {a} = '' or {b} = '' then 0.0::double when {a} = {b} then 1.0::double else "
        f"2.0::double * {shared} / (len({grams(a)}) + len({grams(b)})) end)"
    )


def half_up(x: str, scale: int) -> str:
    return f"floor(({x})::double * {scale} + 0.5) / {scale}"


def overlap(a: str, b: str) -> str:
    return f"(case when len({a}) > 0 then len(list_filter({a}, lambda t: list_contains({b}, t)))::double / len({a}) else 0.0::double end)"


HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1))"
SCHEME = "regexp_extract(url, '^([a-zA-Z]+)://', 1)"
ORIGIN = f"({SCHEME} || '://' || {HOST})"
PATH = "(case when regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) = '' then '/' else regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) end)"
QUERY = "regexp_extract(url, '\\?([^#]*)', 1)"


def normalized(url: str = "url") -> str:
    host, path, query, scheme = (s.replace("url", url) if url != "url" else s for s in (HOST, PATH, QUERY, SCHEME))
    tracking = TRACKING_PARAM.replace("'", "''")
    kept = f"list_sort(list_filter(string_split({query}, '&'), lambda p: p <> '' and not regexp_matches(split_part(p, '=', 1), '{tracking}')))"
    return (
        f"({scheme} || '://' || regexp_replace({host}, '^www\\.', '') || case when length({path}) > 1 then regexp_replace({path}, '/$', '') else {path} end"
        f" || case when len({kept}) > 0 then '?' || array_to_string({kept}, '&') else '' end)"
    )


PHONE = K.PHONE_PATTERN.replace("'", "''")
UI = K.UI_PHRASE.replace("'", "''")
ADDRESS_HINT = rf"(?i)\d|\b({K.ADDRESS_WORDS})\b"
ADDRESS_LEGAL = r"(?i)\b(cookie|privacy policy|terms|copyright|all rights reserved|subscribe)\b"


def letters_ok(s: str) -> str:
    return f"length(regexp_replace({s}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))::double / length({s}) >= 0.5"


def valid_text(s: str, lo: int, hi: int) -> str:
    return f"(length({s}) between {lo} and {hi} and not regexp_matches({s}, '{UI}') and {letters_ok(s)})"


def valid_phone(s: str, context: bool) -> str:
    d = f"regexp_replace({s}, '[^0-9]', '', 'g')"
    near = f"or length({d}) <= 11" if context else ""
    same = " and ".join(f"{d} <> repeat('{n}', length({d}))" for n in range(10))
    return (
        f"(length({d}) between 7 and 16 and not regexp_matches({s}, '^\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}') "
        f"and not regexp_matches({s}, '^\\d{{1,2}}[-/]\\d{{1,2}}[-/]\\d{{2,4}}$') and not regexp_matches({s}, '\\b(19|20)\\d{{2}}\\s*[-–]\\s*(19|20)\\d{{2}}\\b') "
        f"and (regexp_matches({s}, '[+\\-().\\s]') or length({d}) < 10 {near}) and {same} and not contains('0123456789', {d}))"
    )


def _alias_rows() -> str:
    rows: dict[str, tuple[str, int]] = {}
    for pos, (kind, e) in enumerate(ENTRIES.items()):
        for at, alias in enumerate([kind.replace("_", " "), *(a.lower() for a in e["aliases"])]):
            rows[alias] = (kind, rows.get(alias, ("", pos * 1000 + at))[1])
    return ", ".join(f"({q(a)}, {q(k)}, {p})" for a, (k, p) in rows.items())


def _rules(column: str, rules, value) -> str:
    return "case " + " ".join(f"when regexp_matches({column}, {q(pattern)}) then {value(name)}" for pattern, name in rules) + " end"


_ENDINGS = "['Phone Number', 'Prices', 'Gallery Images', 'Zibble', 'Opening Hours', 'contact e-mail', 'Web Site', 'Delivery Fee', 'Status', 'Facebook Link']"
_KEY = "coalesce(nullif(trim(regexp_replace(lower(regexp_replace(label, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'field')"
LABELS = f"""labels0 as (select p_partkey::int as pos, case when p_partkey % 3 = 0 then {_ENDINGS}[(p_partkey % 10 + 1)::int]
 else p_name || ' ' || {_ENDINGS}[(p_partkey % 10 + 1)::int] end as label from part),
 labels1 as (select {_KEY} as key, arg_min(label, pos) as label, min(pos) as pos from labels0 group by 1)"""

_COUNTED = ("html", "head", "meta", "title", "style", "script", "body", "a", "li", "p", "b", "br", "div", "article", "h1", "nav", "ul", "footer")
_UNESCAPE = "replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


def unescape(x: str) -> str:
    return _UNESCAPE.format(x=x)


TITLE = squish(unescape("regexp_extract(html, '<title>([^<]*)</title>', 1)"))
H1 = squish(unescape("regexp_extract(html, '<h1>([^<]*)</h1>', 1)"))

_BLOCK = f"(s_suppkey // {CARDS_PER_PAGE})"
_CARDS = f"""cards as (select {_BLOCK} as page_id, s_suppkey, s_name, n_name, '09-42' || lpad(s_suppkey::varchar, 7, '0') as phone,
 row_number() over (partition by {_BLOCK} order by s_suppkey) - 1 as record_index, count(*) over (partition by {_BLOCK}) as n
 from supplier join nation on s_nationkey = n_nationkey)"""

_SPAN = ORDERS_PER_PAGE * PAGES_PER_WALK
_LAT = "((s_suppkey % 80)::varchar || '.' || lpad((s_suppkey % 9000 + 1000)::varchar, 4, '0'))"
_LNG = "((s_suppkey % 170)::varchar || '.' || lpad((s_suppkey % 8000 + 1000)::varchar, 4, '0'))"
_PRICE = "p_retailprice::decimal(18,2)::varchar"


def _rows(source: str, key: str, *rows: tuple[str, str, str, str]) -> str:
    return " union all ".join(
        f"select {key} as page_id, {q(field)} as field_key, {value} as value, {confidence}::double as confidence, {method} as method from {source}"
        for field, value, confidence, method in rows
    )


ORACLES: dict[str, str] = {
    "url_normalize": f"select page_id, {normalized()} as url_key from pages",
    "url_identity": f"""select page_id, case when page_id % 2 = 0 then {ORIGIN} || '/img/' || page_id || '.jpg?v=1'
 else {ORIGIN} || '/img/' || page_id || '.jpg' end as identity from pages""",
    "url_pagenum": """select page_id, case when regexp_matches(url, '(?i)[?&](page|paged|pg|pagenum|page_num|pageno|page_number)=\\d+') then
 regexp_extract(url, '(?i)[?&](?:page|paged|pg|pagenum|page_num|pageno|page_number)=(\\d+)', 1)::bigint end as page_number,
 case when regexp_matches(url, '(?i)[?&](page|paged|pg|pagenum|page_num|pageno|page_number)=\\d+') then 'query' end as kind from pages""",
    "url_site": f"""select page_id, coalesce(nullif(regexp_extract(regexp_replace({HOST}, '^www\\.', ''), '([^.]+\\.[^.]+)$', 1), ''), {HOST}) as site,
 {ORIGIN} as origin, (regexp_extract(lower({PATH}), '\\.([a-z0-9]{{1,5}})$', 1) in ({', '.join(q(e) for e in NON_HTML_EXTENSIONS)}))::int as non_html,
 (regexp_extract({HOST}, '([^.]+\\.[^.]+)$', 1) = 'example.com')::int as on_example_com from pages""",
    "url_tokens": f"""select page_id, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace({PATH},
 '(?i)\\.(html?|php|aspx?|jsp|jspx|shtml|cfm|do)$', '') || ' ' || {QUERY}), '[^a-z0-9]+'), lambda t: length(t) > 1), ' ') as tokens from pages""",
    "seed_check": f"""with s as (select page_id % 4 as form, regexp_replace(url, '^https?://', '') as bare, url, page_id from pages),
 t as (select form, case form when 0 then url when 1 then bare when 2 then 'ftp://' || bare else 'host' || page_id end as input,
 regexp_replace(case form when 0 then url else 'https://' || bare end, '#.*$', '') as u from s)
 select input, case when form < 2 then {SCHEME.replace('url', 'u')} || '://' || {HOST.replace('url', 'u')} || {PATH.replace('url', 'u')} ||
 case when {QUERY.replace('url', 'u')} <> '' then '?' || {QUERY.replace('url', 'u')} else '' end else '' end as url,
 case form when 2 then 'Unsupported protocol "ftp:" (only http/https).' when 3 then 'Hostname "' || input || '" does not look like a domain.' else '' end as reason from t""",
    "text_clean": f"""select doc_id, md5({squish('text')}) as squished, md5({squish_block('text')}) as blocks,
 case when length({squish('text')}) <= 40 then {squish('text')} else substr({squish('text')}, 1, 39) || '…' end as short from documents""",
    "text_tokens": f"""select doc_id, len({raw_tokens('text')}) as n_raw, md5(array_to_string({tokens('text')}, ' ')) as tokens,
 coalesce(nullif(trim(regexp_replace(lower(source || ' ' || lang), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'field') as key from documents""",
    "trigram_names": f"""with s as (select p_partkey, {alnum('p_name')} as a, {alnum("lower(p_type) || ' ' || reverse(p_name)")} as b,
 {tokens('p_name')} as ta, {tokens("p_type || ' ' || p_name")} as tb, p_name, p_type from part)
 select p_partkey, {half_up(dice('a', 'b'), 10000)} as dice, {overlap('ta', 'tb')} as overlap,
 contains(lower(p_type || ' ' || reverse(p_name)), lower(p_name))::int as contained from s""",
    "doc_emails": f"""with m as (select doc_id, unnest(list_distinct(regexp_extract_all(text, '{K.EMAIL_PATTERN}'))) as raw from documents),
 e as (select distinct doc_id, lower(raw) as value from m)
 select doc_id, value from e where regexp_matches(value, '{K.EMAIL_SHAPE}')
 and not regexp_matches(value, '@(example|test|domain|yourdomain|email|sentry|sentry\\.io|wixpress|localhost|mysite|site)\\b')
 and not regexp_matches(value, '\\.(png|jpe?g|gif|webp|css|js)$') and not regexp_matches(value, '^(no-?reply|postmaster|abuse|webmaster)@')
 and length(value) <= 254 and not regexp_matches(value, '@\\d+x\\.')""",
    "doc_phones": f"""with m as (select doc_id, {squish('unnest(list_distinct(regexp_extract_all(text, ' + q(K.PHONE_PATTERN) + ')))')} as s from documents),
 v as (select doc_id, s, regexp_replace(s, '[^0-9]', '', 'g') as d from m where {valid_phone('s', True)})
 select distinct doc_id, case when starts_with(s, '+') or regexp_matches(s, '^00\\d') then '+' || regexp_replace(d, '^00', '') else regexp_replace(d, '^00', '') end as value from v""",
    "doc_prices": f"""select p_partkey, price from (select p_partkey, unnest(['USD ' || {_PRICE} || ' per night', p_size::varchar || ' EUR']) as price from part)""",
    "line_kinds": f"""with l as (select doc_id, {squish("unnest(string_split(text, chr(10)))")} as s from documents)
 select doc_id, count(*) filter (where {valid_text('s', 2, 400)}) as n_text, count(*) filter (where {valid_text('s', 2, 160)}) as n_name,
 count(*) filter (where length(s) between 30 and 5000 and contains(s, ' ') and not regexp_matches(s, '{UI}')) as n_description,
 count(*) filter (where length(s) between 8 and 300 and regexp_matches(s, {q(ADDRESS_HINT)}) and length(regexp_replace(s, '[^|]', '', 'g')) <= 2
 and len(string_split(s, ' ')) <= 45 and not regexp_matches(s, {q(ADDRESS_LEGAL)})) as n_address,
 count(*) filter (where {valid_text('s', 2, 200)}) as n_list, count(*) filter (where length(s) between 4 and 80) as n_date,
 count(*) filter (where try_cast(regexp_extract(s, '(\\d+(?:\\.\\d+)?)', 1) as double) between 0 and 100) as n_rating,
 count(*) filter (where regexp_matches(s, '^[\\d.,\\s]+$') and regexp_matches(regexp_replace(s, '[\\s,]', '', 'g'), '^(\\d+\\.?\\d*|\\.\\d+)?$')) as n_number,
 count(*) filter (where length(s) between 5 and 400 and regexp_matches(s, '(?i)\\d|closed|24\\s*hours')
 and regexp_matches(s, '(?i)(mon|tue|wed|thu|fri|sat|sun|daily|weekday|weekend|open|closed|am|pm|\\d{{1,2}}:\\d{{2}})')) as n_hours
 from l group by doc_id""",
    "identity_words": """select c_custkey, case c_custkey % 3 when 0 then '0064 (9) ' || lpad(c_custkey::varchar, 7, '0') || ' ext. 12'
 when 1 then 'desk.' || c_custkey || '@shop.example' else c_name || ' , ' || c_mktsegment end as shown,
 case c_custkey % 3 when 0 then '+649' || lpad(c_custkey::varchar, 7, '0') when 1 then 'desk.' || c_custkey || '@shop.example'
 else lower(replace(c_name, '#', ' ') || ' ' || c_mktsegment) end as identity from customer""",
    "map_coordinates": f"select s_suppkey, {_LAT} as latitude, {_LNG} as longitude, 1 as valid from supplier",
    "social_profiles": """with u as (select c_custkey, ['www.facebook.com', 'instagram.com', 'x.com', 'uk.linkedin.com', 'pinterest.co.uk', 'notfacebook.com'][(c_custkey % 6 + 1)::int] as h,
 c_custkey % 5 in (0, 4) as own from customer)
 select c_custkey, (own and h = 'www.facebook.com')::int as facebook, (own and h = 'instagram.com')::int as instagram, (own and h = 'x.com')::int as twitter,
 (own and h = 'uk.linkedin.com')::int as linkedin, (own and h = 'pinterest.co.uk')::int as pinterest from u""",
    "csv_cells": """select p_partkey, case p_partkey % 5 when 0 then '''=' || p_name when 1 then '''+' || p_name when 2 then '''@' || p_name
 when 3 then 'plain ' || p_name else '"say ""hi"", ' || p_name || '"' end as cell from part""",
    "label_kinds": f"""with {LABELS}, alias(alias, kind, pos) as (values {_alias_rows()}),
 l as (select label, lower(label) as norm, trim(regexp_replace(regexp_replace(lower(label), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')) as loose from labels1),
 k as (select *, regexp_replace(loose, '\\b(\\w+)s\\b', '\\1', 'g') as single, {tokens('norm')} as lw, {alnum('norm')} as lb from l),
 a as (select *, {tokens('alias')} as aw, {alnum('alias')} as ab from alias),
 f as (select k.label, a.kind, a.pos, greatest(
 case when {overlap('aw', 'lw')} >= 0.75 then 0.6::double + 0.2::double * {overlap('aw', 'lw')} + 0.1::double * {overlap('lw', 'aw')} else 0 end,
 case when contains(norm, alias) and length(alias) >= 4 then 0.7::double + least(0.15::double, length(alias)::double / 100) else 0 end,
 case when {dice('lb', 'ab')} >= 0.55 then {dice('lb', 'ab')} * 0.8::double else 0 end) as score from k, a),
 b as (select label, kind, score from f where score >= 0.55 qualify row_number() over (partition by label order by score desc, pos) = 1)
 select k.label, coalesce(x.kind, y.kind, z.kind, b.kind, '') as kind,
 {half_up('case when x.kind is not null then 1 when y.kind is not null then 0.98::double when z.kind is not null then 0.9::double else coalesce(b.score, 0) end', 10000)} as score
 from k left join alias x on x.alias = norm left join alias y on y.alias = loose left join alias z on z.alias = single left join b on b.label = k.label""",
    "label_types": f"""with {LABELS}, t as (select *, {_rules('label', [(rf'(?i)\b({p})\b', k) for p, k, _ in TYPE_RULES], q).replace(' end', " else 'text' end")} as type,
 coalesce({_rules('label', [(rf'(?i)\b({p})\b', str(pl).lower()) for p, k, pl in TYPE_RULES], str)}, false) as typed,
 coalesce({raw_tokens('label')}[-1], '') as last from labels1)
 select key, label, type, (typed or case when type in ('image_list', 'list') then true when last in ({', '.join(q(w) for w in SINGULAR_WORDS)}) then false
 when regexp_matches(last, '^(images?|photos?)$') then ends_with(last, 's')
 else regexp_matches(label, '(?i)\\b(\\w+s|\\w+es|amenities|facilities|galleries|all|list|multiple|every|each)\\b\\s*$') and ends_with(last, 's') end)::int as plural,
 coalesce({_rules('lower(label)', [(rf'\b({p})\b' + (r'|(^|\s)x(\s|$)' if n == 'twitter' else ''), n) for n, p in SOCIAL_RULES], q)}, '') as social from t""",
    "node_counts": "select * from (" + " union all ".join(
        f"select page_id, {q(t)} as tag, len(regexp_extract_all(html, '<{t}[ >]')) as n from pages" for t in _COUNTED) + ") where n > 0",
    "page_titles": f"select page_id, {TITLE} as title from pages",
    "page_headings": f"select page_id, {H1} as h1 from pages",
    "page_links": f"""with a as (select page_id, url as page_url, generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">[^<]*'), 1) as i,
 unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*')) as tag from pages),
 h as (select page_id, i, {squish(unescape("regexp_extract(tag, '>(.*)$', 1)"))} as text, {unescape("regexp_extract(tag, 'href=\"([^\"]*)\"', 1)")} as href, page_url as url from a),
 r as (select page_id, i, text, {ORIGIN} || array_to_string(list_transform(regexp_extract_all(href, '[^\\x00-\\x7f]+|[\\x00-\\x7f]+'),
 lambda c: case when regexp_matches(c, '^[^\\x00-\\x7f]') then url_encode(c) else c end), '') as u from h where starts_with(href, '/')),
 n as (select *, {normalized('u')} as url_key from r)
 select page_id, arg_min(u, i) as url, url_key, arg_min(text, [-length(text), i]) as text, 1 as in_nav from n group by page_id, url_key""",
    "page_names": f"""with n as (select page_id, {H1} as h1, {TITLE} as title, regexp_split_to_array({TITLE}, '\\s+[|–—-]\\s+')[1] as short from pages)
 select page_id, case when {valid_text('h1', 2, 160)} then h1 when {valid_text('short', 2, 160)} then short when {valid_text('title', 2, 160)} then title else '' end as name,
 case when {valid_text('h1', 2, 160)} then 'h1' when {valid_text('short', 2, 160)} then '<title>' when {valid_text('title', 2, 160)} then '<title> (full)' else '' end as method,
 case when {valid_text('h1', 2, 160)} then 0.75::double when {valid_text('short', 2, 160)} then 0.7::double when {valid_text('title', 2, 160)} then 0.6::double else 0::double end as confidence from n""",
    "supplier_cards": f"""with {_CARDS} select record_index, s_name as name, phone as phone_number, 'No.' || s_suppkey || ', Market Road, ' || n_name as address,
 'http://dir.example/suppliers/' || page_id as source_url from cards where n >= 3""",
    "list_warnings": f"""with {_CARDS}, p as (select page_id, count(*) as n, 'http://dir.example/suppliers/' || page_id as url from cards group by 1)
 select '' as site, page_id, case when page_id % 2 = 1 then url || ': unexpected content-type "application/pdf"; skipped.' else 'Page has ' || n || ' list items; kept the first 10 (maxRecords).' end as message
 from p where page_id % 2 = 1 or n > 10 union all
 select url, 0, 'No repeating list structure on this page yielded the requested labels. If this is a single-subject page, use mode "single".'
 from (select url from p where page_id % 2 = 1 or n < 3 union all select 'http://dir.example/about')""",
    "supplier_json": f"""with {_CARDS} select page_id, record_index, '{{"name":"Store ' || translate(s_suppkey::varchar, '0123456789', 'abcdefghij') || '","phone_number":'
 || case when s_suppkey % 5 = 0 then 'null' else '"' || phone || '"' end || ',"address":"Market Road, ' || n_name || '","_source_url":"http://dir.example/suppliers/' || page_id || '"}}' as json
 from cards where n >= 3""",
    "supplier_coverage": f"""with {_CARDS} select page_id as site, field_key, found_in, "of", floor(found_in * 100.0 / "of" + 0.5)::int as percent from (
 select page_id, 'name' as field_key, count(*) as found_in, count(*) as "of" from cards group by 1 union all
 select page_id, 'address', count(*), count(*) from cards group by 1 union all
 select page_id, 'phone_number', count(*) filter (where s_suppkey % 5 <> 0), count(*) from cards group by 1)""",
    "part_jsonld": _rows(
        "part", "p_partkey", ("product_name", "p_name", "0.95", "'jsonld:Product.name'"), ("price", f"'USD ' || {_PRICE}", "0.95", "'jsonld:Product.price'"),
        ("sku", "'SKU-' || p_partkey", "0.95", "'jsonld:Product.sku'")),
    "part_microdata": _rows(
        "part", "p_partkey", ("product_name", "p_name", "0.86", "'microdata:Product.name'"), ("price", f"'USD ' || {_PRICE}", "0.86", "'microdata:Product.price'"),
        ("sku", "'SKU-' || p_partkey", "0.86", "'microdata:Product.sku'")),
    "part_entries": " union all ".join(
        f"select p_partkey as page_id, '{k}' as key, '{p}' as path, {v} as value, {m} as is_primary from part"
        for k, p, v, m in (
            ("price", "Product.price", f"'USD ' || {_PRICE}", 1), ("name", "Product.name", "p_name", 1), ("sku", "Product.sku", "'SKU-' || p_partkey", 1),
            ("name", "Product.Brand.name", "p_brand", 0), ("price", "Product.Offer.price", _PRICE, 1), ("pricecurrency", "Product.Offer.priceCurrency", "'USD'", 1))),
    "customer_pairs": " union all ".join(
        f"select c_custkey as page_id, '{k}' as field_key, {v} as value, {c}::double as confidence from customer"
        for k, v, c in (
            ("name", "c_name", "0.77"), ("phone_number", "'+64 9 ' || lpad(c_custkey::varchar, 7, '0')", "0.74"), ("industry", "c_mktsegment", "0.77"),
            ("email", "'desk' || c_custkey || '@mail' || c_nationkey || '.example.org'", "0.77"))),
    "customer_pair_shapes": " union all ".join(
        f"select c_custkey as page_id, ['dl', 'table', 'inline'][(c_custkey % 3 + 1)::int] as kind, '{k}' as label, {v} as value from customer"
        for k, v in (
            ("Name", "c_name"), ("Telephone", "'+64 9 ' || lpad(c_custkey::varchar, 7, '0')"), ("Industry", "c_mktsegment"),
            ("Email", "'desk' || c_custkey || '@mail' || c_nationkey || '.example.org'"))),
    "part_pictures": " union all ".join((
        "select p_partkey as page_id, 'main_image' as field_key, 'https://cdn.example/p/' || p_partkey || '/front.jpg?w=1200' as value, 0.95::double as confidence, 'image:meta:og:image' as method from part",
        """select p_partkey, 'gallery_images', array_to_string(list_transform(['/a.jpg', '/b-2000.jpg', '/c-1600.webp'], lambda f: 'https://cdn.example/p/' || p_partkey || f), ' | '),
 0.9::double, 'image:img[data-src]' from part""")),
    "supplier_profiles": _rows(
        "supplier", "s_suppkey", ("address", "s_suppkey || ' Harbour Street, Port Town ' || lpad(s_suppkey::varchar, 5, '0')", "0.8", "'<address>'"),
        ("latitude", _LAT, "0.85", "'meta:icbm'"), ("longitude", _LNG, "0.85", "'meta:icbm'"),
        ("facebook", "'https://www.facebook.com/supplier' || s_suppkey", "0.8", "'a[href] (facebook profile)'"),
        ("opening_hours", "'Mon-Fri ' || (s_suppkey % 4 + 6) || ':00-18:00'", "0.45", "'pattern match over page text (joined)'"),
        ("website", "'http://s' || s_suppkey || '.example/'", "0.8", "'link:canonical (site origin)'")),
    "supplier_facilities": _rows(
        "supplier", "s_suppkey", ("amenities", "'Loading dock ' || s_suppkey || ' | Cold store ' || s_suppkey", "0.74", "'list under \"Facilities\"'"),
        ("description", "'Supplier ' || s_suppkey || ' ships parts to every region of the world.'", "0.77", "'meta:description'")),
    "supplier_contacts": _rows(
        "supplier", "s_suppkey", ("email", "'desk' || s_suppkey || '@s' || s_suppkey || '.example'", "0.8", "'a[href^=mailto:]'"),
        ("latitude", _LAT, "0.62", "'coordinates parsed from map URL'"), ("longitude", _LNG, "0.62", "'coordinates parsed from map URL'"),
        ("fax_number", "'+64 9 ' || lpad(s_suppkey::varchar, 7, '0')", "0.74", "'label pair (dl): \"Fax\"'"),
        ("whats_app", "'+64 21 ' || lpad(s_suppkey::varchar, 7, '0')", "0.77", "'label pair (dl): \"WhatsApp\"'"),
        ("description", "'Supplier ' || s_suppkey || ' keeps a yard beside the canal and answers every letter within two days of its arrival.'", "0.42", "'longest matching <p>'"),
        ("main_image", "'http://s' || s_suppkey || '.example/hero/' || s_suppkey || '.jpg'", "0.95", "'image:style:background-image'")),
    "long_pages": "select doc_id as page_id, length(trim(regexp_replace(repeat(regexp_replace(coalesce(text, ''), '[^\\p{L}]+', ' ', 'g') || ' ', 3), ' +', ' ', 'g'))) as chars from documents",
    "page_next": """select page_id, url, contains(html, 'rel="next"') as has_controls, nullif(regexp_extract(html, 'rel="next" href="([^"]*)"', 1), '') as next_url,
 null::varchar as reason from pages""",
    "order_walk": f"""with o as (select o_orderkey // {_SPAN} as w, (o_orderkey % {_SPAN}) // {ORDERS_PER_PAGE} as step, o_orderkey % {ORDERS_PER_PAGE} as at, * from orders),
 p as (select *, count(*) over (partition by w, step) as cards, max(step) over (partition by w) as last from o),
 s as (select w, min(step) filter (where cards < 3) as short, max(last) as last from p group by w)
 select 'http://orders.example/orders/' || p.w || '?page=1' as site, p.step::int as step, p.at::int as at, 'Order ' || lpad(o_orderkey::varchar, 9, '0') as name,
 'USD ' || o_totalprice::decimal(18,2) as price, o_orderpriority as category, 'http://orders.example/orders/' || p.w || '?page=' || (p.step + 1) as source_url,
 coalesce(s.short, s.last + 1)::bigint as pages_walked, case when s.short is not null then 'page ' || (s.short + 1) || ' contained no list rows'
 when s.last = 0 then 'no pagination controls on this page' else 'reached the last page (no further "next" link)' end as stop_reason
 from p join s using (w) where s.short is null or p.step < s.short""",
    "site_answers": " union all ".join(
        f"select 'http://c' || c_custkey || '.example/' as site, '{k}' as field_key, {v} as value, 'http://c' || c_custkey || '{u}' as source_url, {c}::double as confidence, 2::bigint as pages, 1::int as depth, 'ok' as status from customer"
        for k, v, u, c in (("business_name", "c_name", ".example", "0.75"), ("phone_number", "'+64 9 ' || lpad(c_custkey::varchar, 7, '0')", ".example/contact.html", "0.74"))),
    "gated_snapshots": f"""with c as (select *, c_custkey % 5 = 0 as shut, lpad(c_custkey::varchar, 7, '0') as d from customer)
 select 'http://r' || c_custkey || '.example/' as site, k.field_key, case when shut then '' when k.field_key = 'business_name' then c_name else '+64 9 ' || d end as value,
 case when shut then -1 when c_custkey % 3 = 0 then c_custkey * 4 + 1 else c_custkey * 4 end::bigint as page_id, case when shut then 'error' else 'ok' end as status
 from c, (select unnest(['business_name', 'phone_number']) as field_key) k""",
    "matched_answers": """select 'http://m' || c_custkey || '.example/' as site, k.field_key, case when k.field_key = 'business_name' then c_name when c_custkey % 4 in (0, 1) then '' else c_mktsegment end as value,
 case when k.field_key = 'business_name' then 0.75 when c_custkey % 4 in (0, 1) then 0 else 0.6 end::double as confidence,
 case when k.field_key = 'business_name' then 'h1' when c_custkey % 4 in (0, 1) then '' else 'external match' end as method, case when c_custkey % 4 in (0, 1) then 'partial' else 'ok' end as status
 from customer, (select unnest(['business_name', 'trade_segment']) as field_key) k""",
    "page_access": """select c_custkey as page_id, (c_custkey % 6 not in (1, 2))::int as usable, ['', 'login_required', 'captcha', '', '', ''][(c_custkey % 6 + 1)::int] as type,
 ['', 'password field', 'just a moment', '', '', ''][(c_custkey % 6 + 1)::int] as marker,
 ['', 'very little visible text (0 chars)', 'very little visible text (39 chars)', 'empty SPA mount point (#app)', '<noscript> asks for JavaScript', '3 lazy-loaded images and no <img src>'][(c_custkey % 6 + 1)::int] as reason from customer""",
    "sheet_digests": """with f as (select c_custkey as k, ['Name', 'Telephone', 'Industry', 'Email'] as l, [c_name, '+64 9 ' || lpad(c_custkey::varchar, 7, '0'), c_mktsegment, 'desk' || c_custkey || '@mail' || c_nationkey || '.example.org'] as v from customer),
 p as (select k, array_to_string(list_transform(range(1, 5), lambda i: l[i] || ': ' || v[i]), chr(10)) as pairs, array_to_string(list_transform(range(1, 5), lambda i: l[i] || chr(10) || v[i]), chr(10)) as cells from f)
 select k as page_id, 'LABELLED VALUES:' || chr(10) || case when k % 3 = 0 then pairs || chr(10) || pairs else pairs end || chr(10) || chr(10) || 'PAGE TEXT:' || chr(10) || case when k % 3 = 2 then pairs else cells end as digest from p""",
    "match_requests": """with d as (select conv_id || '/' || (turn // 5) as site, turn, 'http://conv.example/' || conv_id || '/' || turn as url, text from conversations),
 s as (select *, row_number() over w as number, coalesce(sum(length(text)) over (partition by site order by turn, url rows between unbounded preceding and 1 preceding), 0) // 2000 as part from d window w as (partition by site order by turn, url))
 select site, part::bigint as part, md5('FIELDS TO FIND:' || chr(10) || '- key: city | label: "City" | expected kind: text' || chr(10) || '- key: phone_numbers | label: "Phone Numbers" | expected kind: phone (list of values)'
 || chr(10) || chr(10) || 'PAGE EXTRACT:' || chr(10) || string_agg('--- PAGE ' || number || ': ' || url || ' ---' || chr(10) || text, chr(10) || chr(10) order by number)) as request from s group by site, part""",
    "link_relevance": """select c_custkey * 4 as page_id, 0 as rank, 'http://c' || c_custkey || '.example/contact.html' as url, 1.895::double as score,
 'path matches contact; likely page for these fields (/contact); link text mentions contact; common section page (/contact)' as reasons from customer
 union all select c_custkey * 4, 1, 'http://c' || c_custkey || '.example/about-us', 0.805::double, 'likely page for these fields (/about); common section page (/us)' from customer""",
    "fetch_outcomes": """with e as (select event_id, event_id % 4 as attempt, [200, 404, 429, 503, 401, 403, 0, 0, 522, 302][(event_id % 10 + 1)::int] as status,
 event_id % 10 + 1 as n, case when event_id % 7 = 0 then event_id % 50 end as ra from events),
 o as (select *, case when status = 200 then 'ok' when n = 7 then 'timeout' when n = 8 then 'network' when status = 429 then 'rate_limited' when status = 401 then 'login_required'
 when status = 403 then 'blocked' else 'http_error' end as outcome, (status in (0, 429, 503, 522))::int as retryable from e)
 select event_id, outcome, retryable, (case when retryable = 1 and attempt < 2 then least(15000, 800 * pow(2, attempt + 1)::bigint) +
 case when ra between 1 and 30 then ra * 1000 else 0 end else -1 end)::bigint as wait_ms from o""",
    "host_schedule": f"""with o as (select page_id as priority, {ORIGIN} as origin from pages), r as (select *, row_number() over (partition by origin order by priority) - 1 as position from o)
 select priority, origin, position, position * case when starts_with(origin, 'https') then 3000 else 1200 end as start_ms from r""",
    "robots_checks": f"""with u as (select url, {ORIGIN} as origin, {PATH} || case when {QUERY} <> '' then '?' || {QUERY} else '' end as target from pages)
 select url, case when not starts_with(origin, 'https') then 1 when contains(target, '?page=') and length('/*?page=') > case when starts_with(target, '/en/6') or starts_with(target, '/es/5') then 5 when starts_with(target, '/en/') then 4 else 0 end then 0
 when starts_with(target, '/en/6') then 1 when starts_with(target, '/es/5') or starts_with(target, '/en/') then 0 else 1 end as allowed,
 case when starts_with(origin, 'https') then 2000 else 0 end as crawl_delay_ms from u""",
    "crawl_due": """with n as (select max(ts) as now from events) select 'http://u' || user_id || '.example/' as url from events, n group by user_id
 having count(*) filter (where ts > now - interval 24 hour) = 0""",
    "snapshot_choice": f"""with p as (select page_id, {normalized()} as url_key, length(html) as n from pages),
 s as (select url_key, max(page_id % 4 * 1000000000 + page_id) as pick from p group by 1), r as (select url_key, max(page_id % 5 * 1000000000 + page_id) as pick from p group by 1),
 j as (select s.url_key, s.pick % 1000000000 as sid, r.pick % 1000000000 as rid from s join r using (url_key)),
 k as (select j.*, a.n as sn, floor(b.n * (b.page_id % 3) / 2) as rn, a.page_id % 4 as sg, b.page_id % 5 as rg from j join p a on a.page_id = sid join p b on b.page_id = rid)
 select url_key, case when rn > sn * 0.5 and rg >= sg then rid + 1000000 else sid end as page_id, case when rn > sn * 0.5 and rg >= sg then 'playwright' else 'static' end as renderer from k""",
    "place_errors": """select event_id, case when event_id % 3 = 0 then 'auth' else ['bad_request', 'auth', 'auth', 'rate_limited', 'http_error'][(event_id % 5 + 1)::int] end as error_type from events""",
    "place_sheets": """with p as (select n_name, s_suppkey, s_name, row_number() over (partition by n_name order by s_suppkey) as rn from supplier join nation on s_nationkey = n_nationkey),
 k as (select *, rn - 1 as record_index from p where rn <= 60)
 select n_name as site, record_index::int as record_index, field_key, value, case when value = '' then 0::double else 0.95::double end as confidence from (
 select *, 'name' as field_key, s_name as value from k union all select *, 'address', s_suppkey || ' Dock Road' from k union all
 select *, 'phone_number', case when s_suppkey % 2 = 0 then '09 ' else '+64 9 ' end || lpad(s_suppkey::varchar, 7, '0') from k union all
 select *, 'rating', (s_suppkey % 5)::varchar || '.5' from k union all select *, 'category', 'hardware store, supplier' from k union all
 select *, 'price', 'very expensive' from k union all select *, 'photo', case when s_suppkey % 4 <> 0 then 'https://img.example/' || s_suppkey else '' end from k union all
 select *, 'warranty', '' from k)""",
    "page_notices": f"""with d as (select doc_id as page_id, {squish('text')} as body, doc_id % 6 as sign, case when doc_id % 11 = 0 then 403 when doc_id % 13 = 0 then 429 else 200 end as status from documents),
 t as (select *, body as p1, case sign when 0 then 'Please verify you are human.' when 1 then 'Subscribe to continue reading now.' else '' end as p2 from d),
 x as (select page_id, sign, status, lower(case when p1 || p2 <> '' then trim(p1 || chr(10) || p2, ' ' || chr(10)) else body end) as text from t),
 y as (select page_id, case when status = 403 then 'blocked' when status = 429 then 'rate_limited' when sign = 2 then 'captcha' when length(text) < 1200 and sign = 0 then 'captcha'
 when sign = 1 then 'paywall' end as type, case when status <> 200 then status::varchar when sign = 2 then 'g-recaptcha' when length(text) < 1200 and sign = 0 then 'verify you are human'
 when sign = 1 then 'subscribe to continue reading' end as marker from x) select page_id, type, marker from y where type is not null""",
    "grounding": f"""with c as (select conv_id, conv_id || '/' || (turn // 5) as site, turn, text, string_split({squish('text')}, ' ') as w from conversations),
 v as (select distinct site, unnest([{squish("array_to_string(w[1:3], '  ')")}, reverse(w[1]) || 'qx']) as value, unnest([false, true]) as quoted from c),
 j as (select v.*, c.turn, c.conv_id, contains(lower({squish('c.text')}), lower(v.value)) as verbatim,
 contains(regexp_replace(lower(c.text), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), regexp_replace(lower(v.value), '[^\\p{{L}}\\p{{N}}]+', '', 'g')) and length(regexp_replace(lower(v.value), '[^\\p{{L}}\\p{{N}}]+', '', 'g')) >= 3 as loose
 from v join c on c.site = v.site where v.value <> '')
 select site, value, bool_or(verbatim or loose)::int as grounded, case when bool_or(verbatim or loose) then '' when quoted then 'neither the value nor its claimed snippet appears in the page extract'
 else 'value is not present verbatim in the page extract' end as reason, 'http://conv.example/' || any_value(conv_id) || '/' || arg_min(turn, case when verbatim then turn else turn + 1000000 end) as source_url
 from j group by site, value, quoted""",
    "crawl_changes": """with e as (select 'http://u' || user_id || '.example/' as url_key, ts, max(event_type) as event_type from events group by 1, 2),
 l as (select *, lag(event_type) over (partition by url_key order by ts) as before from e)
 select url_key, count(*) as crawls, count(*) filter (where before is null or before <> event_type) as changes from l group by 1""",
}
