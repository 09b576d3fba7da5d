"""DuckDB SQL of the queries that SQL can express."""

ORACLES: dict[str, str] = {
    "op2_warc": """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, cast(octet_length(encode(h)) as bigint) as payload_bytes, sha1(encode(h)) as payload_digest from p),
t as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) else page_id end as top from d)
select page_id, payload_bytes, payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type,
    case when page_id <> top then top end as refers_to
from t
""",
    "op7_main_text": r"""
with a as (select page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') as parts from pages),
b as (select page_id, url, list_transform(parts, lambda x: regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?b>', '', 'g')) as parts from a),
c as (select page_id, url, list_transform(parts, lambda x: replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&')) as parts from b),
d as (select page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') as parts from c)
select page_id, url, array_to_string(parts, chr(10)) as text, cast(length(array_to_string(parts, chr(10))) as bigint) as n_chars from d
""",
    "op6_decontaminate": r"""
with d as (
    select doc_id, row_number() over () as r,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents),
b as (
    select item_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark),
windows as (
    select distinct item_id, least(13, len(w)) as size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as s
    from (select item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct size from windows),
places as (select r, w, unnest(range(1, len(w) + 1)) as i from d),
hits as (
    select p.r, p.i, x.size, x.item_id
    from places p join sizes z on p.i + z.size - 1 <= len(p.w)
    join windows x on x.size = z.size and x.s = array_to_string(p.w[p.i : p.i + z.size - 1], ' ')),
words as (select r, count(distinct q) as n_hit from (select r, unnest(range(i, i + size)) as q from hits) group by r),
items as (select r, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256
    from (select distinct r, cast(item_id as varchar) as item from hits) group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join words using (r) left join items using (r)
""",
    "op13_phrases": r"""
with d as (
    select row_number() over () as r, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
    from documents),
pieces as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as p from d)),
n as (select lang, cast(sum(len(w)) as bigint) as n from pieces group by lang),
grams as (
    select lang, k, s, count(*) as f
    from (select lang, k, array_to_string(w[i : i + k - 1], ' ') as s
        from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from pieces, (select unnest([1, 2, 3]) as k) where len(w) >= k))
    group by lang, k, s),
c as (select lang, k, s, f as a, string_split(s, ' ') as w from grams where k > 1 and f >= 10),
cuts as (
    select lang, k, s, a, j, array_to_string(w[1:j], ' ') as lp, array_to_string(w[j + 1 : k], ' ') as rp
    from (select *, unnest(range(1, k)) as j from c)),
scored as (
    select x.lang, x.k, x.s, x.a, x.j, l.f as l, r.f as r, (cast(1000000 as hugeint) * x.a * x.a) // (cast(l.f as hugeint) * r.f) as score
    from cuts x join grams l on l.lang = x.lang and l.s = x.lp and l.k = x.j join grams r on r.lang = x.lang and r.s = x.rp and r.k = x.k - x.j),
loosest as (select * from scored qualify row_number() over (partition by lang, s, k order by score, j) = 1),
holders as (
    select lang, s, max(a) as longer
    from (select lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) as s from c where k = 3) group by lang, s),
ranked as (
    select x.lang, x.s, x.a, x.l, x.r, x.score, row_number() over (partition by x.lang order by x.score desc, x.a desc, encode(x.s)) as rank
    from loosest x left join holders h on h.lang = x.lang and h.s = x.s and x.k = 2
    where h.longer is null or 100 * h.longer < 50 * x.a)
select lang, cast(rank as bigint) as rank, s as phrase, a, l, r, n, cast(score as bigint) as score
from ranked join n using (lang) where rank <= 2000
""",
}
