"""SQL for the queries of roundtrips.py, and for the chunker."""

from __future__ import annotations

from brindle.functions.projection import levels
from brindle.plans.oracle import _BM, _BODY, _CODE, _HIST, _SNAP, _STRIP, _TITLE, _X

SQL: dict[str, str] = {}


def _decoded(x: str) -> str:
    """The entities that occur in the test tables, and those of html_metadata."""
    for a, b in (("&amp;", "&"), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&eacute;", "é"), ("&uuml;", "ü"), ("&#8217;", "’"), ("&#x41;", "A"))[::-1]:
        x = f"replace({x}, '{a}', '{b}')"
    return x


# directories and pages
_MD = "'# ' || url || chr(10) || chr(10) || html"
_PATH = "'d' || page_id % 7 || '/' || page_id || "
SQL["directory_scan"] = f"""with t as (select page_id, page_id % 5 k, html, url, {_BODY} body, {_TITLE} title from pages),
f as (select {_PATH} list_extract(['.md', '.txt', '.rst', '.HTML'], (k + 1)::bigint) as path, list_extract(['markdown', 'text', 'rst', 'html'], (k + 1)::bigint) kind, case when k = 3 then title end title,
 case when k = 0 then 'title: ' || url end front, case when k = 0 then {_MD} when k = 3 then body else html end x from t where k < 4)
select path, kind, title, front, path source_path, sha256(x) sha256 from f where {_STRIP.format("x")} <> ''"""
SQL["corpus_scan"] = f"""with t as (select page_id % 5 k, {_PATH} case page_id % 5 when 0 then '.md' else '.txt' end as path, page_id % 7 d, '---' || chr(10) || 'title: ' || url || chr(10) || '---' || chr(10) || {_MD} md, html from pages where page_id % 5 < 2)
select path, sha256(case when k = 0 then md else html end) sha256, k = 1 and d < 4 in_glob from t"""
_ART = "regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)"
for _tag in ("script", "style", "nav", "footer", "header", "aside"):
    _ART = f"regexp_replace({_ART}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', '<x>', 'g')"
_ART = f"regexp_replace({_ART}, '(?s)<!--.*?-->', '<x>', 'g')"
_ART = f"array_to_string(list_filter(list_transform(string_split_regex({_ART}, '(<[^>]+>)+'), lambda s: {_STRIP.format(_decoded('s'))}), lambda s: s <> ''), chr(10))"
_HEAD = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
SQL["html_dom_text"] = f"select page_id, {_ART} as text, nullif({_STRIP.format(_decoded(_HEAD))}, '') title from pages"
SQL["html_metadata"] = "select page_id, 'Café ’A ' || page_id || ' &amp;' title, 'dünn <' || page_id || '>' description, url, '2024-0' || (page_id % 9 + 1) date from pages"
SQL["sitemap_urls"] = "select row_number() over (order by page_id) - 1 pos, url from pages"

# the chunker: paragraphs are cut into pieces, which one recursion a text folds
_PIECES = """
par as (select id, unnest(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '')) p, generate_subscripts(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> ''), 1) i from src),
pc as (select id, i, unnest(regexp_extract_all(p, '[^.!?]*[.!?]|[^.!?]+')) s, generate_subscripts(regexp_extract_all(p, '[^.!?]*[.!?]|[^.!?]+'), 1) j, len(regexp_extract_all(p, '[^.!?]*[.!?]|[^.!?]+')) m from par),
sq as (select id, row_number() over (partition by id order by i, j) k, s, regexp_replace(s, '^\\s+|\\s+$', '', 'g') t, j = m as last from pc),"""
_CHUNKS = f"""
{_PIECES}
fo(id, k, buf, e1, e2) as (select distinct id, 0::bigint, ''::varchar, null::varchar, null::varchar from sq
 union all select id, k, case when flush then '' else nb end, e1, case when flush then nb end from (
  select sq.id, sq.k, nb, case when f.buf <> '' and length(f.buf) + length(sq.s) + 1 > 500 then f.buf end e1, sq.last and length(nb) >= 300 flush
  from fo f join sq on sq.id = f.id and sq.k = f.k + 1, lateral (select case when f.buf = '' then sq.t when length(f.buf) + length(sq.s) + 1 <= 500 then f.buf || ' ' || sq.t else sq.t end nb) x)),
em as (select id, k, 1 o, e1 c from fo union all select id, k, 2, e2 from fo union all select id, k, 3, buf from fo qualify k = max(k) over (partition by id)),
ck as (select id, row_number() over (partition by id order by k, o) - 1 ord, c from (select id, k, o, regexp_replace(c, '^\\s+|\\s+$', '', 'g') c from em) where c <> '')"""
SQL["chunk_documents"] = f"with recursive src as (select doc_id id, text from documents), {_CHUNKS} select id doc_id, ord, id || '#chunk-' || lpad(ord::varchar, greatest(4, length(ord::varchar))::int, '0') chunk_id, sha256(c) sha256 from ck"
SQL["page_chunks"] = f"""with recursive src as (select page_id id, regexp_replace({_BODY}, '\\n\\n\\n+', chr(10) || chr(10), 'g') as text from pages), {_CHUNKS}
select url || '#chunk-' || lpad(ord::varchar, greatest(4, length(ord::varchar))::int, '0') chunk_id, ord, sha256(c) sha256, {_TITLE} title from ck join pages on page_id = id"""

# the two file formats
_HY = f"""with recursive {_CODE}, bs as (select vec_id, string_agg(case when t then '1' else '0' end, '' order by b) bits from bt group by 1),
hy as (select doc_id as row, doc_id::varchar chunk_id, text, lang, coalesce(lang = 'es', false) dead, bits from documents join bs on vec_id = doc_id)"""
SQL["archive_v1_roundtrip"] = f"{_HY} select row_number() over (order by row) - 1 as row, chunk_id, sha256(text) sha256, true verified, lang, false tombstone, bits from hy"
SQL["archive_v2_roundtrip"] = f"{_HY} select row, chunk_id, sha256(text) sha256, true verified, lang, dead tombstone, bits from hy"
SQL["migrate_roundtrip"] = f"{_HY} select row_number() over (order by row) - 1 as row, chunk_id, sha256(text) sha256, true verified, lang, false tombstone, bits, '12' formats from hy"
SQL["archive_postings"] = f"""with documents as (select doc_id, text from main.documents where doc_id in (select vec_id from embeddings) and coalesce(lang <> 'es', true)), {_BM}
select doc_id as row, token, impact::float::double impact from imp"""
SQL["archive_shards"] = """with recursive hy as (select doc_id, strlen('{"sha256":"' || sha256(text) || '","meta":' || to_json({'lang': lang}) || '}' || chr(10) || text) n, row_number() over (order by doc_id) k from documents where doc_id in (select vec_id from embeddings)),
f(k, row, shard_id, byte_offset, n) as (select k, doc_id, 0::bigint, 0::bigint, n from hy where k = 1
 union all select r.k, r.doc_id, case when f.byte_offset + f.n > 0 and f.byte_offset + f.n + r.n > 20000 then f.shard_id + 1 else f.shard_id end,
  case when f.byte_offset + f.n > 0 and f.byte_offset + f.n + r.n > 20000 then 0 else f.byte_offset + f.n end, r.n from f join hy r on r.k = f.k + 1)
select row, shard_id, byte_offset from f"""
_NEAR = "hd as (select a.vec_id, sum(case when a.t <> q.t then 1 else 0 end)::bigint dist from bt a join bt q using (b) where q.vec_id = {} group by 1)"
SQL["archive_search"] = f"""{_HY}, {_NEAR.format(0)}, h as (select hy.*, dist from hy join hd on vec_id = row),
r as (select '1' format, row_number() over (order by dist, row) rank, * from h union all select '2', row_number() over (order by dist, row), * from h where not dead)
select format, rank, sha256(text) sha256, true verified, chunk_id, dist from r where rank <= 20"""
_STEPS = {"no vectors": 1, "other version": 2, "other kind": 2, "other binarizer": 2, "a vector short": 3, "a map entry short": 4, "id out of range": 5, "id not ended": 5, "id no UTF-8": 5, "live count": 6, "postings of other rows": 7, "part of the postings": 1, "chunk count": 3, "a changed text": 4, "half a vector": 3, "a long mean": 2, "nothing": 0, "nothing, format 1": 0, "a blank line": 0}
SQL["open_validation"] = "select fault, step::bigint step from (values " + ", ".join(f"('{k}', {v})" for k, v in _STEPS.items()) + ") t(fault, step)"

# the index
_LIFE = f"""with recursive {_HIST}, v as (
 select 1::bigint v, a.chunk_id::bigint as row, chunk_id, s sha256, false tombstone from a union all
 select 2, row, chunk_id, sha256(text), tombstone from hi union all
 select 3, row_number() over (order by row) - 1, chunk_id, sha256(text), false from hi where not tombstone)"""
SQL["index_lifecycle"] = f"{_LIFE} select v as version, row, chunk_id, sha256, tombstone from v"
SQL["index_manifests"] = f"""{_LIFE}, nn as (select v, count(*) n, count(*) filter (not tombstone) live from v group by 1),
l(v, i, h, n) as (select v, row, sha256, n from v join nn using (v)
 union all select v, i // 2, sha256(unhex(h || x)), (n + 1) // 2 from (select v, i, h, n, coalesce(lead(h) over (partition by v order by i), h) x from l where n > 1) where i % 2 = 0)
select nn.v as version, nn.n total_rows, live live_count, h merkle_root, 32::bigint dim, 4::bigint k, 'srht' projection, round(1 - live / nn.n, 9) tombstone_ratio, round(1 - live / nn.n, 9) > 0.2 should_compact from nn join l on l.v = nn.v and l.n = 1"""
SQL["index_cold_rows"] = f"with {_HIST} select row_number() over (order by row) - 1 as row, chunk_id, sha256(text) sha256, true verified, strlen(text)::bigint n_bytes from hi where not tombstone"
SQL["index_update_delete"] = """with d as (select doc_id, doc_id::varchar chunk_id, text, lang from documents)
select doc_id as row, chunk_id, sha256(text) sha256, coalesce(lang in ('de', 'fr'), false) tombstone from d
union all select (select count(*) from d) + row_number() over (order by doc_id) - 1, 'new-' || chunk_id, sha256(text || '!'), false from d where lang = 'de'"""
SQL["index_precoded"] = f"{_HY}, {_NEAR.format('(select min(vec_id) from embeddings)')}, n as (select row_number() over (order by row) - 1 as row, dist from hy join hd on vec_id = row) select row, dist, row_number() over (order by dist, row) rank from n order by rank limit 20"
SQL["stream_upserts"] = "select doc_id::varchar chunk_id, sha256(case when source = 'src1' then text || ' (edited)' else text end) sha256 from documents where coalesce(lang <> 'es', true)"

# rules
_ERRORS = {
    "delete of an unknown id": "KeyError", "a live id again": "ValueError", "an update under the same id": "none", "nothing staged": "none", "create where one is": "FileExistsError", "open where none is": "FileNotFoundError", "another embedder": "ValueError", "unknown setting": "TypeError",
    "levels of rough vectors": "ValueError", "a floor beyond 1": "ValueError", "a floor of a word": "ValueError", "a floor off": "none", "dim of 12": "ValueError", "nine bits": "ValueError", "codes of other widths": "SparkRuntimeException", "code of another width": "SparkRuntimeException", "code of its width": "none",
    "migrate onto a file": "FileExistsError", "no zip file": "ValueError", "a changed download": "ValueError", "a download": "none", "unknown prompt": "ValueError", "old version": "ZeroDivisionError", "odd version": "none", "compact of nothing": "ValueError",
}
SQL["refusals"] = 'select "case", error from (values ' + ", ".join(f"('{k}', '{v}')" for k, v in _ERRORS.items()) + ') t("case", error)'
SQL["floor_rules"] = """with z as (select sqrt(2 * ln(greatest(count(*), 2)::double)) + 1 z from embeddings),
g as (select * from (values ('None', null, 0), ('off', null, 1), ('auto', null, 2), ('0.25', 0.25::double, 3)) t(given, gv, gk), (values ('None', null, 0), ('off', null, 1), ('auto', null, 2), ('0.75', 0.75::double, 3)) s(kept, kv, kk)),
r as (select given, kept, case when gk > 0 then gk else kk end k, case when gk > 0 then gv else kv end v from g)
select given, kept, round(case k when 2 then 0.5 + 0.5 * z / sqrt(128.0::double) when 3 then v end, 9) hamming, round(case k when 2 then z / sqrt(32.0::double) when 3 then v end, 9) cosine from r, z"""


# codecs
def _level(bits: int) -> str:
    """dx: each coordinate's centroid."""
    c, cuts = levels(bits)
    return f"""n as (select vec_id, sqrt(sum(x * x)) n from ex group by 1), dx as (select vec_id, pos, x, list_extract([{", ".join(f"{v!r}::double" for v in c.tolist())}], len(list_filter([{", ".join(f"{v!r}::double" for v in cuts.tolist())}], lambda t: t < x / n * 8.0)) + 1) y from ex join n using (vec_id))"""


SQL["multibit_cosine"] = f"""with {_X}, {_level(4)}, q as (select pos, x q, sqrt(sum(x * x) over ()) qn from ex where vec_id = (select min(vec_id) from embeddings))
select vec_id, round(sum(y * q) / sqrt(sum(y * y)) / any_value(qn), 6) cosine from dx join q using (pos) group by 1"""
SQL["mean_cosine"] = f"with {_X}, {_level(2)}, c as (select vec_id, sum(x * y) / sqrt(sum(x * x)) / sqrt(sum(y * y)) c from dx group by 1) select round(avg(c), 6) cosine from c"
