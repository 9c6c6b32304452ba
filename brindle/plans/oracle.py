"""The catalog's queries again, in DuckDB's SQL, written apart from the Spark code."""

from __future__ import annotations

from brindle.functions.projection import levels

SQL: dict[str, str] = {}

_TOK = "regexp_extract_all(lower(text), '([\\p{L}\\p{N}_]{2,})', 1)"
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"

# documents: tokens, frequencies, lengths, impacts
_BM = f"""
tok as (select doc_id, unnest({_TOK}) token from documents),
tf as (select doc_id, token, count(*) tf from tok group by 1, 2),
dl as (select doc_id, len({_TOK}) dl from documents),
st as (select count(*) n, avg(dl) avgdl from dl),
df as (select token, count(*) df from tf group by 1),
imp as (select tf.doc_id, tf.token, tf.tf, ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf / (tf.tf + 1.5 * (1 - 0.75 + 0.75 * dl.dl / st.avgdl)) impact
  from tf join df using (token) join dl using (doc_id), st)"""
_QTOK = f"q as (select unnest({_TOK}) token from (select text from benchmark order by item_id limit 1)), qt as (select token, count(*) qtf from q group by 1)"
_LEX = "lx as (select doc_id, round(sum(impact * qtf), 9) score from imp join qt using (token) group by 1 having sum(impact * qtf) > 0)"

SQL["tokenize_docs"] = f"select doc_id, len({_TOK})::bigint n_tokens, len(list_distinct({_TOK}))::bigint n_distinct from documents"
SQL["term_df"] = f"with {_BM} select token, count(*) df, sum(tf)::bigint cf from tf group by 1"
SQL["doc_len_stats"] = f"with {_BM} select count(*) n, round(avg(dl), 6) avgdl, min(dl)::bigint min_dl, max(dl)::bigint max_dl from dl"
SQL["bm25_postings_impact"] = f"with {_BM} select doc_id, token, tf, round(impact, 6) impact from imp"
SQL["bm25_search_top10"] = f"with {_BM}, {_QTOK}, {_LEX} select doc_id, round(score, 6) score, row_number() over (order by score desc, doc_id) rank from lx order by rank limit 10"
SQL["bm25_batch_topk"] = f"""with {_BM}, q as (select item_id qid, unnest({_TOK}) token from benchmark), qt as (select qid, token, count(*) qtf from q group by 1, 2),
s as (select qid, doc_id, round(sum(impact * qtf), 9) score from imp join qt using (token) group by 1, 2)
select qid, doc_id, round(score, 6) score from s qualify row_number() over (partition by qid order by score desc, doc_id) <= 5"""

# embeddings: products, means
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::double * p[2]::double))"
_ANG = "round_even((1 - {}) * 10000, 0)::bigint"
_Q1 = "qv as (select embedding q from embeddings order by vec_id limit 1)"
_MED = "qm as (select vec_id qid, embedding q, label mine from embeddings where vec_id % 100 = 0)"
_SC = f"sc as (select qid, mine, vec_id, label, {_DOT.format(a='embedding', b='q')} sim from embeddings, qm)"
SQL["dense_knn_cosine"] = f"""with {_Q1}, s as (select vec_id, {_DOT.format(a="embedding", b="q")} sim from embeddings, qv), d as (select *, {_ANG.format("sim")} dist from s)
select vec_id, round(sim, 6) sim, dist, row_number() over (order by dist, vec_id) rank from d order by rank limit 20"""
SQL["dense_knn_batch"] = f"""with {_MED}, {_SC}, d as (select *, {_ANG.format("sim")} dist from sc)
select qid, vec_id, dist, row_number() over (partition by qid order by dist, vec_id) rank from d qualify rank <= 10"""
_X = "ex as (select vec_id, label, unnest(embedding)::double x, generate_subscripts(embedding, 1) - 1 pos from embeddings), mean as (select pos, round(avg(x), 9) m from ex group by pos)"
SQL["corpus_mean_vector"] = f"with {_X} select pos::bigint pos, round(m, 8) mean from mean"
SQL["centered_truncated"] = f"with {_X} select vec_id, pos::bigint pos, round(x - m, 6) x from ex join mean using (pos) where pos < 32"
SQL["l2_normalized"] = f"""with {_X}, c as (select vec_id, pos, x - m x from ex join mean using (pos) where pos < 32), n as (select vec_id, sqrt(sum(x * x)) n from c group by 1)
select vec_id, round(sqrt(sum((x / n) * (x / n))), 6) norm, round(max(case when pos = 0 then x / n end), 6) first from c join n using (vec_id) group by 1"""
SQL["label_centroids"] = f"with {_X} select label, pos::bigint pos, round(avg(x), 6) mean from ex group by 1, 2"


# planes and codes
def _signs(seed: int, n: int) -> str:
    """i, v: the first n signs of the generator."""
    m = "18446744073709551616::uhugeint"
    return f"""
g0 as (select range i, (({seed}::uhugeint + (range + 1)::uhugeint * 11400714819323198485::uhugeint) % {m})::ubigint z from range({n})),
g1 as (select i, ((xor(z, z >> 30))::uhugeint * 13787848793156543929::uhugeint % {m})::ubigint z from g0),
g2 as (select i, ((xor(z, z >> 27))::uhugeint * 10723151780598845931::uhugeint % {m})::ubigint z from g1),
sg as (select i, case when (xor(z, z >> 31) >> 63) = 1 then -1.0 else 1.0 end v from g2)"""


SQL["rademacher_planes"] = f"with {_signs(0, 128)} select i // 64 j, (i // 8) % 8 d, i % 8 e, v::double v from sg"
_SRHT = f"""{_signs(0, 32)},
h as (select a.range p, b.range q, case when bit_count(a.range & b.range) % 2 = 0 then 1 else -1 end h from range(8) a, range(8) b),
r0 as (select j.range j, d.range d, p.range p, case when d.range = p.range then 1 else 0 end x from range(2) j, range(8) d, range(8) p),
r1 as (select r0.j, r0.d, h.q p, sum(r0.x * sg.v * h.h) x from r0 join sg on sg.i = (r0.j * 2 + 0) * 8 + r0.p join h on h.p = r0.p group by 1, 2, 3),
r2 as (select r1.j, r1.d, h.q p, sum(r1.x * sg.v * h.h) x from r1 join sg on sg.i = (r1.j * 2 + 1) * 8 + r1.p join h on h.p = r1.p group by 1, 2, 3),
pl as (select j, d, p e, x / sqrt(sum(x * x) over (partition by j, p)) v from r2)"""
SQL["srht_planes"] = f"with {_SRHT} select j, d, e, round(v::float::double, 6) v from pl"
SQL["int8_plane_scales"] = f"""with {_SRHT}, s as (select j, e, max(abs(v::float::double)) / 127 s from pl group by 1, 2)
select j, e, round(any_value(s)::float::double, 6) scale, sum(abs(round_even(v::float::double / s, 0)))::bigint magnitude from pl join s using (j, e) group by 1, 2"""
_CODE = f"""{_X}, {_signs(42, 4 * 32 * 32)},
cx as (select vec_id, pos, x - m x from ex join mean using (pos) where pos < 32),
bt as (select vec_id, (i // 1024) * 32 + i % 32 b, sum(x * v) > 0 t from cx join sg on (i // 32) % 32 = pos group by 1, 2)"""
SQL["simhash_codes"] = f"with {_CODE} select vec_id, string_agg(case when t then '1' else '0' end, '' order by b) bits from bt group by 1"
_HAM = f"""{_CODE}, hd as (select a.vec_id, sum(case when a.t <> q.t then 1 else 0 end)::bigint dist from bt a join bt q using (b) where q.vec_id = (select min(vec_id) from embeddings) group by 1)"""
SQL["hamming_scan_topk"] = f"with {_HAM} select vec_id, dist, round(1 - dist / 128.0::double, 6) sim, row_number() over (order by dist, vec_id) rank from hd order by rank limit 20"
_HAMQ = f"""{_CODE}, {_MED}, hq as (select q.vec_id qid, a.vec_id, sum(case when a.t <> q.t then 1 else 0 end)::bigint dist from bt a join bt q using (b) where q.vec_id in (select qid from qm) group by 1, 2)"""
SQL["hamming_batch_topk"] = f"with {_HAMQ} select qid, vec_id, dist, row_number() over (partition by qid order by dist, vec_id) rank from hq qualify rank <= 10"
_Z = "(sqrt(2 * ln(greatest(count(*), 2)::double)) + 1)"
SQL["auto_min_sim"] = f"select round(0.5 + 0.5 * {_Z} / sqrt(128.0::double), 9) hamming_floor, round({_Z} / sqrt(32.0::double), 9) cosine_floor from embeddings"
SQL["floor_filtered_dense"] = f"with {_HAM}, f as (select 0.5 + 0.5 * {_Z} / sqrt(128.0::double) f from embeddings) select vec_id, dist from hd, f where 1 - dist / 128.0::double >= f"


# fusion
def _fused(score: str, where: str = "true", extra: str = "") -> str:
    return f"""with {_BM}, {_QTOK}, {_LEX}, {_HAM},
d as (select vec_id r, dist, row_number() over (order by dist, vec_id) rd from hd where {where} order by rd limit 160),
x as (select doc_id r, score, row_number() over (order by score desc, doc_id) rl from lx order by rl limit 160){extra},
p as (select coalesce(d.r, x.r) r, d.*exclude r, x.*exclude r from d full join x on d.r = x.r),
f as (select *, {score} fused from p)
select r as row, dist, round(score, 6) bm25_score, round(fused, 9) fused, row_number() over (order by fused desc, rd nulls last, rl) rank from f order by rank limit 20"""


SQL["rrf_hybrid"] = _fused("coalesce(1.0::double / (60 + rd), 0) + coalesce(1.0::double / (60 + rl), 0)")
SQL["rrf_hybrid_floor"] = _fused("coalesce(1.0::double / (5 + rd), 0) + coalesce(1.0::double / (5 + rl), 0)", "1 - dist / 128.0::double >= 0.55")
SQL["weighted_hybrid"] = _fused(
    "0.5 * coalesce(case when za = zb then 1 else (zb - dist)::double / (zb - za) end, 0) * (dist is not null)::int + 0.5 * coalesce(case when wa = wb then 1 else (score - wa) / (wb - wa) end, 0) * (score is not null)::int",
    extra=", zz as (select min(dist) za, max(dist) zb from d), ww as (select min(score) wa, max(score) wb from x)",
).replace("from d full join x on d.r = x.r)", "from d full join x on d.r = x.r), p as (select * from p0, zz, ww)").replace("\np as (select coalesce", "\np0 as (select coalesce")
SQL["fetch_verified"] = f"""with {_BM}, {_QTOK}, {_LEX}, t as (select doc_id from lx order by score desc, doc_id limit 10)
select doc_id as row, sha256(text) sha256, true verified from t join documents using (doc_id) union all select doc_id, sha256(text), sha256(text || '!') = sha256(text) from t join documents using (doc_id)"""

# snapshots
_SNAP = """
a as (select doc_id::varchar chunk_id, text, sha256(text) s from documents),
b as (select doc_id::varchar chunk_id, case when source = 'src1' then text || ' (edited)' else text end text from documents where lang <> 'es' union all select 'page-' || page_id, html from pages),
act as (select coalesce(a.chunk_id, b.chunk_id) chunk_id, case when a.chunk_id is null then 'added' when b.chunk_id is null then 'deleted' when a.s = sha256(b.text) then 'unchanged' else 'updated' end action
  from a full join b on a.chunk_id = b.chunk_id)"""
_HIST = f"""{_SNAP},
o as (select a.chunk_id, text, a.chunk_id::bigint as row, action in ('updated', 'deleted') tombstone from a join act using (chunk_id)),
n as (select chunk_id, text, (select count(*) from a) + row_number() over (order by chunk_id) - 1 as row, false tombstone from b join act using (chunk_id) where action in ('added', 'updated')),
hi as (select * from o union all select * from n)"""
SQL["sync_diff"] = f"with {_SNAP} select chunk_id, action from act"
SQL["sync_stats"] = f"""with {_SNAP}, c as (select count(*) filter (action = 'added') added, count(*) filter (action = 'updated') updated, count(*) filter (action = 'deleted') deleted, count(*) filter (action = 'unchanged') unchanged from act)
select *, added + updated embedded, added + updated + deleted > 0 changed from c"""
SQL["update_latest_live"] = f"with {_HIST} select chunk_id, sha256(text) sha256, row from hi where not tombstone"
SQL["tombstone_ratio"] = f"""with {_HIST}, c as (select count(*) total_rows, count(*) filter (not tombstone) live_count, count(*) filter (tombstone) tombstones from hi)
select *, round(case when total_rows > 0 then tombstones::double / total_rows else 0 end, 9) tombstone_ratio from c"""
SQL["compact_live"] = f"with {_HIST} select row_number() over (order by row) - 1 as row, chunk_id from hi where not tombstone"
SQL["shard_assignment"] = """with recursive r as (select doc_id as row, strlen(text) n, row_number() over (order by doc_id) k from documents),
f(k, row, shard_id, byte_offset, n) as (select k, row, 0::bigint, 0::bigint, n from r where k = 1
 union all select r.k, r.row, case when f.byte_offset + f.n > 0 and f.byte_offset + f.n + r.n > 20000 then f.shard_id + 1 else f.shard_id end,
  case when f.byte_offset + f.n > 0 and f.byte_offset + f.n + r.n > 20000 then 0 else f.byte_offset + f.n end, r.n from f join r on r.k = f.k + 1)
select row, shard_id, byte_offset from f"""
SQL["merkle_root"] = """with recursive l(i, h, n) as (select doc_id, sha256(text), (select count(*) from documents) from documents
 union all select i // 2, sha256(unhex(h || x)), (n + 1) // 2 from (select i, h, n, coalesce(lead(h) over (order by i), h) x from l where n > 1) where i % 2 = 0)
select h root from l where n = 1"""
SQL["last_duplicate_wins"] = "select conv_id::varchar chunk_id, turn, sha256(text) sha256 from conversations qualify row_number() over (partition by conv_id order by turn desc) = 1"
SQL["chunk_sha256"] = "select doc_id, sha256(text) sha256 from documents"

# pages
_BODY = "html"
for _tag in ("script", "style", "nav", "footer", "header", "aside"):
    _BODY = f"regexp_replace({_BODY}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', ' ', 'g')"
_BODY = f"regexp_replace({_BODY}, '(?is)<head\\b.*?</head>', ' ', 'g')"
_BODY = f"regexp_replace(regexp_replace({_BODY}, '<[^>]+>', ' ', 'g'), '[ \\t]+', ' ', 'g')"
_BODY = _STRIP.format(f"regexp_replace({_BODY}, '\\n\\s*\\n+', '\\n\\n', 'g')".replace("'\\n\\n', 'g'", "chr(10) || chr(10), 'g'"))
SQL["html_extract_text"] = f"select page_id, {_BODY} as text from pages"
_TITLE = "regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _TITLE = f"replace({_TITLE}, '{_a}', '{_b}')"
_TITLE = f"nullif(trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')), '')"
SQL["html_title"] = f"select page_id, {_TITLE} title from pages"
SQL["frontmatter_strip"] = "select page_id, '# ' || url body, 'title: ' || url front from pages"

# evaluation
SQL["recall_at_k"] = f"""with {_HAMQ}, {_SC}, t as (select qid, vec_id from sc qualify row_number() over (partition by qid order by sim desc, vec_id) <= 10),
f as (select qid, vec_id from hq qualify row_number() over (partition by qid order by dist, vec_id) <= 10),
h as (select t.qid, count(f.vec_id) / 10.0::double r from t left join f on f.qid = t.qid and f.vec_id = t.vec_id group by 1) select round(avg(r), 6) recall from h"""
SQL["spearman_rho"] = f"""with {_HAMQ}, {_SC}, r as (select sc.qid, row_number() over (partition by sc.qid order by round(sim, 9) desc, sc.vec_id)::double a, row_number() over (partition by sc.qid order by dist, sc.vec_id)::double b
from sc join hq on hq.qid = sc.qid and hq.vec_id = sc.vec_id) select qid, round(corr(a, b), 6) rho from r group by 1"""
SQL["ndcg_at_k"] = f"""with {_HAMQ}, g as (select hq.qid, hq.vec_id, dist, case when e.label = mine then 1 else 0 end grade from hq join qm using (qid) join embeddings e on e.vec_id = hq.vec_id),
r as (select qid, grade, row_number() over (partition by qid order by dist, vec_id) a, row_number() over (partition by qid order by grade desc, vec_id) b from g)
select qid, round(coalesce(sum(case when a <= 10 then (pow(2, grade) - 1) / log2(a + 1) end) / nullif(sum(case when b <= 10 then (pow(2, grade) - 1) / log2(b + 1) end), 0), 0), 6) ndcg from r group by 1"""
_CUTS = "[" + ", ".join(f"{x!r}::double" for x in levels(4)[1].tolist()) + "]"
SQL["quantizer_codes"] = f"""with {_X}, n as (select vec_id, sqrt(sum(x * x)) n from ex group by 1)
select vec_id, pos::bigint pos, len(list_filter({_CUTS}, lambda t: t < x / n * 8.0))::bigint as level from ex join n using (vec_id)"""
