"""Ranking: postings and BM25, cosine, reciprocal-rank fusion, thresholds, caps, visibility."""

#: Query terms of each benchmark passage: all its different words.
TERMS = """q0 as (select item_id, EXPLODE(TOKENS(text)) as term from {benchmark}), q as (select distinct item_id, term from q0)"""
POSTINGS = """p0 as (select doc_id, EXPLODE(TOKENS(text)) as term from {documents}), lens as (select doc_id, count(*) as len from p0 group by doc_id),
  stats as (select count(*) as n, avg(len) as avgdl from lens), wanted as (select distinct term from q),
  tf as (select p0.doc_id, p0.term, count(*) as tf from p0 join wanted on p0.term = wanted.term group by p0.doc_id, p0.term), df as (select term, count(*) as df from tf group by term)"""
BM25 = f"""{TERMS}, {POSTINGS}, bm25 as (select q.item_id, tf.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) as score
  from q join tf on q.term = tf.term join df on q.term = df.term join lens on tf.doc_id = lens.doc_id cross join stats group by q.item_id, tf.doc_id),
  lexical as (select item_id, doc_id, score, row_number() over (partition by item_id order by round(score, 6) desc, doc_id) as rn from bm25)"""
#: A vector for each passage: the one with its number; documents hold the vectors with theirs.
COSINE = """qv as (select item_id, embedding as e from {benchmark} join {embeddings} on item_id = vec_id), cos as (select item_id, vec_id as doc_id, COSINE(e, embedding) as score from {embeddings} cross join qv where vec_id <> item_id),
  vectors as (select item_id, doc_id, score, row_number() over (partition by item_id order by round(score, 6) desc, doc_id) as rn from cos)"""
FUSED = f"""{BM25}, {COSINE}, lists as (select item_id, doc_id, rn from lexical where rn <= 20 union all select item_id, doc_id, rn from vectors where rn <= 20),
  rrf as (select item_id, doc_id, sum(cast(1 as double) / (20 + rn)) as score, count(*) as lists from lists group by item_id, doc_id)"""

QUERIES = {
    "r_bm25_topk": f"with {BM25} select item_id, doc_id, round(score, 4) as score, rn from lexical where rn <= 10",
    "r_cosine_topk": f"with {COSINE} select item_id, doc_id, round(score, 5) as score, rn from vectors where rn <= 20",
    "w2_rrf_fuse": f"with {FUSED} select item_id, doc_id, round(score, 6) as score, lists from rrf",
    "r_hybrid_search": f"""with {FUSED}, o as (select *, row_number() over (partition by item_id order by round(score, 6) desc, doc_id) as rn from rrf)
      select item_id, doc_id, round(score, 6) as score, rn from o where rn <= 10""",
    "r8_fuse_vector_bm25": f"""with {FUSED}, f as (select r.item_id, r.doc_id, case when v.rn <= 8 then greatest(r.score, v.score + 0.5) else r.score end as score from rrf r left join vectors v on r.item_id = v.item_id and r.doc_id = v.doc_id),
      o as (select *, row_number() over (partition by item_id order by round(score, 6) desc, doc_id) as rn from f) select item_id, doc_id, round(score, 5) as score, rn from o where rn <= 20""",
    "r18_entity_facts": """with f as (select o_custkey as entity_id, o_orderkey as fact_id, concat(o_orderstatus, ' ', o_orderpriority) as fact_text, o_totalprice, case o_orderpriority when '1-URGENT' then 'permanent' when '2-HIGH' then 'durable' else 'standard' end as retention from {orders}),
      r as (select *, case when retention in ('durable', 'permanent') then 0.55 else 0.5 end as score, case when retention = 'permanent' then 1.0 else 0.7 end as importance, row_number() over (partition by entity_id, fact_text order by o_totalprice desc, fact_id) as rn from f),
      k as (select *, row_number() over (partition by entity_id order by score desc, fact_id) as place from r where rn = 1) select entity_id, fact_id, fact_text, cast(score as double) as score, cast(importance as double) as importance, place from k where place <= 15""",
    "p4_visible_chunks": """select c.doc_id from {documents} c where c.doc_id % 11 <> 0 and not exists (select 1 from {documents} n where n.lang = c.lang and n.doc_id % 11 <> 0 and n.doc_id % 5 = 0 and n.doc_id - 3 = c.doc_id)""",
    "p8_prerank_filter": "select doc_id, lang, source from {documents} where (lang = 'en' or lang = '' or lang is null) and source = 'src1' and coalesce(case when doc_id % 4 = 0 then null else 'standard' end, 'standard') = 'standard'",
    "p10_dynamic_threshold": f"""with {COSINE}, v as (select item_id, doc_id, score, rn from vectors where rn <= 20), s as (select item_id, count(*) as n, max(score) as top, median(score) as med, stddev_samp(score) as sd from v group by item_id),
      t as (select item_id, case when n < 4 then least(0.4, top * 0.55) else least(0.4, greatest(0.25, top * 0.55, case when sd = 0 then med * 0.5 else med - 1.5 * sd end)) end as threshold from s)
      select v.item_id, v.doc_id, round(t.threshold, 4) as threshold from v join t on v.item_id = t.item_id where v.score >= t.threshold or v.rn <= 3""",
    "p14_acl": """with acl as (select n_nationkey as namespace, case when n_regionkey = 0 then 'all' else cast(n_regionkey as string) end as reader from {nation})
      select c_custkey, c_nationkey from {customer} join acl on c_nationkey = namespace where reader = 'all' or reader = cast(c_custkey % 5 as string)""",
    "p19_facts_as_of": """with f as (select o_orderkey, o_custkey, o_orderdate as valid_from, lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as valid_until from {orders})
      select o_custkey, o_orderkey from f where valid_from <= timestamp '1996-06-01 00:00:00' and (valid_until is null or valid_until > timestamp '1996-06-01 00:00:00')""",
    "p23_tiers": "select doc_id, case when length(trim(text)) > 0 then substr(text, 1, 400) end as l0, substr(text, 1, 2000) as l1, greatest(1, cast(floor(length(text) / 4) as bigint)) as tokens from {documents}",
    "w4_agent_cap": f"""with {BM25}, v as (select item_id, l.doc_id, rn, source from lexical l join {{documents}} d on l.doc_id = d.doc_id where rn <= 20),
      c as (select *, row_number() over (partition by item_id, source order by rn) as of_agent, greatest(1, cast(floor(count(*) over (partition by item_id) * 0.6) as bigint)) as cap from v)
      select item_id, doc_id, row_number() over (partition by item_id order by case when of_agent > cap then 1 else 0 end, rn) as place from c""",
    "w16_bm25_rescue": f"""with {BM25}, {COSINE}, m as (select item_id, max(score) as top from lexical group by item_id), c as (select l.item_id, l.doc_id, l.score, row_number() over (partition by l.item_id order by round(l.score, 6) desc, l.doc_id) as place
      from lexical l join m on l.item_id = m.item_id left join (select item_id, doc_id from vectors where rn <= 20) v on l.item_id = v.item_id and l.doc_id = v.doc_id where l.score >= 0.6 * top and v.doc_id is null)
      select item_id, doc_id, round(score, 4) as score, place from c where place <= 3""",
    "w13_paging": "select doc_id, n_chars from {documents} order by n_chars desc, doc_id limit 20 offset 40",
    "w19_insights": "with r as (select doc_id, source, substr(text, 1, 100) as head, row_number() over (partition by source, substr(text, 1, 100) order by doc_id) as rn from {documents}) select doc_id, source, head from r where rn = 1",
    "m4_outcome_adjust": """with o as (select JSON_K(props) as memory_id, sum(case event_type when 'purchase' then 0.05 when 'error' then -0.05 else 0 end) as adj from {events} group by 1)
      select d.doc_id, round(greatest(-0.2, least(0.2, coalesce(adj, 0))), 4) as adjust from {documents} d left join o on d.doc_id = o.memory_id""",
    "d3_temporal_decay": """select event_id, round(value * exp(-ln(2.0) * greatest(0, floor((MICROS(timestamp '2024-01-31 00:00:00') - MICROS(ts)) / 86400000000.0)) / 30.0), 4) as score from {events}""",
    "a31_recall_at_k": f"""with {BM25}, kw as (select item_id, count(*) as n from q group by item_id), top as (select distinct l.item_id, tf.term from lexical l join tf on l.doc_id = tf.doc_id where rn <= 5),
      hit as (select q.item_id, count(*) as n from q join top on q.item_id = top.item_id and q.term = top.term group by q.item_id) select kw.item_id, round(coalesce(cast(hit.n as double), 0.0) / kw.n, 4) as recall from kw left join hit on kw.item_id = hit.item_id""",
    "a32_ndcg_at_k": f"""with {BM25}, g as (select l.item_id, l.doc_id, l.rn, count(q.term) as grade from lexical l join q on l.item_id = q.item_id join tf on tf.doc_id = l.doc_id and tf.term = q.term where rn <= 10 group by l.item_id, l.doc_id, l.rn),
      i as (select *, row_number() over (partition by item_id order by grade desc, rn) as ideal from g)
      select item_id, round(sum(grade / log2(cast(rn + 1 as double))) / sum(grade / log2(cast(ideal + 1 as double))), 4) as ndcg from i group by item_id""",
}
