"""Visibility, ownership, life-cycle and lookup rules, each as one query."""

from .observability import AUDIT
from .records import FACTS
from .retrieval import COSINE

#: Facts with the next fact of their entity and topic, which supersedes them.
CHAIN = f"{FACTS}, v as (select *, lead(fact_id) over (partition by entity_id, topic order by valid_from, fact_id) as superseded_by from f)"

QUERIES = {
    "s10_scroll": "select doc_id, source from {documents} where lang = 'en' and n_chars >= 50",
    "s12_point_lookup": "select vec_id, label from {embeddings} where vec_id in (select item_id from {benchmark})",
    "s18_scope_load": "select doc_id, source, n_chars from {documents} where lang = 'en' and not coalesce(doc_id % 13 = 0, false) order by source, doc_id",
    "p5_fact_visibility": f"with {CHAIN} select fact_id, entity_id from v where superseded_by is null and fact_id % 17 <> 0",
    "p6_row_visibility": """with r as (select event_id, case JSON_K(props) % 5 when 0 then ' yes' when 1 then 'ON' when 2 then '0' when 3 then '' end as suppressed, case event_id % 4 when 0 then '7' when 1 then '0' when 2 then '' end as superseded_by from {events})
      select event_id, not coalesce(lower(trim(suppressed)) in ('1', 'true', 'yes', 'on'), false) and coalesce(superseded_by, '') in ('', '0') as visible from r""",
    "p9_static_threshold": f"with {COSINE} select item_id, doc_id from vectors where rn <= 20 and score >= 0.2",
    "p12_stable_memories": """with r as (select doc_id, case when doc_id % 3 = 0 then '  ' else substr(text, 1, 400) end as tier_text, case when doc_id % 5 <> 0 then text end as body, substr(text, 1, 40) as l0 from {documents}),
      s as (select doc_id as id, case when trim(tier_text) <> '' then tier_text when trim(body) <> '' then body when trim(l0) <> '' then l0 end as memory from r) select id, memory from s where memory is not null""",
    "p13_graph_acl": """select l_orderkey, l_linenumber from {lineitem} join {supplier} on l_suppkey = s_suppkey join {nation} on s_nationkey = n_nationkey
      where n_regionkey in (select r_regionkey from {region} where r_name in ('ASIA', 'EUROPE'))""",
    "p15_readable_split": "select source as agent_id, min(lang) as namespace, min(lang) in ('de', 'en') as allowed from {documents} group by source",
    "p24_facts_belong": f"""with {FACTS}, asked as (select o_orderkey as fact_id, case when o_orderkey % 7 = 0 then o_custkey + 1 else o_custkey end as entity_id from {{orders}})
      select a.entity_id, count(*) as asked, count(f.fact_id) = count(*) as belong from asked a left join f on a.fact_id = f.fact_id and a.entity_id = f.entity_id group by a.entity_id""",
    "j8_heatmap": """with h as (select JSON_K(props) as memory_id, count(*) as hits from {events} group by 1)
      select memory_id, hits, source from h left join {documents} d on memory_id = d.doc_id order by hits desc, memory_id limit 50""",
    "j12_last_activity_semi": "select user_id, MICROS(max(ts)) as last_activity from {events} where user_id in (select c_custkey from {customer} where c_mktsegment = 'BUILDING') group by user_id",
    "j15_outcome_sums": f"""with {AUDIT}, o as (select memory_id, sum(case action when 'update' then 1 when 'delete' then -1 else 0 end) as total from audit group by memory_id)
      select doc_id, cast(coalesce(total, 0) as bigint) as adjustment from {{documents}} left join o on doc_id = memory_id""",
    "j27_training_set": f"""with {COSINE}, g as (select item_id, v.doc_id, cast(1 + coalesce(l.quality, 0) as bigint) as grade, count(*) over (partition by item_id) as n from vectors v left join {{labels}} l on v.doc_id = l.doc_id where rn <= 10)
      select item_id, doc_id, grade from g where n >= 2""",
    "w3_result_identity": "select doc_id, case when doc_id % 2 = 0 then cast(doc_id as string) else concat(source, ':', lang, ':', substr(text, 1, 80)) end as identity from {documents}",
    "w11_fact_order": f"with {CHAIN} select fact_id, superseded_by from v order by case when superseded_by is null then 0 else 1 end, valid_from desc, fact_id limit 50",
    "f13_jaccard": """with p as (select conv_id, turn, SORTEDSET(WORDS(lower(text))) as a, SORTEDSET(WORDS(lower(lead(text) over (partition by conv_id order by turn)))) as b from {conversations})
      select conv_id, turn, case when ITEMS(a) = 0 or ITEMS(b) = 0 then cast(0 as double) else cast(COMMON(a, b) as double) / EITHER(a, b) end as jaccard from p where b is not null""",
    "f14_normalized_names": "select c_custkey, trim(SWAP(lower(c_name), '[^a-z0-9_ \t\n-]', '')) as name from {customer}",
    "m2_relationship_upsert": "select l_suppkey as source_id, l_partkey as target_id, least(cast(1 as double), round(0.9 + 0.1 * count(*), 4)) as confidence, max(l_orderkey) as evidence from {lineitem} group by l_suppkey, l_partkey",
    "m14_suppression_state": """with a as (select JSON_K(props) as memory_id, event_type, row_number() over (partition by JSON_K(props) order by ts desc, event_id desc) as rn from {events} where event_type in ('click', 'purchase'))
      select doc_id, coalesce(event_type = 'purchase', false) as suppressed from {documents} left join a on doc_id = memory_id and rn = 1""",
    "m18_needle_register": "with t as (select doc_id, EXPLODE(TOKENS(text)) as token from {documents}) select distinct token, doc_id as memory_id from t where length(token) >= 4 and MATCHES(token, '^[0-9]+$')",
    "m21_conflict_gate": f"with {COSINE} select item_id, doc_id, case when score >= 0.95 then 'manual_review' when score >= 0.85 then 'merge' else 'store' end as action from vectors where rn = 1",
    "r14_topic_fallback": f"""with {COSINE}, t as (select v.item_id, v.doc_id, lang = 'en' as topical from vectors v join {{documents}} d on v.doc_id = d.doc_id where rn <= 20),
      n as (select item_id, count(case when topical then 1 end) as hits from t group by item_id) select t.item_id, t.doc_id from t join n on t.item_id = n.item_id where topical or hits < 3""",
    "r21_context_status": """with s as (select conv_id, cast(sum(floor(length(text) / 4)) as bigint) as tokens from {conversations} group by conv_id)
      select conv_id, tokens, round(cast(tokens as double) / 2000 * 100, 2) as pct, case when tokens * 100 > 80 * 2000 then 'compress' end as hint from s""",
}
