"""Entities, relationships, facts, versions, and the lifecycle rules over them."""

QUERIES = {
    "j1_entity_relationships": """select s.s_name as source, p.p_name as target, count(*) as mentions, round(least(0.9 + 0.1 * count(*), 1.0), 2) as confidence
      from {lineitem} join {supplier} s on l_suppkey = s.s_suppkey join {part} p on l_partkey = p.p_partkey group by s.s_name, p.p_name""",
    "j3_namespace_entities": """select distinct c_custkey, c_name from {customer} join {orders} on c_custkey = o_custkey where o_orderstatus = 'O' order by c_custkey limit 10""",
    "j4_entities_with_facts": "select c_custkey, c_name from {customer} where c_custkey in (select o_custkey from {orders} where o_totalprice > 100000)",
    "j7_hotness_left": """with h as (select JSON_K(props) as memory_id, count(*) as n from {events} group by 1) select d.doc_id, coalesce(h.n, 0) as n, case when h.n is null then cast(0.5 as double) else least(cast(1 as double), cast(h.n as double) / 100) end as importance from {documents} d left join h on d.doc_id = h.memory_id""",
    "j11_durable_semi": "select l_orderkey, l_linenumber from {lineitem} where l_suppkey in (select s_suppkey from {supplier} where s_acctbal > 9000) or l_partkey in (select p_partkey from {part} where p_size > 49)",
    "j13_orphans_anti": "select d.doc_id from {documents} d left join {embeddings} e on d.doc_id = e.vec_id where e.vec_id is null",
    "j29_lineage": """with v as (select JSON_K(props) as memory_id, 'version' as edge, count(*) as n from {events} where event_type in ('signup', 'purchase') group by 1), a as (select JSON_K(props) as memory_id, 'audit' as edge, count(*) as n from {events} where event_type in ('error', 'click') group by 1),
      r as (select JSON_K(props) as memory_id, 'retrieval' as edge, count(*) as n from {events} where event_type = 'view' group by 1) select * from v union all select * from a union all select * from r""",
    "m7_decay_facts": """select o_orderkey, case when o_orderpriority in ('1-URGENT', '2-HIGH') then true when o_orderstatus = 'F' and o_orderdate < timestamp '1998-07-01 00:00:00' then false when o_orderdate < timestamp '1998-05-01 00:00:00' then false else true end as is_active from {orders}""",
    "m13_merge_concat": "select conv_id, LISTED(turn, text, ' / ') as merged, count(*) as parts from {conversations} group by conv_id",
    "m23_pin": "select doc_id, case when doc_id % 10 = 0 then 1.0 else 0.5 end as importance, case when doc_id % 10 = 0 then 'permanent' else 'standard' end as retention from {documents}",
    "f26_tokens": "select doc_id, greatest(1, cast(floor(length(text) / 4) as bigint)) as tokens from {documents}",
    "f27_message_tokens": "select conv_id, cast(sum(4 + greatest(1, floor(length(text) / 4))) + 2 as bigint) as tokens from {conversations} group by conv_id",
    "f29_uuid_ids": "select doc_id, concat(substr(md5(cast(doc_id as string)), 1, 8), '-', substr(md5(cast(doc_id as string)), 9, 4), '-', substr(md5(cast(doc_id as string)), 13, 4), '-', substr(md5(cast(doc_id as string)), 17, 4), '-', substr(md5(cast(doc_id as string)), 21, 12)) as point_id from {documents}",
    "f31_fingerprint": "select doc_id, substr(SHA256(trim(SWAP(lower(text), '[ \t\n]+', ' '))), 1, 16) as fingerprint from {documents}",
    "w20_context_split": """with t as (select conv_id, turn, role, sum(4 + greatest(1, floor(length(text) / 4))) over (partition by conv_id order by turn desc) as tail from {conversations}) select conv_id, turn, tail <= 400 as kept from t""",
    "w21_context_hint": """with t as (select conv_id, sum(4 + greatest(1, floor(length(text) / 4))) + 2 as tokens from {conversations} group by conv_id) select conv_id, case when tokens / 800.0 * 100 <= 70 then 'ok' when tokens / 800.0 * 100 <= 90 then 'compress' else 'critical' end as hint from t""",
    "z1_audit_trail": "select event_id, event_type from {events} where user_id = 7 order by ts desc, event_id desc limit 20",
    "z3_owner": """with a as (select JSON_K(props) as memory_id, max(user_id) as agent from {events} group by 1) select d.doc_id, coalesce(nullif(d.source, ''), cast(a.agent as string)) as owner from {documents} d left join a on d.doc_id = a.memory_id""",
}

#: What `search.like_pairs` has to find, without its filters: all pairs of a namespace.
ORACLES = {
    "j18_conflict_pairs": """with w as (select doc_id, coalesce(nullif(lang, ''), 'global') as space, source, SORTEDSET(WORDS(lower(text))) as words from {documents})
      select a.doc_id as a, b.doc_id as b, round(cast(COMMON(a.words, b.words) as double) / EITHER(a.words, b.words), 4) as jaccard from w a join w b on a.space = b.space and a.doc_id < b.doc_id
      where a.source is distinct from b.source and ITEMS(a.words) > 0 and ITEMS(b.words) > 0 and 10 * COMMON(a.words, b.words) >= 7 * EITHER(a.words, b.words)""",
}
