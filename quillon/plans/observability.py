"""Usage analytics over retrieval and audit logs (events), ratings (labels) and outcomes."""

#: events as a retrieval log: policy is the event type, tokens follow the value and the memory.
LOGS = """logs as (select event_id, ts, user_id as agent_id, event_type as policy, value as duration_ms, JSON_K(props) as memory_id,
  case when event_type = 'view' then 1 else 0 end as cache_hit, event_id % 12 as result_count,
  cast(JSON_K(props) * 40 as double) as tokens_naive, cast(floor(value) as double) as tokens_returned from {events})"""
WINDOW = "ts >= timestamp '2024-01-17 00:00:00' and ts < timestamp '2024-01-31 00:00:00'"
#: events as an audit log.
AUDIT = """audit as (select event_id, ts, user_id as agent_id, JSON_K(props) as memory_id,
  case event_type when 'signup' then 'create' when 'purchase' then 'update' when 'error' then 'delete' when 'click' then 'merge' else 'conflict' end as action from {events})"""

QUERIES = {
    "a1_retrieval_stats": f"""with {LOGS} select count(*) as total, cast(sum(cache_hit) as bigint) as hits, round(avg(duration_ms), 1) as avg_ms, round(min(duration_ms), 4) as min_ms,
      round(max(duration_ms), 4) as max_ms, round(avg(result_count), 1) as avg_results, round(cast(sum(cache_hit) as double) / count(*), 3) as hit_rate from logs where {WINDOW}""",
    "a2_top_agents": f"with {LOGS} select agent_id, count(*) as n from logs where {WINDOW} group by agent_id order by n desc, agent_id limit 10",
    "a3_token_savings": f"""with {LOGS}, s as (select *, case when tokens_naive > 0 then (tokens_naive - tokens_returned) / tokens_naive * 100 end as pct from logs where {WINDOW})
      select count(*) as n, round(avg(pct), 2) as avg_pct, round(min(pct), 2) as min_pct, round(max(pct), 2) as max_pct, cast(sum(case when tokens_naive > 0 then tokens_naive - tokens_returned else 0 end) as bigint) as saved,
      cast(sum(tokens_returned) as bigint) as returned, cast(sum(tokens_naive) as bigint) as naive, cast(sum(case when pct > 0 then 1 else 0 end) as bigint) as rows_with_savings from s""",
    "a4_savings_by_policy": f"""with {LOGS} select policy, count(*) as n, round(avg(case when tokens_naive > 0 then (tokens_naive - tokens_returned) / tokens_naive * 100 end), 2) as avg_pct,
      cast(sum(case when tokens_naive > 0 then tokens_naive - tokens_returned else 0 end) as bigint) as saved from logs where policy is not null and policy <> '' and {WINDOW} group by policy""",
    "a6_savings_cost": f"""with {LOGS} select policy, round(sum(case when tokens_naive > 0 then tokens_naive - tokens_returned else 0 end) / 1000 * 0.003, 4) as usd from logs group by policy""",
    "a7_tier_distribution": f"with {LOGS} select policy, count(*) as n, round(avg(result_count), 2) as avg_results from logs group by policy",
    "a8_conflict_rate": f"""with {AUDIT}, c as (select cast(sum(case when action in ('create', 'merge', 'update') then 1 else 0 end) as bigint) as writes,
      cast(sum(case when action = 'conflict' then 1 else 0 end) as bigint) as conflicts from audit) select writes, conflicts, case when writes = 0 then 0.0 else round(cast(conflicts as double) / writes, 3) end as rate from c""",
    "a9_stale_estimate": """with t as (select doc_id, case when doc_id % 3 = 0 then timestamp '2024-01-01 00:00:00' + DAYS(doc_id % 60) end as ttl from {documents})
      select count(*) as total, cast(sum(case when ttl <= timestamp '2024-01-31 00:00:00' then 1 else 0 end) as bigint) as stale from t""",
    "a10_batch_size": f"""with {LOGS}, {AUDIT}, r as (select cast(sum(cache_hit) as double) / count(*) as hit from logs),
      c as (select cast(sum(case when action = 'conflict' then 1 else 0 end) as double) / sum(case when action in ('create', 'merge', 'update') then 1 else 0 end) as rate from audit)
      select cast(greatest(1, least(10, round(5.0 - case when rate > 0.2 then 2 when rate > 0.05 then 1 else 0 end - case when hit < 0.1 then 0.5 else 0 end))) as int) as batch_size from r, c""",
    "a11_live_by_namespace": f"""with {AUDIT}, w as (select *, row_number() over (partition by memory_id order by ts desc, event_id desc) as rn from audit)
      select case when agent_id % 7 = 0 then '_default' else cast(agent_id % 7 as string) end as namespace, count(*) as live from w where rn = 1 and action <> 'delete' group by 1""",
    "a12_outbox_status": """with o as (select event_id, ts, case event_type when 'signup' then 'pending' when 'error' then 'dead' when 'click' then 'processing' else 'applied' end as status from {events})
      select status, count(*) as n, min(case when status = 'pending' then MICROS(ts) end) as oldest_pending from o group by status""",
    "a15_rating_summary": "select count(*) as n, cast(sum(case when quality > 0 then 1 else 0 end) as bigint) as up, cast(sum(case when toxic > 0 then 1 else 0 end) as bigint) as down from {labels}",
    "a16_fingerprint_groups": """with t as (select substr(SHA256(trim(SWAP(lower(text), '[ \t\n]+', ' '))), 1, 16) as fingerprint, source as agent_id, doc_id from {documents}),
      j as (select t.*, case when quality = 1 then 'success' when quality = 0 then 'failure' end as outcome from t left join {labels} l on t.doc_id = l.doc_id)
      select fingerprint, count(distinct agent_id) as agents, count(*) as n, cast(sum(case when outcome = 'success' then 1 else 0 end) as bigint) as successes, cast(sum(case when outcome = 'failure' then 1 else 0 end) as bigint) as failures,
      JOINED(SORTED(agent_id), ',') as agent_list from j group by fingerprint having count(distinct agent_id) >= 2""",
    "a17_multi_agent_entities": "select l_partkey as entity_id, count(*) as n, count(distinct l_suppkey) as agents from {lineitem} group by l_partkey having count(*) >= 2 and count(distinct l_suppkey) >= 2",
    "a18_reconsolidation_groups": """with g as (select lang as namespace, source as agent_id, count(*) as n from {documents} where n_chars >= 200 group by lang, source having count(*) >= 5),
      top as (select * from g order by n desc, namespace, agent_id limit 20),
      c as (select d.lang as namespace, d.source as agent_id, d.doc_id, row_number() over (partition by d.lang, d.source order by d.doc_id) as rn from {documents} d join top on d.lang = top.namespace and d.source = top.agent_id where d.n_chars >= 200)
      select namespace, agent_id, doc_id, rn from c where rn <= 3""",
    "a19_hotness": f"""with {LOGS}, h as (select memory_id, count(*) as n, max(MICROS(ts)) as last from logs group by memory_id)
      select memory_id, n, round(1 / (1 + exp(-ln(1.0 + n))) * power(2, -greatest(0, (MICROS(timestamp '2024-01-31 00:00:00') - last) / 86400000000.0) / 7.0), 5) as score from h""",
    "a20_next_version": f"with {AUDIT} select memory_id, cast(row_number() over (partition by memory_id order by ts, event_id) as bigint) as version, event_id from audit",
    "a23_entities_by_type": """with e as (select c_mktsegment as type, c_name as name, c_acctbal, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as rn from {customer})
      select type, LISTED(rn, name, ',') as names from e where rn <= 15 group by type""",
    "a26_hit_dedupe": """with h as (select doc_id, substr(SHA256(concat(source, ':', substr(text, 1, 240))), 1, 32) as dedupe_key, n_chars as score, doc_id % 2 = 0 as synthetic from {documents}),
      r as (select *, row_number() over (partition by dedupe_key order by score desc, doc_id) as rn, max(case when synthetic then 1 else 0 end) over (partition by dedupe_key) as any_synthetic from h) select doc_id, dedupe_key, score, any_synthetic from r where rn = 1""",
    "a27_histogram": f"""with {LOGS}, b as (select * from (values (5), (10), (25), (50), (100), (250), (500), (1000), (2500), (5000), (10000)) v(bound))
      select cast(bound as bigint) as bound, cast(sum(case when duration_ms <= bound then n else 0 end) as bigint) as n from (select ceil(duration_ms) as duration_ms, count(*) as n from logs group by 1) d cross join b group by bound""",
    "a28_counters": f"with {LOGS} select policy, cache_hit, count(*) as n, round(sum(duration_ms), 2) as total from logs group by policy, cache_hit",
    "a30_latency_summary": f"""with {LOGS}, r as (select policy, duration_ms, row_number() over (partition by policy order by duration_ms, event_id) as rn, count(*) over (partition by policy) as n from logs)
      select policy, n, round(avg(duration_ms), 3) as mean_ms, round(max(case when rn = floor(0.95 * n) + 1 then duration_ms end), 4) as p95 from r group by policy, n""",
}
