"""Record filters, text rules, time rules and the state of checkpoints, grants and outboxes, each as one query."""

from ..functions.fixed import OPPOSING
from .observability import AUDIT, LOGS
from .retrieval import COSINE, TERMS

# Phrases of exact questions.
EXACT_PHRASES = ("exact", "specific", "what is the", "what was the", "what are the", "find the", "who is", "when is", "when was", "where is", "ip[ \t\n]+address", "port", "cron", "password", "budget", "launch date")
IP = "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+"
ISO_DATE = "[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9]"


def _phrase(pattern: str) -> str:
    """The pattern between word boundaries."""
    return f"(^|[^a-z0-9_]){pattern}([^a-z0-9_]|$)"


_OPPOSED = " ".join(f"when (contains(a, '{x}') and contains(b, '{y}')) or (contains(a, '{y}') and contains(b, '{x}')) then '{x}/{y}'" for x, y in OPPOSING)
FACTS = "f as (select o_orderkey as fact_id, o_custkey as entity_id, o_orderpriority as topic, o_orderdate as valid_from, case o_orderpriority when '1-URGENT' then 'permanent' when '2-HIGH' then 'durable' else 'standard' end as retention, o_totalprice as weight from {orders})"

QUERIES = {
    "p1_payload_filter": "select doc_id from {documents} where lang = 'en' and source in ('src0', 'src1', 'src2') and not coalesce(doc_id % 13 = 0, false) and not coalesce(doc_id % 17 = 0, false)",
    "p2_date_range": f"with {FACTS}, r as (select *, row_number() over (partition by entity_id order by weight desc, fact_id) as place from f where valid_from >= timestamp '1995-01-01 00:00:00' and valid_from <= timestamp '1996-12-31 00:00:00') select entity_id, fact_id, place from r where place <= 3",
    "p17_like_literal": "select event_id from {events} where contains(props, '\"k\"') and contains(props, '7')",
    "p18_entity_search": "select c_custkey, c_name from {customer} where contains(lower(c_name), '12') or contains(lower(c_mktsegment), 'build') order by c_acctbal desc, c_custkey limit 20",
    "p22_protected": f"with {FACTS} select fact_id, (weight >= 250000 or retention in ('durable', 'permanent')) as protected from f",
    "j2_entity_either_side": "select s.s_name as source, p.p_name as target, count(*) as mentions from {lineitem} join {supplier} s on l_suppkey = s.s_suppkey join {part} p on l_partkey = p.p_partkey where l_suppkey = 7 or l_partkey = 7 group by s.s_name, p.p_name",
    "j10_superseded_anti": f"with {FACTS} select fact_id from f where not exists (select 1 from f n where n.entity_id = f.entity_id and n.topic = f.topic and n.valid_from > f.valid_from)",
    "j14_hit_metadata_left": "select d.doc_id, coalesce(l.quality, 0) as quality, coalesce(l.toxic, 0) as toxic from {documents} d left join {labels} l on d.doc_id = l.doc_id",
    "j22_facts_at_dates": f"with {FACTS}, v as (select *, lead(valid_from) over (partition by entity_id order by valid_from, fact_id) as valid_until from f), q as (select * from (values (1994), (1995), (1996), (1997)) t(year)) select year, count(*) as facts, count(distinct entity_id) as entities from v join q on year(valid_from) < q.year and (valid_until is null or year(valid_until) >= q.year) group by year",
    "j23_token_lookup": f"with {TERMS}, p as (select doc_id, EXPLODE(TOKENS(text)) as term from {{documents}}) select q.item_id, q.term, min(doc_id) as first_doc, count(distinct doc_id) as docs from q join p on q.term = p.term group by q.item_id, q.term",
    "a5_dashboard_stats": f"with {LOGS} select count(*) as n, cast(sum(cache_hit) as bigint) as hits, round(avg(duration_ms), 2) as avg_ms, round(cast(sum(cache_hit) as double) / count(*), 3) as hit_rate from logs",
    "a13_queue_counts": "select event_type as status, count(*) as n from {events} group by event_type",
    "a14_inventory": "select coalesce(nullif(lang, ''), 'general') as memory_type, count(*) as n, count(distinct source) as agents from {documents} group by 1",
    "a21_scope_count": "select lang as namespace, count(*) as chunks from {documents} where not coalesce(doc_id % 11 = 0, false) group by lang",
    "a22_wakeup": "select user_id, count(*) as n, MICROS(max(ts)) as last_activity from {events} group by user_id",
    "a24_scopes": "select distinct lang as namespace, source as agent_id from {documents} order by namespace, agent_id limit 500",
    "a25_best_per_candidate": f"with {LOGS} select memory_id, round(max(duration_ms), 4) as best, max(cache_hit) as any_hit from logs group by memory_id",
    "a33_session_recall": "with r as (select conv_id, count(*) as turns, count(case when turn < 4 then 1 end) as early from {conversations} group by conv_id) select conv_id, round(cast(early as double) / turns, 4) as recall from r",
    "a35_token_efficiency": f"with {LOGS}, s as (select policy, duration_ms, tokens_naive - tokens_returned as saved, (tokens_naive - tokens_returned) / tokens_naive * 100 as pct from logs where tokens_naive > 0) select policy, count(*) as n, round(avg(pct), 2) as avg_pct, round(min(pct), 2) as min_pct, round(max(pct), 2) as max_pct, cast(sum(saved) as bigint) as saved, round(avg(duration_ms), 2) as avg_ms from s group by policy",
    "w1_latest_action": f"with {AUDIT}, r as (select *, row_number() over (partition by memory_id order by ts desc, event_id desc) as rn from audit) select memory_id, action, agent_id from r where rn = 1",
    "w9_merge_keep_top": f"with {COSINE}, b as (select item_id, doc_id, score, case when rn <= 3 then 0 else 1 end as late from vectors where rn <= 10), w as (select item_id, doc_id, greatest(0.2, score) as score, 1 as late from vectors v where rn > 10 and rn <= 20), m as (select * from b union all select * from w), o as (select *, row_number() over (partition by item_id order by late, round(score, 6) desc, doc_id) as place from m) select item_id, doc_id, place from o",
    "w18_timeline": f"with {COSINE}, t as (select item_id, v.doc_id, substr(text, 1, 500) as excerpt, row_number() over (partition by item_id order by n_chars, v.doc_id) as place from vectors v join {{documents}} d on v.doc_id = d.doc_id where rn <= 50) select item_id, doc_id, excerpt, place from t where place <= 30",
    "f15_opposing_keywords": f"with p as (select conv_id, turn, lower(text) as a, lower(lead(text) over (partition by conv_id order by turn)) as b from {{conversations}}) select conv_id, turn, case {_OPPOSED} end as trigger_pair from p",
    "f16_redact": "select doc_id, REDACTED(text) as redacted from {documents}",
    "f24_needle_query": f"select item_id, {' or '.join(f'''MATCHES(lower(text), '{_phrase(p)}')''' for p in EXACT_PHRASES)} or MATCHES(text, '{IP}') as needle from {{benchmark}}",
    "f25_context_header": "select doc_id, concat('[agent ', source, ' | ', lang, ']', text) as augmented from {documents}",
    "f28_truncate": "select doc_id, case when length(text) > 4 * 200 then concat(substr(text, 1, 4 * 200), '…') else text end as shown from {documents}",
    "f30_checksum": "select doc_id, SHA256(text) as checksum from {documents}",
    "f32_dedupe_keys": "select doc_id, substr(SHA256(concat(lang, '|', source, '|', text)), 1, 24) as dedupe_key from {documents}",
    "f34_uris": "select doc_id, concat('memory://', lang, '/doc/', cast(doc_id as string), '?agent=', source) as uri from {documents}",
    "d2_days_since": "select event_id, round(greatest(cast(0 as double), cast(MICROS(timestamp '2024-01-31 00:00:00') - MICROS(ts) as double) / 86400000000), 6) as days from {events}",
    "d5_dates": f"select doc_id, HITS(text, '{ISO_DATE}') as dates from {{documents}}",
    "d6_ttl": "select doc_id, case when doc_id % 10 = 9 then null else MICROS(timestamp '2024-01-31 00:00:00' + DAYS(doc_id % 60)) end as expires from {documents}",
    "m26_checkpoint_state": "with c as (select user_id as checkpoint_id, event_type, ts, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as rn, count(*) over (partition by user_id) as steps from {events}) select checkpoint_id, case event_type when 'signup' then 'created' when 'purchase' then 'approved' when 'error' then 'interrupted' else 'running' end as state, steps from c where rn = 1",
    "m27_share_grants": "with g as (select user_id, JSON_K(props) as memory_id, event_type, ts, event_id from {events}), o as (select *, row_number() over (partition by user_id, memory_id order by ts, event_id) as rn from g where event_type in ('purchase', 'error')), r as (select distinct user_id, memory_id from g) select r.user_id, r.memory_id, case when o.event_type = 'purchase' then 'accepted' when o.event_type = 'error' then 'rejected' else 'pending' end as status from r left join o on r.user_id = o.user_id and r.memory_id = o.memory_id and o.rn = 1",
    "t3_retention_prune": "select event_id from {events} where event_type in ('view', 'purchase') and ts < timestamp '2024-01-24 00:00:00' order by ts, event_id limit 1000",
    "r15_threshold_relief": f"with {COSINE}, v as (select v.item_id, v.doc_id, score, case when MATCHES(text, '[0-9]') then greatest(0.25, 0.4 - 0.15) else 0.4 end as threshold from vectors v join {{benchmark}} b on v.item_id = b.item_id where rn <= 20) select item_id, doc_id, round(score, 5) as score from v where score >= threshold",
}
