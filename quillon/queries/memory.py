"""Queries over the graph and life-cycle operators, with SQL written by hand from the rules.

The driver's tables stand in for memories: parts and suppliers are entities, line items the relations between them, orders facts of
customers, events changes, conversations sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import graph, memory


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Days of reference, as the tables' dates are fixed.
NOW = "timestamp '2024-02-01 00:00:00'"
_RETENTION = "case o_orderpriority when '1-URGENT' then 'permanent' when '2-HIGH' then 'durable' else 'standard' end"


def j24_two_hop(spark, sf_dir):
    """What every hundredth supplier reaches over the parts it delivers, two hops deep, the nearest 50."""
    edges = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey")).alias("b"))
    seeds = _table(spark, sf_dir, "supplier").where("s_suppkey % 100 = 0").select(F.col("s_suppkey").alias("query"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"))
    return graph.expand(edges, seeds, 2)


def j25_ngram_entities(spark, sf_dir):
    """Parts that are named in sentences made of suppliers' nations and parts' names."""
    asked = _table(spark, sf_dir, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query"), F.concat(F.lit("find the "), F.col("p_name"), F.lit(" ring of Red type")).alias("text"))
    count = _table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("mentions"))
    named = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("name")).join(count, "id")
    return graph.mentions(asked, named)


def j26_graph_hits(spark, sf_dir):
    """Of each hundred documents the even ones are a query's hits and the odd ones what the graph gives, half of these from another file."""
    docs = _table(spark, sf_dir, "documents")
    query = F.floor(F.col("doc_id") / 100).alias("query")
    hits = docs.where("doc_id % 2 = 0").select(query, F.col("doc_id").alias("id"), F.col("source").alias("file"), (1 - F.col("doc_id") % 100 / 100).alias("score"), (F.col("doc_id") % 100 + 1).alias("rank"))
    items = docs.where("doc_id % 2 = 1").select(query, F.when(F.col("doc_id") % 4 == 1, F.col("source")).otherwise(F.lit("other.md")).alias("file"), "text")
    shown = [F.sha2(c, 256).alias(n) for n, c in (("text", F.coalesce("text", F.lit(""))), ("context", F.array_join("context", "|")))]
    return graph.with_graph(hits, items).select("query", F.coalesce("id", F.lit(-1)).alias("id"), "file", F.round("score", 6).alias("score"), *shown)


def z4_lineage(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("memory"), "event_type", F.col("event_id").alias("source"), F.col("ts").alias("at"))
    kinds = {"version": ["signup", "purchase"], "audit": ["error", "click"], "retrieval": ["view"]}
    edges = [events.where(F.col("event_type").isin(*of)).select("memory", F.lit(kind).alias("kind"), "source", "at") for kind, of in kinds.items()]
    return graph.lineage(edges).select("memory", "edge_count", "sources", F.unix_micros(F.col("newest").cast("timestamp")).alias("newest"))


def z6_replay(spark, sf_dir):
    """Chains of orders of a customer, each the child of the one before; every 50th customer's last one is made the parent of its first."""
    orders = _table(spark, sf_dir, "orders")
    spaced = orders.selectExpr("o_orderkey as id", "o_custkey", "lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as before", "max(o_orderkey) over (partition by o_custkey) as last", "count(*) over (partition by o_custkey) as n")
    nodes = spaced.selectExpr("id", "case when before is null and o_custkey % 50 = 0 then last else before end as parent")
    leaves = spaced.where("id = last and n <= 6").selectExpr("id as leaf")
    return graph.replay(nodes, leaves, 8)


def m1_entity_upsert(spark, sf_dir):
    entities = _table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "cast(1 as bigint) as mention_count", "timestamp '1990-01-01 00:00:00' as last_seen", "'durable' as retention")
    seen = _table(spark, sf_dir, "orders").selectExpr("o_custkey + 5 as id", "cast(o_orderdate as timestamp) as at", f"{_RETENTION} as retention")
    return memory.upsert_entities(entities, seen).selectExpr("id", "mention_count", "unix_micros(cast(last_seen as timestamp)) as last_seen", "retention")


def j19_supersede_overlap(spark, sf_dir):
    facts = _table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "o_custkey as entity", "concat_ws(' ', 'status', o_orderstatus, 'with', lower(o_orderpriority), case when o_orderkey % 2 = 0 then 'even' else 'odd' end) as fact")
    return memory.supersede(facts).where("superseded_by is not null").select("id", "entity", "superseded_by")


def m10_resolutions(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").where("o_orderkey % 4 < 2").selectExpr("o_orderkey", "o_custkey", "floor(o_orderkey / 4) as g", "o_orderkey % 4 as side", "date_trunc('year', o_orderdate) as at", "concat_ws(' ', 'order is', case when o_totalprice > 250000 then 'enabled' else 'disabled' end, o_orderpriority) as fact")
    a, b = (orders.where(F.col("side") == k) for k in (0, 1))
    pairs = a.alias("a").join(b.alias("b"), F.col("a.g") == F.col("b.g")).selectExpr("a.o_custkey as entity", "a.o_orderkey as a", "b.o_orderkey as b", "a.fact as text_a", "b.fact as text_b", "a.at as at_a", "b.at as at_b", "case when a.o_orderkey % 12 = 0 then 'near_duplicate' when contains(a.fact, 'enabled') <> contains(b.fact, 'enabled') then 'enabled/disabled' end as trigger")
    return memory.resolutions(pairs).select("a", "b", "action", "winner", "loser", "merged", "resolution_id")


def m9_forget_candidates(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").selectExpr("doc_id as id", "(doc_id % 10) / 10.0D as importance", f"{NOW} - make_interval(0, 0, 0, cast(doc_id % 30 as int)) as created_at", f"case when doc_id % 8 = 0 then {NOW} - make_interval(0, 0, 0, 1) end as ttl_at")
    hot = _table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("id")).agg((F.count("*") / 1000.0).alias("hotness"))
    return memory.forget_candidates(docs, hot.where("id % 3 = 0"), F.expr(NOW))


def m15_cascade_delete(spark, sf_dir):
    """What is left of three tables after every toxic document and its chunks' vectors are gone."""
    docs, vectors, labels = (_table(spark, sf_dir, n) for n in ("documents", "embeddings", "labels"))
    tables = {"points": (vectors.selectExpr("vec_id as id", "floor(vec_id / 2) as parent"), "parent"), "labels": (labels.select("doc_id"), "doc_id"), "chunks": (docs.select("doc_id"), "doc_id")}
    left = memory.cascade_delete(tables, labels.where("toxic = 1").select(F.col("doc_id").alias("id")), ("points", "id"))
    return left["points"].selectExpr("'points' as kind", "id").union(left["labels"].selectExpr("'labels' as kind", "doc_id as id")).union(left["chunks"].selectExpr("'chunks' as kind", "doc_id as id"))


def z10_ttl_invalidation(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "case when o_orderkey % 3 = 0 then 0 else unix_seconds(cast(o_orderdate as timestamp)) end as expires_at")
    return memory.expired(rows, F.expr("unix_seconds(timestamp '1997-01-01 00:00:00')"))


def m13_merge_memories(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").selectExpr("conv_id as group", "turn as id", "turn as at", "role as agent", "text as content", "turn % 4 + 1 as version")
    latest, concat = memory.merge_groups(turns, "latest"), memory.merge_groups(turns, "concat")
    return latest.join(concat.selectExpr("group", "sha2(content, 256) as merged", "version as merged_version"), "group").selectExpr("group as conv_id", "content", "version", "n", "merged", "merged_version")


def m12_reflect_outcome(spark, sf_dir):
    runs = _table(spark, sf_dir, "events").selectExpr("event_id as id", "concat('task ', props) as task", "case event_type when 'error' then ' Failed' when 'purchase' then 'ok' when 'view' then '' else event_type end as outcome", "case when event_id % 2 = 0 then cast(user_id as int) end as score")
    return memory.reflections(runs)


def z13_session_summary(spark, sf_dir):
    return memory.session_summaries(_table(spark, sf_dir, "conversations").selectExpr("conv_id as session", "turn as at", "role as outcome", "text as task"))


def t1_outbox_cycle(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").selectExpr(
        "event_id as id", "case event_type when 'view' then 'applied' when 'click' then 'processing' else 'pending' end as status", "cast(event_id % 6 as int) as tries",
        f"case when event_type in ('view', 'click') then {NOW} - make_interval(0, 0, 0, cast(event_id % 12 as int), 0, 0, cast(event_id % 90 as int)) when event_id % 5 = 0 then {NOW} + make_interval(0, 0, 0, 1) end as last_attempt", "cast(ts as timestamp) as created_at")
    done = memory.drain_cycle(rows, rows.where("id % 3 = 0").select("id"), F.expr(NOW))
    return done.selectExpr("id", "status", "tries", "unix_micros(cast(last_attempt as timestamp)) as last_attempt")


def a34_bootstrap(spark, sf_dir):
    """Intervals of documents' quality by source, from hashes of rows; see the tests for what holds of them."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return memory.bootstrap(docs.select("doc_id", "source").distinct().join(labels.dropDuplicates(["doc_id"]), "doc_id").select(F.coalesce("source", F.lit("")).alias("key"), F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("value")))


QUERIES = {f.__name__: f for f in (j24_two_hop, j25_ngram_entities, j26_graph_hits, z4_lineage, z6_replay, m1_entity_upsert, j19_supersede_overlap, m10_resolutions, m9_forget_candidates, m15_cascade_delete, z10_ttl_invalidation, m13_merge_memories, m12_reflect_outcome, z13_session_summary, t1_outbox_cycle, a34_bootstrap)}

_STOP = ", ".join(f"'{w}'" for w in fixed.ENTITY_STOP_WORDS)
_WORDS = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9_]+'), lambda x: length(x) > 2))"
ORACLES = {
    "j24_two_hop": """with e as (select distinct 's' || l_suppkey as a, 'p' || l_partkey as b from lineitem), u as (select a, b from e union select b, a from e),
      h0 as (select s_suppkey as query, 's' || s_suppkey as id from supplier where s_suppkey % 100 = 0), h1 as (select distinct query, u.b as id from h0 join u on id = a where u.b <> 's' || query),
      h2 as (select distinct query, u.b as id from h1 join u on id = a where u.b <> 's' || query and (query, u.b) not in (select query, id from h1)),
      o as (select query, id, 0 as hop from h0 union all select query, id, 1 from h1 union all select query, id, 2 from h2), r as (select *, row_number() over (partition by query order by hop, id) as place from o)
      select query, id, hop from r where place <= 50""",
    "j25_ngram_entities": f"""with q as (select p_partkey as query, regexp_split_to_array(lower('find the ' || p_name || ' ring of Red type'), ' ') as w from part where p_partkey % 100 = 0),
      n as (select query, n, w[i:i + n - 1] as g from q, unnest([1, 2, 3]) t(n), range(1, 20) r(i) where i + n - 1 <= len(w)), ph as (select distinct query, n, array_to_string(g, ' ') as phrase from n),
      p as (select * from ph where length(phrase) >= 2 and not (n = 1 and phrase in ({_STOP}))), e as (select p_partkey as id, lower(p_name || ' ' || p_size) as name, count(*) as mentions from part join lineitem on p_partkey = l_partkey where l_quantity > 45 group by all),
      f as (select phrase, id, name, mentions, row_number() over (partition by phrase order by mentions desc, id) as place from (select distinct phrase from p) join e on contains(name, phrase))
      select distinct query, id from p join f on p.phrase = f.phrase where place <= 3 and (n > 1 or mentions <= 20 or name = p.phrase)""",
    "j26_graph_hits": """with h as (select doc_id // 100 as query, doc_id as id, source as file, 1 - (doc_id % 100) / 100 as score, doc_id % 100 + 1 as rank from documents where doc_id % 2 = 0),
      i as (select doc_id // 100 as query, case when doc_id % 4 = 1 then source else 'other.md' end as file, text from documents where doc_id % 2 = 1 and text <> ''),
      f as (select *, row_number() over (partition by query, file order by rank) as nth from h), n as (select query, file, count(*) as n, string_agg(substr(text, 1, 300), '|' order by substr(text, 1, 300)) as context from i group by all),
      m as (select f.query, id, f.file, score + case when nth = 1 then coalesce(n, 0) * 0.15 else 0 end as score, '' as text, case when nth = 1 then coalesce(context, '') else '' end as context from f left join n on f.query = n.query and f.file = n.file),
      s as (select query, substr(text, 1, 80) as head, min({'a': text, 'b': file}) as x from i where not exists (select 1 from h where h.query = i.query and h.file = i.file) group by all),
      k as (select *, row_number() over (partition by query order by head) as place from s)
      select query, id, file, round(score, 6) as score, sha256(text) as text, sha256(context) as context from m union all select query, -1, x.b, 0.3, sha256(substr(x.a, 1, 500)), sha256('') from k where place <= 20""",
    "z4_lineage": """with e as (select cast(json_extract_string(props, '$.k') as bigint) as memory, case when event_type in ('signup', 'purchase') then 'version' when event_type in ('error', 'click') then 'audit' when event_type = 'view' then 'retrieval' end as kind, event_id, ts from events)
      select memory, least(count(*), 200) as edge_count, (select string_agg(distinct k.kind, ',' order by k.kind) from (select kind, row_number() over (order by ts desc, kind, event_id) as rn from e x where x.memory = e.memory and kind is not null) k where rn <= 200) as sources, epoch_us(max(ts)) as newest from e where kind is not null group by memory""",
    "z6_replay": """with recursive s as (select o_orderkey as id, o_custkey, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as before, max(o_orderkey) over (partition by o_custkey) as last, count(*) over (partition by o_custkey) as n from orders),
      nodes as (select id, case when before is null and o_custkey % 50 = 0 then last else before end as parent from s), walk as (select id as leaf, id as at, parent as next, 1 as depth, [id] as path, false as cycle from s join nodes using (id) where id = last and n <= 6
      union all select leaf, n.id, n.parent, depth + 1, list_append(path, n.id), list_contains(path, n.id) from walk w join nodes n on n.id = w.next where depth < 8 and not cycle),
      ends as (select leaf, arg_max(path, depth) as path, bool_or(cycle) as cycle from walk group by leaf), c as (select leaf, list_reverse(path) as path from ends where not cycle)
      select leaf, cast(generate_subscripts(path, 1) - 1 as integer) as step, unnest(path) as id from c union all select leaf, null, null from ends where cycle""",
    "m1_entity_upsert": f"""with n as (select o_custkey + 5 as id, count(*) as n, max(o_orderdate) as seen, max(case o_orderpriority when '1-URGENT' then 4 when '2-HIGH' then 3 else 2 end) as rank from orders group by 1)
      select coalesce(c_custkey, id) as id, coalesce(n, 0) + case when c_custkey is null then 0 else 1 end as mention_count, epoch_us(coalesce(seen, timestamp '1990-01-01')) as last_seen,
      ['ephemeral', 'standard', 'durable', 'permanent'][greatest(coalesce(rank, 0), case when c_custkey is null then 0 else 3 end)] as retention from customer full join n on c_custkey = id""",
    "j19_supersede_overlap": """with f as (select o_orderkey as id, o_custkey as entity, list_distinct(list_filter(regexp_split_to_array(lower('status ' || o_orderstatus || ' with ' || lower(o_orderpriority) || ' ' || case when o_orderkey % 2 = 0 then 'even' else 'odd' end), ' '), lambda x: length(x) >= 2)) as w from orders)
      select a.id, a.entity, min(b.id) as superseded_by from f a join f b on a.entity = b.entity and b.id > a.id where len(list_intersect(a.w, b.w)) >= 0.6 * len(a.w) group by a.id, a.entity""",
    "m10_resolutions": f"""with o as (select o_orderkey, o_custkey, o_orderkey // 4 as g, o_orderkey % 4 as side, date_trunc('year', o_orderdate) as at, 'order is ' || case when o_totalprice > 250000 then 'enabled' else 'disabled' end || ' ' || o_orderpriority as fact from orders),
      p as (select a.o_custkey as entity, a.o_orderkey as a, b.o_orderkey as b, a.fact as ta, b.fact as tb, a.at as xa, b.at as xb, case when a.o_orderkey % 12 = 0 then 'near_duplicate' when contains(a.fact, 'enabled') <> contains(b.fact, 'enabled') then 'enabled/disabled' else '' end as trigger from o a join o b on a.g = b.g and a.side = 0 and b.side = 1),
      j as (select *, len(list_intersect({_WORDS('ta')}, {_WORDS('tb')})) / len(list_distinct(list_concat({_WORDS('ta')}, {_WORDS('tb')}))) as overlap from p),
      r as (select *, case when trigger = 'near_duplicate' or overlap >= 0.85 then 'merge' when contains(trigger, '/') and xa <> xb then 'supersede' else 'keep_both' end as action from j)
      select a, b, action, case when action = 'supersede' then case when xa >= xb then a else b end end as winner, case when action = 'supersede' then case when xa >= xb then b else a end end as loser,
      case when action = 'merge' then case when lower(ta) = lower(tb) then ta when contains(lower(tb), lower(ta)) then tb when contains(lower(ta), lower(tb)) then ta else ta || ' | ' || tb end end as merged,
      substr(sha256(entity || ':' || least(a, b) || ':' || greatest(a, b) || ':' || action), 1, 16) as resolution_id from r""",
    "m9_forget_candidates": """with h as (select cast(json_extract_string(props, '$.k') as bigint) as id, count(*) / 1000.0 as hot from events group by 1 having id % 3 = 0),
      c as (select doc_id as id, hot, (doc_id % 10) / 10.0 as importance, doc_id % 30 as age, doc_id % 8 = 0 as over from documents left join h on doc_id = h.id)
      select id, case when over then 'ttl_expired_cold' when hot is null then 'unscored_aged_low_importance' else 'cold_low_importance' end as rule from c where importance <= 0.4 and (hot <= 0.05 or (hot is null and (age > 14 or over))) order by coalesce(hot, 0), importance, id limit 20""",
    "m15_cascade_delete": """with t as (select doc_id from labels where toxic = 1), p as (select vec_id from embeddings where vec_id // 2 in (select doc_id from t)), g as (select doc_id as id from t union select vec_id from p)
      select 'points' as kind, vec_id as id from embeddings where vec_id // 2 not in (select id from g) and vec_id not in (select id from g)
      union all select 'labels', doc_id from labels where doc_id not in (select id from g) union all select 'chunks', doc_id from documents where doc_id not in (select id from g)""",
    "z10_ttl_invalidation": "select o_orderkey as id from orders where o_orderkey % 3 <> 0 and o_orderdate > timestamp '1970-01-01' and o_orderdate <= timestamp '1997-01-01 00:00:00' order by o_orderdate, o_orderkey limit 1000",
    "m13_merge_memories": """with t as (select *, turn % 4 + 1 as version from conversations) select conv_id, arg_max(text, turn) as content, arg_max(version, turn) + 1 as version, count(*) as n,
      sha256(string_agg('[' || turn || ' — ' || coalesce(role, '?') || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by turn)) as merged, max(version) + 1 as merged_version from t group by conv_id having count(*) >= 2""",
    "m12_reflect_outcome": """select event_id as id, case event_type when 'error' then 'recovery' when 'purchase' then 'strategy' else 'optimization' end as category,
      'Reflection on ''' || substr('task ' || props, 1, 200) || ''': outcome=' || case event_type when 'error' then 'failed' when 'purchase' then 'ok' when 'view' then 'unknown' else event_type end || case when event_id % 2 = 0 then ' (score=' || user_id || ')' else '' end || '. ' ||
      case event_type when 'error' then 'Avoid repeating the failing approach; verify preconditions and rollback paths.' when 'purchase' then 'Reuse the successful approach for similar tasks.' else 'Record what was attempted and clarify success criteria next time.' end as tip from events""",
    "z13_session_summary": "select conv_id as session, string_agg('- [' || coalesce(role, 'unknown') || '] ' || substr(coalesce(text, ''), 1, 200), chr(10) order by turn, substr(text, 1, 200)) as summary, count(*) as runs from conversations group by conv_id",
    "t1_outbox_cycle": """with o as (select event_id as id, case event_type when 'view' then 'applied' when 'click' then 'processing' else 'pending' end as status, event_id % 6 as tries,
      case when event_type in ('view', 'click') then timestamp '2024-02-01' - to_days(cast(event_id % 12 as integer)) - to_seconds(event_id % 90) when event_id % 5 = 0 then timestamp '2024-02-02' end as tried, ts from events),
      s as (select id, case when status = 'processing' and tried < timestamp '2024-01-31 23:59:00' then 'pending' else status end as status, tries + case when status = 'processing' and tried < timestamp '2024-01-31 23:59:00' then 1 else 0 end as tries, tried, ts from o),
      old as (select id from s where status = 'applied' and tried < timestamp '2024-01-25' order by tried, id limit 1000), k as (select * from s where id not in (select id from old)),
      c as (select id from k where status = 'pending' and (tried is null or tried < timestamp '2024-02-01') order by ts, id limit 50),
      r as (select k.id, status, tries, tried, c.id is not null as mine, k.id % 3 = 0 as fails from k left join c on k.id = c.id), w as (select *, tries + case when mine and fails then 1 else 0 end as t from r)
      select id, case when mine and not fails then 'applied' when mine and t >= 5 then 'dead' when mine then 'pending' else status end as status, t as tries,
      epoch_us(case when mine and fails and t < 5 then timestamp '2024-02-01' + to_microseconds(cast(least(2 ** t * 0.5, 60) * 1000000 as bigint)) when mine then timestamp '2024-02-01' else tried end) as last_attempt from w""",
}
