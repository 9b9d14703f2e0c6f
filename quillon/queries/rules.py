"""Visibility, lookup, conflict, version, tip and state rules over the driver's tables, with SQL written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ranking, search
from ..sources import archives
from ..streaming import outbox
from . import texts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6_literal_search(spark, sf_dir):
    """Notes that hold one of the first three literal tokens of every 100th note."""
    notes = texts.notes(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("note").alias("text"))
    return search.literal_hits(notes, notes.where("id % 100 = 0").withColumnRenamed("id", "query")).distinct()


def j23_token_lookup(spark, sf_dir):
    """The documents that hold each token of the items."""
    docs, asked = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    found = ranking.token_lookup(docs.select(F.col("doc_id").alias("id"), "text"), asked.select(F.col("item_id").alias("query"), "text"))
    return found.select(F.col("query").alias("item_id"), "term", F.col("first").alias("first_doc"), "docs")


def j18_conflict_pairs(spark, sf_dir):
    """Documents of one language and different sources whose words are nearly the same."""
    space = F.expr("coalesce(nullif(lang, ''), 'global')").alias("space")
    return search.like_pairs(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), space, "source", "text"))


def j17_opposing_facts(spark, sf_dir):
    facts = _table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "o_custkey as entity", "o_orderstatus as agent", "concat('Service is ', case when o_orderkey % 3 = 0 then 'UP and running' when o_orderkey % 3 = 1 then 'down, stopped' else 'open' end) as fact")
    return search.opposed(facts)


def j20_vector_conflicts(spark, sf_dir):
    """Of every 100th vector, the nearest of its label that belong to another agent."""
    vectors = _table(spark, sf_dir, "embeddings").selectExpr("vec_id as id", "embedding as vector", "label as namespace", "vec_id % 3 as agent")
    new = vectors.where("id % 100 = 0").withColumnRenamed("id", "query")
    return search.vector_conflicts(new, vectors, 0.2, 5).select("query", "id", F.round("score", 5).alias("score"))


def p16_namespace_suggestions(spark, sf_dir):
    nations = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    return search.suggestions(nations.select(F.concat(F.substring("name", 1, 4), F.lit("x")).alias("asked")), nations).select("asked", "name", "place")


def p3_fts_row_filter(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where("doc_id % 13 <> 0 and doc_id % 17 <> 0 and lang = 'en' and source <> 'src3'").select("doc_id", "source")


def p7_batch_visibility(spark, sf_dir):
    """Visible ids of each user's batch of memories."""
    rows = _table(spark, sf_dir, "events").selectExpr("user_id", "cast(get_json_object(props, '$.k') as bigint) as memory")
    visible = _table(spark, sf_dir, "documents").where("doc_id % 7 <> 0").select(F.col("doc_id").alias("memory"))
    return rows.join(visible, "memory", "left_semi").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("memory")), lambda x: x.cast("string")), ",").alias("visible"))


def p20_extraction_paths(spark, sf_dir):
    """Files whose path begins with a known prefix and has no skipped part."""
    path = F.concat(F.element_at(F.array(*map(F.lit, ("agents/", "memories/", "tmp/"))), (F.col("doc_id") % 3 + 1).cast("int")), F.col("source"), F.when(F.col("doc_id") % 5 == 0, "/archive/a.md").otherwise("/a.md"))
    return _table(spark, sf_dir, "documents").select("doc_id", path.alias("path")).where(F.col("path").rlike("^(agents|memories)/") & ~F.col("path").rlike("(^|/)(archive|trash)(/|$)"))


def j5_recent_facts(spark, sf_dir):
    """The five newest and five weightiest facts, with the names of their entities."""
    facts = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    newest = facts.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(5).select(F.lit("recent").alias("kind"), "o_orderkey", "c_name")
    return newest.union(facts.where("o_orderpriority = '1-URGENT'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).select(F.lit("pinned").alias("kind"), "o_orderkey", "c_name"))


def j16_live_hits(spark, sf_dir):
    """Registry hits whose payload is alive."""
    hits = _table(spark, sf_dir, "events").selectExpr("event_id", "cast(get_json_object(props, '$.k') as bigint) as memory")
    live = _table(spark, sf_dir, "documents").where("doc_id % 9 <> 0 and text is not null").select(F.col("doc_id").alias("memory"), "source")
    return hits.join(live, "memory").select("event_id", "memory", "source")


def j28_children(spark, sf_dir):
    """Points of every tenth memory: itself, its parts and its questions."""
    points = _table(spark, sf_dir, "embeddings").selectExpr("vec_id", "vec_id - vec_id % 10 as parent", "case vec_id % 10 when 0 then 'primary' when 9 then 'question' else 'part' end as kind")
    return points.groupBy("parent").agg(F.count("*").alias("points"), F.sum(F.when(F.col("kind") == "question", 1).otherwise(0)).alias("questions"), F.max("vec_id").alias("last"))


def u2_registry_union(spark, sf_dir):
    """Ids that any agent's registry holds for a token, once."""
    lines = _table(spark, sf_dir, "lineitem")
    return lines.where("l_returnflag = 'A'").select("l_partkey").union(lines.where("l_returnflag = 'R'").select("l_partkey")).dropDuplicates(["l_partkey"])


def u7_shared_relations(spark, sf_dir):
    """Parts that suppliers 1 and 2 both deliver."""
    lines = _table(spark, sf_dir, "lineitem")
    return lines.where("l_suppkey = 1").select("l_partkey").distinct().join(lines.where("l_suppkey = 2").select("l_partkey"), "l_partkey", "left_semi")


def w5_graph_agent_cap(spark, sf_dir):
    """Items of a neighbourhood with one agent's share capped, where there are two agents or more."""
    items = _table(spark, sf_dir, "orders").selectExpr("o_custkey as query", "o_orderkey as id", "o_orderpriority as agent", "row_number() over (partition by o_custkey order by o_orderkey) as rank")
    return ranking.agent_cap(items).select("query", "id", "place")


def w15_adaptive_widen(spark, sf_dir):
    """Queries of which fewer than three hits pass the threshold look at three times as many."""
    vectors = _table(spark, sf_dir, "embeddings").selectExpr("vec_id as id", "embedding as vector")
    asked = _table(spark, sf_dir, "benchmark").selectExpr("item_id as query", "item_id as own").join(vectors, F.col("own") == F.col("id")).select("query", "vector", "own")
    wide = ranking.cosine_topk(vectors, asked, 12).withColumn("passes", F.col("score") >= 0.3)
    few = wide.where("rank <= 4").groupBy("query").agg(F.sum(F.col("passes").cast("int")).alias("n"))
    return wide.join(few, "query").where((F.col("rank") <= 4) & F.col("passes") | (F.col("n") < 3) & (F.col("rank") > 4) & (F.col("score") >= 0.25)).select("query", "id")


def s11_keyset_page(spark, sf_dir):
    return archives.page(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 700, 25)


def s14_tagged_rows(spark, sf_dir):
    nation, region = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), _table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return archives.tagged({"nation": nation, "region": region})


def s19_fork(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").selectExpr("cast(doc_id as string) as id", "cast(case when doc_id > 3 then doc_id - 3 end as string) as parent", "source")
    return archives.fork(docs, "branch", ("id", "parent"))


def s21_metrics_text(spark, sf_dir):
    """Counters as lines of text."""
    counted = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counted.select(F.format_string('events_total{type="%s"} %d', "event_type", "n").alias("line"))


def m4_invalidate_facts(spark, sf_dir):
    """Facts after some were invalidated, superseded or given an alias once."""
    return _table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as fact_id", "case when o_orderkey % 5 = 0 then '2024-02-01' when o_orderkey % 7 = 0 then cast(date(o_orderdate) as string) end as valid_until", "case when o_orderkey % 11 = 0 then o_orderkey + 1 end as superseded_by",
        "array_join(array_union(array(lower(o_orderpriority)), array(lower(case when o_orderkey % 2 = 0 then o_orderpriority else o_orderstatus end))), ',') as aliases")


def m16_orphan_sweep(spark, sf_dir):
    """Chunk ids and needle ids that the vector store lacks."""
    docs, vectors = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")).where("doc_id % 4 <> 1")
    needles = _table(spark, sf_dir, "labels").select("doc_id")
    return docs.select(F.lit("chunk").alias("kind"), "doc_id").union(needles.select(F.lit("needle").alias("kind"), "doc_id")).distinct().join(vectors, "doc_id", "left_anti")


def m19_point_registry(spark, sf_dir):
    """The registry after points were registered again: those known keep their kind."""
    known = _table(spark, sf_dir, "embeddings").where("vec_id % 3 = 0").selectExpr("vec_id as point_id", "'known' as kind")
    new = _table(spark, sf_dir, "documents").selectExpr("doc_id as point_id", "'new' as kind").dropDuplicates(["point_id"])
    return known.union(new.join(known, "point_id", "left_anti"))


def m20_versions(spark, sf_dir):
    """Each change of a memory as a version with its parent."""
    w = Window.partitionBy("memory_id").orderBy("event_id")
    rows = _table(spark, sf_dir, "events").where("event_type in ('signup', 'purchase')").selectExpr("cast(get_json_object(props, '$.k') as bigint) as memory_id", "event_id")
    return rows.select("memory_id", "event_id", F.row_number().over(w).cast("long").alias("version"), F.lag("event_id").over(w).alias("parent"))


def z2_accessible_namespaces(spark, sf_dir):
    """Namespaces that each of three agents may read or write."""
    acl = _table(spark, sf_dir, "nation").selectExpr("n_nationkey as namespace", "case when n_regionkey = 0 then array('all') else array(concat('a', n_regionkey)) end as readers", "array(concat('a', n_nationkey % 3)) as writers")
    agents = spark.createDataFrame([("a0",), ("a1",), ("a2",)], "agent string")
    both = acl.withColumn("who", F.explode(F.array_distinct(F.concat("readers", "writers")))).join(agents, (F.col("who") == F.col("agent")) | (F.col("who") == "all"))
    return both.groupBy("agent", "namespace").agg(F.bool_or((F.col("who") == "all") | F.array_contains("readers", F.col("agent"))).alias("can_read"), F.bool_or(F.array_contains("writers", F.col("agent"))).alias("can_write"))


def z5_scope_versions(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").selectExpr("o_orderpriority as namespace", "o_orderkey as version_id", "row_number() over (partition by o_orderpriority order by o_orderkey) as version")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("namespace").orderBy(F.desc("version")))).where("place <= 10").select("namespace", "version_id", "version")


def z7_resume_gate(spark, sf_dir):
    """Whether a checkpoint may be resumed: interrupted ones only after an approval, and by their owner."""
    last = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("approved"), F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("interrupted"))
    open_ = F.col("interrupted").isNotNull() & (F.col("approved").isNull() | (F.col("approved") < F.col("interrupted")))
    return last.select("user_id", F.when(F.col("user_id") % 10 == 0, "not_owner").when(open_, "blocked").otherwise("ok").alias("gate"))


def z8_unreflected(spark, sf_dir):
    """Runs without a reflection, newest first, 30 of them."""
    runs, tips = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return runs.join(tips, "o_orderkey", "left_anti").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(30).select("o_orderkey")


def z11_index_tokens(spark, sf_dir):
    """Token sizes of an index of names, as text and as JSON."""
    rows = _table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.array_sort(F.collect_list("c_name")).alias("names"))
    size = lambda c: F.greatest(F.lit(1).cast("long"), F.floor(F.char_length(c) / 4))
    return rows.select("c_mktsegment", size(F.array_join(F.transform("names", lambda n: F.concat(F.lit("- "), n)), "\n")).alias("as_text"), size(F.to_json("names")).alias("as_json"))


def d7_tolerant_times(spark, sf_dir):
    """Times with and without a zone mark, else the least one."""
    said = F.expr("case event_id % 4 when 0 then concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), 'Z') when 1 then date_format(ts, 'yyyy-MM-dd HH:mm:ss') when 2 then 'soon' end")
    return _table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.coalesce(F.try_to_timestamp(F.rtrim(said, F.lit("Z")), F.lit("yyyy-MM-dd HH:mm:ss")), F.lit("0001-01-01 00:00:00").cast("timestamp"))).alias("at"))


def d8_valid_from(spark, sf_dir):
    """The given date, else the one in the path."""
    path = F.expr("concat('notes/', cast(date(o_orderdate) as string), case when o_orderkey % 3 = 0 then '.md' else '-x.md' end)")
    given = F.expr("case when o_orderkey % 4 = 0 then '2020-01-01' else '' end")
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.when(given != "", given).otherwise(F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})", 1)).alias("valid_from"))


def f18_merged_texts(spark, sf_dir):
    from ..operators import memory

    rows = _table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "text", "lead(case when turn % 3 = 0 then reverse(substr(text, 1, 20)) else text end) over (partition by conv_id order by turn) as next", "case when turn % 4 = 0 then concat(text, ' more') end as own")
    return rows.select("conv_id", "turn", memory.merged_text(F.col("text"), F.coalesce("own", "next")).alias("merged"))


def t10_sessions(spark, sf_dir):
    events = _table(spark, sf_dir, "events").selectExpr("cast(user_id as string) as key", "case event_type when 'purchase' then 'flush' when 'view' then 'get' else 'put' end as op", "cast(event_id as string) as value", "cast(ts as timestamp) as at")
    return outbox.sessions(events, F.expr("timestamp '2024-01-20 00:00:00'"), 864_000, 40).select("key", "value")


QUERIES = {f.__name__: f for f in (r6_literal_search, j18_conflict_pairs, j23_token_lookup, j17_opposing_facts, j20_vector_conflicts, p16_namespace_suggestions, p3_fts_row_filter, p7_batch_visibility, p20_extraction_paths, j5_recent_facts, j16_live_hits, j28_children, u2_registry_union, u7_shared_relations, w5_graph_agent_cap, w15_adaptive_widen, s11_keyset_page, s14_tagged_rows, s19_fork, s21_metrics_text, m4_invalidate_facts, m16_orphan_sweep, m19_point_registry, m20_versions, z2_accessible_namespaces, z5_scope_versions, z7_resume_gate, z8_unreflected, z11_index_tokens, d7_tolerant_times, d8_valid_from, f18_merged_texts, t10_sessions)}

_NEEDLES = r"""list_concat(regexp_extract_all(text, '\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?:/\d{1,2})?'), regexp_extract_all(text, '(?:[\d*]+\s){4}[\d*]+'), regexp_extract_all(text, '[\d,]+\s*(?:MiB|GiB|KiB|TiB|ms|KB|MB|GB|TB|PB)\b'),
  regexp_extract_all(text, '[A-Z]{2,}-\d{4,}'), regexp_extract_all(text, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}'), regexp_extract_all(text, '(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}'), regexp_extract_all(text, '[A-Z_]{2,}=\S+'), regexp_extract_all(text, '(?m)(?:^|\s):\d{2,5}\b'))"""
_OPPOSED = "[" + ", ".join(f"['{a}', '{b}']" for a, b in search.OPPOSING) + "]"
_COS = "list_dot_product(cast({0} as double[]), cast({1} as double[])) / sqrt(list_dot_product(cast({0} as double[]), cast({0} as double[])) * list_dot_product(cast({1} as double[]), cast({1} as double[])))"
ORACLES = {
    "r6_literal_search": f"""with d as (select doc_id, {texts.NOTE_SQL} as text from documents), q as (select doc_id as query, list_filter(list_transform({_NEEDLES}, lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda x: length(x) >= 3)[1:3] as t from d where doc_id % 100 = 0),
      k as (select distinct query, unnest(t) as token, generate_subscripts(t, 1) as place from q), f as (select query, doc_id as id, min(place) as place from k join d on contains(text, token) group by all),
      r as (select *, row_number() over (partition by query order by place, id) as rank from f) select query, id, cast(0 as double) as score from r where rank <= 10""",
    "j17_opposing_facts": f"""with f as (select o_orderkey as id, o_custkey as entity, o_orderstatus as agent, lower('Service is ' || case when o_orderkey % 3 = 0 then 'UP and running' when o_orderkey % 3 = 1 then 'down, stopped' else 'open' end) as fact from orders),
      o as (select x[1] as one, x[2] as two, row_number() over () as nth from (select unnest({_OPPOSED}) as x))
      select a.entity, a.id as a, b.id as b, arg_min(one || '/' || two, nth) as trigger from f a join f b on a.entity = b.entity and a.id < b.id and a.agent <> b.agent join o on (contains(a.fact, one) and contains(b.fact, two)) or (contains(a.fact, two) and contains(b.fact, one)) group by a.entity, a.id, b.id""",
    "j20_vector_conflicts": f"""with s as (select n.vec_id as query, o.vec_id as id, {_COS.format('n.embedding', 'o.embedding')} as score from embeddings n join embeddings o on n.label = o.label and n.vec_id % 3 <> o.vec_id % 3 where n.vec_id % 100 = 0),
      r as (select *, row_number() over (partition by query order by round(score, 6) desc, id) as rank from s) select query, id, round(score, 5) as score from r where rank <= 5 and score >= 0.2""",
    "p3_fts_row_filter": "select doc_id, source from documents where not (doc_id % 13 = 0 or doc_id % 17 = 0) and lang = 'en' and source <> 'src3'",
    "p7_batch_visibility": "with e as (select distinct user_id, cast(json_extract_string(props, '$.k') as bigint) as k from events) select user_id, string_agg(k, ',' order by k) as visible from e where k in (select doc_id from documents where doc_id % 7 <> 0) group by user_id",
    "p20_extraction_paths": "select doc_id, case doc_id % 3 when 0 then 'agents/' else 'memories/' end || source || '/a.md' as path from documents where doc_id % 3 < 2 and doc_id % 5 <> 0",
    "j5_recent_facts": """select * from (select 'recent' as kind, o_orderkey, c_name from orders join customer on o_custkey = c_custkey order by o_orderdate desc, o_orderkey limit 5)
      union all select * from (select 'pinned' as kind, o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_orderpriority = '1-URGENT' order by o_totalprice desc, o_orderkey limit 5)""",
    "j16_live_hits": "select event_id, doc_id as memory, source from events join documents on doc_id = cast(json_extract_string(props, '$.k') as bigint) where doc_id % 9 <> 0 and text is not null",
    "j28_children": "select vec_id // 10 * 10 as parent, count(*) as points, count(*) filter (where vec_id % 10 = 9) as questions, max(vec_id) as last from embeddings group by 1",
    "u2_registry_union": "select distinct l_partkey from lineitem where l_returnflag in ('A', 'R')",
    "u7_shared_relations": "select l_partkey from lineitem where l_suppkey = 1 intersect select l_partkey from lineitem where l_suppkey = 2",
    "w5_graph_agent_cap": """with i as (select o_custkey as query, o_orderkey as id, o_orderpriority as agent, count(*) over (partition by o_custkey) as n from orders), c as (select *, row_number() over (partition by query, agent order by id) as nth from i)
      select query, id, row_number() over (partition by query order by nth > greatest(1, floor(n * 0.6)), id) as place from c""",
    "w15_adaptive_widen": f"""with q as (select item_id as query, embedding as e from benchmark join embeddings on item_id = vec_id), s as (select query, vec_id as id, {_COS.format('e', 'embedding')} as score from q join embeddings on vec_id <> query),
      r as (select *, row_number() over (partition by query order by round(score, 6) desc, id) as rank from s), w as (select *, count(*) filter (where rank <= 4 and score >= 0.3) over (partition by query) as n from r where rank <= 12)
      select query, id from w where (rank <= 4 and score >= 0.3) or (rank > 4 and n < 3 and score >= 0.25)""",
    "s11_keyset_page": "select o_orderkey, o_custkey from orders where o_orderkey > 700 order by o_orderkey limit 25",
    "s14_tagged_rows": """select '{"_table":"nation","n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' as value from nation union all select '{"_table":"region","r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' from region""",
    "s19_fork": """with h as (select md5('branch' || chr(0) || doc_id) as a, case when doc_id > 3 then md5('branch' || chr(0) || (doc_id - 3)) end as b, source from documents)
      select regexp_replace(a, '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') as id, regexp_replace(b, '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') as parent, source, 'branch' as namespace from h""",
    "s21_metrics_text": """select 'events_total{type="' || event_type || '"} ' || count(*) as line from events group by event_type""",
    "m4_invalidate_facts": """select o_orderkey as fact_id, case when o_orderkey % 5 = 0 then '2024-02-01' when o_orderkey % 7 = 0 then strftime(o_orderdate, '%Y-%m-%d') end as valid_until, case when o_orderkey % 11 = 0 then o_orderkey + 1 end as superseded_by,
      lower(o_orderpriority) || case when o_orderkey % 2 = 0 or lower(o_orderstatus) = lower(o_orderpriority) then '' else ',' || lower(o_orderstatus) end as aliases from orders""",
    "m16_orphan_sweep": "with v as (select vec_id from embeddings where vec_id % 4 <> 1), c as (select distinct 'chunk' as kind, doc_id from documents union select distinct 'needle', doc_id from labels) select kind, doc_id from c where not exists (select 1 from v where vec_id = doc_id)",
    "m19_point_registry": "select vec_id as point_id, 'known' as kind from embeddings where vec_id % 3 = 0 union all select distinct doc_id, 'new' from documents where doc_id not in (select vec_id from embeddings where vec_id % 3 = 0)",
    "m20_versions": "with e as (select cast(json_extract_string(props, '$.k') as bigint) as memory_id, event_id from events where event_type in ('signup', 'purchase')) select memory_id, event_id, row_number() over w as version, lag(event_id) over w as parent from e window w as (partition by memory_id order by event_id)",
    "z2_accessible_namespaces": """select agent, n_nationkey as namespace, n_regionkey = 0 or 'a' || n_regionkey = agent as can_read, 'a' || (n_nationkey % 3) = agent as can_write from nation, (values ('a0'), ('a1'), ('a2')) t(agent)
      where n_regionkey = 0 or 'a' || n_regionkey = agent or 'a' || (n_nationkey % 3) = agent""",
    "z5_scope_versions": "with r as (select o_orderpriority as namespace, o_orderkey as version_id, row_number() over (partition by o_orderpriority order by o_orderkey) as version, count(*) over (partition by o_orderpriority) as n from orders) select namespace, version_id, version from r where version > n - 10",
    "z7_resume_gate": """with l as (select user_id, max(ts) filter (where event_type = 'purchase') as yes, max(ts) filter (where event_type = 'error') as stop from events group by user_id)
      select user_id, case when user_id % 10 = 0 then 'not_owner' when stop is not null and (yes is null or yes < stop) then 'blocked' else 'ok' end as gate from l""",
    "z8_unreflected": "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_linenumber = 1) order by o_orderdate desc, o_orderkey limit 30",
    "z11_index_tokens": "select c_mktsegment, greatest(1, (sum(length(c_name) + 3) - 1) // 4) as as_text, greatest(1, (sum(length(c_name) + 3) + 1) // 4) as as_json from customer group by c_mktsegment",
    "d7_tolerant_times": "select event_id, case when event_id % 4 < 2 then epoch_us(date_trunc('second', ts)) else epoch_us(timestamp '0001-01-01 00:00:00') end as at from events",
    "d8_valid_from": "select o_orderkey, case when o_orderkey % 4 = 0 then '2020-01-01' else strftime(o_orderdate, '%Y-%m-%d') end as valid_from from orders",
    "f18_merged_texts": """with t as (select conv_id, turn, trim(text) as a, trim(coalesce(case when turn % 4 = 0 then text || ' more' end, lead(case when turn % 3 = 0 then reverse(substr(text, 1, 20)) else text end) over (partition by conv_id order by turn), '')) as b from conversations)
      select conv_id, turn, case when a = '' then b when b = '' or lower(a) = lower(b) then a when contains(lower(b), lower(a)) then b when contains(lower(a), lower(b)) then a else a || ' | ' || b end as merged from t""",
    "t10_sessions": """with e as (select cast(user_id as varchar) as key, event_type, event_id, ts from events), f as (select key, max(ts) as flushed from e where event_type = 'purchase' group by key),
      p as (select key, max(ts) as put, arg_max(event_id, ts) as value from e where event_type not in ('purchase', 'view') group by key), u as (select key, max(ts) as used from e where event_type <> 'purchase' group by key)
      select p.key, cast(value as varchar) as value from p join u on p.key = u.key left join f on p.key = f.key where (flushed is null or put > flushed) and put > timestamp '2024-01-10' order by used desc, p.key limit 40""",
}
