"""Queries over the text functions and chunkers, with SQL written by hand from the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking, fixed, text


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents")


def f5_needles(spark, sf_dir):
    """How many needles of each kind a document has."""
    return _documents(spark, sf_dir).select("doc_id", *(F.size(found).cast("long").alias(kind) for kind, found in text.needles(F.col("text")).items()))


def f6_literal_tokens(spark, sf_dir):
    """The literal tokens of each passage as a query, and of the dates in documents' secrets lines."""
    return _documents(spark, sf_dir).select("doc_id", F.array_join(text.literal_tokens(F.col("text")), "|").alias("tokens"))


def f7_search_expressions(spark, sf_dir):
    c = F.col("text")
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", text.any_expression(c).alias("any_of"), text.all_expression(c).alias("all_of"), text.phrase_expression(c).alias("phrase"))


def f8_lexeme_expressions(spark, sf_dir):
    c = F.col("text")
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", text.any_lexemes(c).alias("any_of"), text.all_lexemes(c).alias("all_of"), text.lexemes_in_order(c).alias("phrase"))


def f10_exact_tokens(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", text.asks_exactly(F.col("text")).alias("exact"))


def f12_word_sets(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.size(text.letter_word_set(F.col("text"))).cast("long").alias("n_letter_words"), F.size(text.blank_word_set(F.col("text"))).cast("long").alias("n_blank_words"))


def _note():
    """A document as a note: its source as heading, and marked names, so that rules on headings and marks have something to find."""
    kinds = ["Decisions", "Lessons learned", "Constraints", "Observations", "Fixes", "Plain"]
    head = F.element_at(F.array(*map(F.lit, kinds)), (F.col("doc_id") % 6 + 1).cast("int"))
    marked = F.concat(F.lit("**Prod-"), F.col("source"), F.lit("** and `db.main` and `"), F.col("source"), F.lit(".yaml` on web-0"), (F.col("doc_id") % 7).cast("string"), F.lit("-eu at 10.0."), (F.col("doc_id") % 9).cast("string"), F.lit(".1, **TODO**, `DB.main`\n"))
    body = F.when(F.col("doc_id") % 4 == 0, F.lit("We decided it. Deployed, fixed; turns out it cannot. Actually fixed.\n")).otherwise(F.lit(""))
    return F.concat(F.lit("# "), head, F.lit("\n"), marked, body, F.col("text"))


NOTE_SQL = """'# ' || list_extract(['Decisions', 'Lessons learned', 'Constraints', 'Observations', 'Fixes', 'Plain'], doc_id % 6 + 1) || chr(10)
  || '**Prod-' || source || '** and `db.main` and `' || source || '.yaml` on web-0' || (doc_id % 7) || '-eu at 10.0.' || (doc_id % 9) || '.1, **TODO**, `DB.main`' || chr(10)
  || case when doc_id % 4 = 0 then 'We decided it. Deployed, fixed; turns out it cannot. Actually fixed.' || chr(10) else '' end || text"""


def notes(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", _note().alias("note"))


def f21_thought_type(spark, sf_dir):
    return notes(spark, sf_dir).select("doc_id", text.thought_type(F.col("note")).alias("thought_type"))


def f19_entities(spark, sf_dir):
    found = F.explode(text.entities(F.col("note"))).alias("e")
    return notes(spark, sf_dir).select("doc_id", found).select("doc_id", "e.name", "e.kind")


def f20_needle_entities(spark, sf_dir):
    found = F.explode(text.needle_entities(F.col("note"))).alias("e")
    return notes(spark, sf_dir).select("doc_id", found).select("doc_id", "e.name", "e.kind")


#: Texts of orders as topical notes: the tables' words are invented, so topics are told from fields that vary.
_TOPICAL = """concat_ws(' ', 'Deploy', case when o_orderkey % 3 = 0 then 'the pipeline, docker build; release' else 'a cluster node' end, case when o_orderkey % 5 = 0 then 'Kubernetes pod HPA' else '' end,
  case when o_orderkey % 7 = 0 then 'what is the status of the outage and the rollback' else 'how to run kubectl' end, o_orderpriority)"""


def _topical(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_TOPICAL).alias("note"))


def f22_topics(spark, sf_dir):
    return text.with_topics(_topical(spark, sf_dir), F.col("note")).select("o_orderkey", F.array_join("topics", ",").alias("topics"), "query_topic")


def f23_query_kind(spark, sf_dir):
    kind = text.query_kind(F.col("note"))
    return _topical(spark, sf_dir).select("o_orderkey", kind["type"].alias("type"), kind["subcategory"].alias("subcategory"))


#: Questions about orders: their dates, months and words vary.
_ASKED = """concat_ws(' ', case o_orderkey % 4 when 0 then 'When was the outage on' when 1 then 'What is the latest status, before' when 2 then 'the history of' else 'anything' end,
  case o_orderkey % 3 when 0 then substr(cast(o_orderdate as string), 1, 10) when 1 then substr(cast(o_orderdate as string), 1, 7) else 'March 2024' end, case when o_orderkey % 5 = 0 then 'right now, last week' else '' end)"""


def d4_temporal_intent(spark, sf_dir):
    asked = _table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_ASKED).alias("asked"))
    return asked.select("o_orderkey", text.temporal_intent(F.col("asked")).alias("intent"))


def f33_paths_and_fences(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/data/memories/"), F.col("lang"), F.lit("/agents/"), F.col("source"), F.lit("/a.md"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("memories/"), F.col("source"))).otherwise(F.lit("notes/a.md"))
    fenced = F.concat(F.lit(" ```json\n"), F.col("text"), F.lit("\n``` "))
    return docs.select("doc_id", text.agent_of_path(path).alias("agent"), text.without_fences(F.when(F.col("doc_id") % 2 == 0, fenced).otherwise(F.col("text"))).alias("body"))


def f38_safe_labels(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", text.safe_label(F.concat_ws("/", "c_name", "c_mktsegment")).alias("label"))


def p11_safe_provenance(spark, sf_dir):
    entries = F.create_map(F.lit("source"), F.col("source"), F.lit("agent_id"), F.col("lang"), F.lit("api_token"), F.lit("x"), F.lit("unknown"), F.lit("y"), F.lit("date"), F.when(F.col("doc_id") % 2 == 0, F.lit("2024-01-01")))
    shown = text.safe_provenance(entries)
    return _documents(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(F.transform(F.map_entries(shown), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("shown"))


def _by_document(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("id").cast("long").alias("doc_id"), *[c for c in chunks.columns if c != "id"])


def _paragraphed(spark, sf_dir):
    return _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("text"))


def f1_chunk_text(spark, sf_dir):
    return _by_document(chunking.paragraph_chunks(_paragraphed(spark, sf_dir)))


def f2_section_chunks(spark, sf_dir):
    docs = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.concat_ws("\n\n", _note(), F.lit("## More"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))).alias("text"))
    return _by_document(chunking.section_chunks(docs))


def f3_level_chunks(spark, sf_dir):
    return chunking.level_chunks(_paragraphed(spark, sf_dir).withColumn("id", F.concat(F.lit("notes/"), F.col("id"))))


QUERIES = {f.__name__: f for f in (d4_temporal_intent, f1_chunk_text, f2_section_chunks, f3_level_chunks, f5_needles, f6_literal_tokens, f7_search_expressions, f8_lexeme_expressions, f10_exact_tokens, f12_word_sets, f19_entities, f20_needle_entities, f21_thought_type, f22_topics, f23_query_kind, f33_paths_and_fences, f38_safe_labels, p11_safe_provenance)}

_PORT = r"(?m)(?:^|\s):\d{2,5}\b"
_COUNTED = {k: (_PORT if k == "port" else v) for k, v in fixed.NEEDLES.items()}
_STOPS = ", ".join(f"'{w}'" for w in fixed.SEARCH_STOP_WORDS)
_EDGES = fixed.TOKEN_EDGES.replace("'", "''")
_PARTS = f"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[\\x09-\\x0D\\x1C-\\x20]+'), lambda x: trim(x, '{_EDGES}')), lambda x: x <> '')"
_CONTENT = f"list_filter(list_transform(raw, lambda x: lower(x)), lambda x: length(x) >= 2 and not list_contains([{_STOPS}], x))"


def _least(alias: str, parts: list[tuple[str, str]]) -> str:
    """The label of the first largest count of (label, SQL of the count)."""
    return f"case greatest({', '.join(n for _, n in parts)}) when 0 then '' " + " ".join(f"when {n} then '{label}'" for label, n in parts) + f" end as {alias}"


def _hits(column: str, words) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({column}, '(?i)\\b{w}\\b'))" for w in words) + ")"


_THOUGHTS = [
    (kind, f"(3 * len(list_filter(heads, lambda h: list_contains([{', '.join(repr(w) for w in fixed.THOUGHT_HEADS[kind])}], h))) + len(regexp_extract_all(note, '{pattern}')))")
    for kind, pattern in fixed.THOUGHT_BODIES.items()
]
_TOPIC_HITS = [(topic, _hits("note", words)) for topic, words in fixed.TOPICS.items()]
_KIND_HITS = [(kind, sub, f"len(regexp_extract_all(note, '(?i)\\b(?:{words})\\b'))") for kind, sub, words in fixed.QUERY_KINDS]
_KINDS = [(kind, "(" + " + ".join(n for k, _, n in _KIND_HITS if k == kind) + ")") for kind in ("experience", "skill", "general")]

_POINTS = lambda patterns, n: " + ".join(f"case when regexp_matches(asked, '{p}') then {n} else 0 end" for p in patterns)
_SAID = lambda words: " + ".join(f"case when contains(lower(asked), '{w}') then 1 else 0 end" for w in words)
ORACLES = {
    "d4_temporal_intent": f"""with q as (select o_orderkey, {_ASKED.replace('as string', 'as varchar')} as asked from orders), s as (select o_orderkey, case when regexp_matches(asked, '{fixed.ISO_DATE}') then 3 when regexp_matches(asked, '{fixed.YEAR}') then 1 else 0 end
      + {_POINTS([fixed.MONTH_YEAR, *fixed.HISTORICAL_PATTERNS], 2)} + {_SAID(fixed.HISTORICAL_WORDS)} as h, {_POINTS(fixed.RECENCY_PATTERNS, 2)} + {_SAID(fixed.RECENCY_WORDS)} as r from q)
      select o_orderkey, case when h >= 3 and h > r then 'historical' when r >= 2 and r > h then 'recency' else 'neutral' end as intent from s""",
    "f5_needles": f"select doc_id, {', '.join(f'''cast(len(regexp_extract_all(text, '{p}')) as bigint) as {k}''' for k, p in _COUNTED.items())} from documents",
    "f6_literal_tokens": f"select doc_id, array_to_string(list_filter(list_transform(list_concat({', '.join(f'''regexp_extract_all(text, '{p}')''' for p in _COUNTED.values())}), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31))), lambda x: length(x) >= 3), '|') as tokens from documents",
    "f7_search_expressions": f"""with t as (select conv_id, turn, {_PARTS} as raw from conversations), c as (select *, {_CONTENT} as content from t)
      select conv_id, turn, case when len(raw) > 0 then '"' || array_to_string(raw, '" OR "') || '"' else '' end as any_of,
      case when len(content) >= 2 then '"' || array_to_string(content, '" AND "') || '"' else '' end as all_of, case when len(content) >= 2 then '"' || array_to_string(content, ' ') || '"' else '' end as phrase from c""",
    "f8_lexeme_expressions": f"""with t as (select conv_id, turn, list_filter(list_transform({_PARTS}, lambda x: replace(x, '''', '')), lambda x: x <> '') as raw from conversations), c as (select *, {_CONTENT} as content from t)
      select conv_id, turn, case when len(raw) > 0 then '''' || array_to_string(raw, ''' | ''') || '''' else '' end as any_of,
      case when len(content) >= 2 then '''' || array_to_string(content, ''' & ''') || '''' else '' end as all_of, case when len(content) >= 2 then '''' || array_to_string(content, ''' <-> ''') || '''' else '' end as phrase from c""",
    "f10_exact_tokens": f"select doc_id, regexp_matches(text, '{fixed.EXACT_TOKEN}') as exact from documents",
    "f12_word_sets": """select doc_id, cast(len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) > 2))) as bigint) as n_letter_words,
      cast(len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[\\x09-\\x0D\\x1C-\\x20]+'), lambda x: length(x) >= 2))) as bigint) as n_blank_words from documents""",
    "f19_entities": f"""with n as (select doc_id, {NOTE_SQL} as note from documents), m as (select doc_id, list_concat(regexp_extract_all(note, '{fixed.BOLD_ENTITY}', 1), regexp_extract_all(note, '{fixed.TICKED_ENTITY}', 1)) as found from n),
      e as (select doc_id, unnest(found) as name, generate_subscripts(found, 1) as place from m), f as (select *, row_number() over (partition by doc_id, lower(name) order by place) as again from e where lower(name) not in ({', '.join(f"'{w}'" for w in fixed.NO_ENTITIES)})),
      k as (select *, row_number() over (partition by doc_id order by place) as rank from f where again = 1)
      select doc_id, name, case {' '.join(f"when regexp_matches(name, '{p}') then '{kind}'" for kind, p in fixed.ENTITY_HINTS)} else 'unknown' end as kind from k where rank <= 30""",
    "f20_needle_entities": f"""with n as (select doc_id, {NOTE_SQL} as note from documents), e as (select doc_id, 'ip_address' as kind, 1 as rank, unnest(regexp_extract_all(note, '{fixed.NEEDLES["ip"]}')) as name from n
      union all select doc_id, 'uuid', 2, unnest(regexp_extract_all(note, '{fixed.NEEDLES["uuid"]}')) from n union all select doc_id, 'ticket_id', 3, unnest(regexp_extract_all(note, '{fixed.NEEDLES["ticket"]}')) from n
      union all select doc_id, 'hostname', 4, unnest(list_filter(regexp_extract_all(note, '{fixed.HOST}'), lambda x: regexp_matches(x, '[0-9]'))) from n)
      select doc_id, name, arg_min(kind, rank) as kind from e where length(name) >= 3 group by doc_id, name""",
    "f21_thought_type": f"""with n as (select doc_id, {NOTE_SQL} as note from documents), h as (select *, list_filter(regexp_split_to_array(lower(array_to_string(regexp_extract_all(note, '{fixed.HEADING}', 1), ' ')), '\\s+'), lambda x: x <> '') as heads from n)
      select doc_id, case when greatest({', '.join(n for _, n in _THOUGHTS)}) < 2 then 'general' else {_least('t', _THOUGHTS).removesuffix(' as t')} end as thought_type from h""",
    "f22_topics": f"""with n as (select o_orderkey, {_TOPICAL} as note from orders), v as (select o_orderkey, unnest([{', '.join(f"{{'label': '{t}', 'n': {n}, 'place': {k}}}" for k, (t, n) in enumerate(_TOPIC_HITS))}], recursive := true) from n),
      r as (select *, row_number() over (partition by o_orderkey order by n desc, place) as rank from v) select o_orderkey, coalesce(string_agg(label, ',' order by rank) filter (where n >= 2 and rank <= 2), '') as topics, coalesce(max(label) filter (where rank = 1 and n > 0), '') as query_topic from r group by o_orderkey""",
    "f23_query_kind": f"""with n as (select o_orderkey, {_TOPICAL} as note from orders), b as (select o_orderkey, {_least('type', _KINDS)}, {_least('sub', [(s, n) for _, s, n in _KIND_HITS])} from n)
      select o_orderkey, type, case when (type, sub) in ({', '.join(f"('{k}', '{s}')" for k, s, _ in fixed.QUERY_KINDS)}) then sub else '' end as subcategory from b""",
    "f33_paths_and_fences": """select doc_id, case when doc_id % 3 < 2 then source else '' end as agent, case when doc_id % 2 = 0 then trim(regexp_replace(text, '^\\s+$', ''), ' ' || chr(10)) else trim(text, ' ' || chr(10)) end as body from documents""",
    "f38_safe_labels": "select c_custkey, substr(regexp_replace(c_name || '/' || c_mktsegment, '[^A-Za-z0-9_-]', '_', 'g'), 1, 48) as label from customer",
    "p11_safe_provenance": """select doc_id, array_to_string(list_filter(['agent_id=' || nullif(lang, ''), case when doc_id % 2 = 0 then 'date=2024-01-01' end, 'source=' || nullif(source, '')], lambda x: x is not null), ',') as shown from documents""",
}
