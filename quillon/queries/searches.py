"""Queries over the full-text index, with SQL that reads every text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions import fixed
from ..functions.stemming import STEP2, STEP3, STEP4
from ..operators import fulltext, ordered, ranking, vectors
from ..plans import retrieval
from ..plans.dialect import duck_text


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Indexes of this application by its id and the folder: built once, read by all queries.
_BUILT: dict[tuple[str, str], fulltext.Index] = {}


def _index(spark: SparkSession, sf_dir: str) -> fulltext.Index:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        _BUILT[key] = _built(spark, sf_dir)
    return _BUILT[key]


def _built(spark: SparkSession, sf_dir: str) -> fulltext.Index:
    """All documents; then the Spanish ones again with a note, the shortest deleted, long German ones excluded."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("namespace"), (F.length("source") / 10).alias("importance"), "lang", "n_chars")
    index = fulltext.Index(spark, scratch.folder(spark, "fulltext"))
    index.upsert(docs)
    index.upsert(docs.where("lang = 'es'").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" Revised editions of "), F.coalesce("namespace", F.lit("")))))
    index.delete(docs.where("n_chars < 60"))
    index.exclude(docs.where("lang = 'de' and n_chars > 5000"))
    return index


def _items(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")


def _sentences(spark, sf_dir):
    """Each sentence of the items as a query."""
    said = _table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"[.\n]")).alias("place", "text"))
    return said.select((F.col("item_id") * 1000 + F.col("place")).alias("query"), "text")


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("query", "id", F.round("score", 5).alias("score"), "rank")


def r3_stemmed_search(spark, sf_dir):
    return _shown(_index(spark, sf_dir).search(_items(spark, sf_dir), 10))


def r3_exact_search(spark, sf_dir):
    return _shown(_index(spark, sf_dir).search(_items(spark, sf_dir), 10, exact=True, where=F.col("lang") == "en"))


def r4_cover_density(spark, sf_dir):
    return _shown(_index(spark, sf_dir).search(_sentences(spark, sf_dir), 10, "all", by="density"))


def r4_phrases(spark, sf_dir):
    return _shown(_index(spark, sf_dir).search(_sentences(spark, sf_dir), 10, "phrase"))


def r2_dual_search(spark, sf_dir):
    return _shown(_index(spark, sf_dir).dual(_items(spark, sf_dir), 10))


def index_vocabulary(spark, sf_dir):
    """Terms that stand in the index after its changes: their stems, chunks and places."""
    return _index(spark, sf_dir).vocabulary()


_V, _C = "[aeiouy][aeiou]*", "[^aeiou][^aeiouy]*"
_M0 = f"^({_C}{_V}|[aeiou]+){_C}"  # y is no vowel at the start
_M1, _ONE, _VOWEL = f"{_M0}{_V}{_C}", f"{_M0}({_V})?$", f"^({_C}[aeiouy]|[aeiou])"
_ANY_SHORT = "(([^aeiouy]|(^|[aeiou])y)[aeiou]|[^aeiouy]y)[^aeiouwxy]$"


def _cases(table, least: str) -> str:
    """A step's suffixes, longest first."""
    rows = sorted(table, key=lambda x: -len(x[0]))
    need = lambda s: f"regexp_matches(w[:length(w) - {len(s)}], '{least}')" + (" and regexp_matches(w, '[st]ion$')" if s == "ion" else "")
    return "case " + " ".join(f"when ends_with(w, '{s}') then case when {need(s)} then w[:length(w) - {len(s)}] || '{r}' else w end" for s, r in rows) + " else w end"


#: Porter's steps as expressions over a word w, one after another.
_STEPS = (
    "case when ends_with(w, 'sses') or ends_with(w, 'ies') then w[:length(w) - 2] when ends_with(w, 's') and not ends_with(w, 'ss') then w[:length(w) - 1] else w end",
    f"case when ends_with(w, 'eed') then case when regexp_matches(w[:length(w) - 3], '{_M0}') then w[:length(w) - 1] else w end when ends_with(w, 'ed') and regexp_matches(w[:length(w) - 2], '{_VOWEL}') then w[:length(w) - 2] || '!'"
    f" when ends_with(w, 'ing') and regexp_matches(w[:length(w) - 3], '{_VOWEL}') then w[:length(w) - 3] || '!' else w end",
    "case when not ends_with(w, '!') then w when regexp_matches(w, '(at|bl|iz)!$') then w[:length(w) - 1] || 'e' when length(w) > 2 and w[-2] = w[-3] and regexp_matches(w[-2], '[^aeioulsz]') and (w[-2] <> 'y') then w[:length(w) - 2]"
    f" when regexp_matches(w[:length(w) - 1], '{_ONE}') and regexp_matches(w[:length(w) - 1], '{_ANY_SHORT}') then w[:length(w) - 1] || 'e' else w[:length(w) - 1] end",
    f"case when ends_with(w, 'y') and regexp_matches(w[:length(w) - 1], '{_VOWEL}') then w[:length(w) - 1] || 'i' else w end",
    _cases(STEP2, _M0),
    _cases(STEP3, _M0),
    _cases([(s, "") for s in STEP4], _M1),
    f"case when ends_with(w, 'e') and (regexp_matches(w[:length(w) - 1], '{_M1}') or regexp_matches(w[:length(w) - 1], '{_ONE}') and not regexp_matches(w[:length(w) - 1], '{_ANY_SHORT}')) then w[:length(w) - 1] else w end",
    f"case when ends_with(w, 'll') and regexp_matches(w[:length(w) - 1], '{_M1}') then w[:length(w) - 1] else w end",
)


def _stem_of(terms: str) -> str:
    """CTEs that end in stems(term, stem) of a table's distinct terms."""
    steps = [f"p0 as (select distinct term, term as w from {terms})"]
    steps += [f"p{k} as (select term, case when length(term) < 3 or length(term) > 64 then term else {e} end as w from p{k - 1})" for k, e in enumerate(_STEPS, 1)]
    return ", ".join(steps) + f", stems as (select term, w as stem from p{len(_STEPS)})"


_WORDS = "list_filter(string_split_regex(lower(x), '[^a-z0-9]+'), lambda y: y <> '')"
_STOPS = ", ".join(f"'{w}'" for w in fixed.SEARCH_STOP_WORDS)
_EDGES = fixed.TOKEN_EDGES.replace("'", "''")
#: What stands after the changes: chunk(id, text, excluded, importance, lang), its words with their places, and how many.
_CHUNKS = r"""chunk as (select doc_id as id, case when lang = 'es' then coalesce(text, '') || ' Revised editions of ' || coalesce(source, '') else coalesce(text, '') end as x, coalesce(lang = 'de' and n_chars > 5000, false) as excluded, length(source) / 10 as importance, lang
  from documents where not coalesce(n_chars < 60, false)), listed as (select *, {words} as ws from chunk), sized as (select id, excluded, importance, lang, len(ws) as size from listed), total as (select count(*) as n, avg(size) as mean from sized where size > 0),
  word as (select id, unnest(ws) as term, unnest(range(len(ws))) as spot from listed)""".format(words=_WORDS)
#: Queries' search tokens, cleaned.
_ASKED = rf"""cleaned as (select query, list_filter(list_transform(list_filter(string_split_regex(x, '[\x09-\x0D\x1C-\x20]+'), lambda t: t <> ''), lambda t: trim(t, '{_EDGES}')), lambda t: t <> '') as ts from asked),
  content as (select query, list_filter(list_transform(ts, lambda t: lower(t)), lambda t: length(t) >= 2 and t not in ({_STOPS})) as ts from cleaned)"""
_BY_ITEM = "asked as (select item_id as query, text as x from benchmark)"
_BY_SENTENCE = r"asked as (select item_id * 1000 + unnest(range(len(s))) as query, unnest(s) as x from (select item_id, string_split_regex(text, '[.\n]') as s from benchmark))"
_PARTS = {
    "any": f"part as (select distinct query, p from (select query, {_WORDS} as p from (select query, unnest(ts) as x from cleaned)) where len(p) > 0)",
    "all": f"part as (select distinct query, p from (select query, {_WORDS} as p from (select query, unnest(ts) as x from content where len(ts) >= 2)) where len(p) > 0)",
    "phrase": f"part as (select query, p from (select query, {_WORDS.replace('lower(x)', 'lower(array_to_string(ts, chr(32)))')} as p from content where len(ts) >= 2) where len(p) > 0)",
}


def _found(exact: bool, parts: str = "part", name: str = "found") -> str:
    """name(p, id, spot): places where a part's words follow each other."""
    form = "term" if exact else "stem"
    words = "word" if exact else "(select id, spot, stem from word join stems using (term))"
    asked = f"(select p, k, term from (select p, unnest(p) as term, unnest(range(len(p))) as k from (select distinct p from {parts})))"
    spoken = asked if exact else f"(select p, k, stem from {asked} join stems using (term))"
    return f"{name} as (select p, id, spot - k as spot from (select distinct p, k, id, spot from {spoken} join {words} using ({form})) group by p, id, spot - k having count(*) = len(p))"


def _scored(name: str, found: str, parts: str, mode: str, condition: str = "true") -> str:
    """name(query, id, score, lifted): BM25 over parts."""
    few = f"having count(*) = (select count(*) from {parts} z where z.query = y.query)" if mode == "all" else ""
    return f"""{name}_n as (select p, id, count(*) as tf from {found} group by p, id), {name}_d as (select p, count(*) as df from {name}_n group by p),
      {name} as (select y.query, x.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) as score, score * (1 + 0.3 * any_value(coalesce(importance, 0.5))) as lifted
        from {parts} y join {name}_n x on x.p = y.p join {name}_d d on d.p = x.p join sized s on s.id = x.id, total where not excluded and {condition} group by y.query, x.id {few})"""


def _ranked(name: str, k: int, score: str = "score") -> str:
    return f"select query, id, round(score, 5) as score, rank from (select query, id, {score} as score, row_number() over (partition by query order by round(lifted, 6) desc, id) as rank from {name}) where rank <= {k}"


_TERMS = "terms as (select term from word union select unnest(regexp_extract_all(lower(x), '[a-z0-9]+')) from asked)"


def _search(asked: str, mode: str, exact: bool, condition: str = "true") -> str:
    stems = "" if exact else f"{_TERMS}, {_stem_of('terms')}, "
    return f"with {_CHUNKS}, {asked}, {_ASKED}, {_PARTS[mode]}, {stems}{_found(exact)}, {_scored('hit', 'found', 'part', mode, condition)} {_ranked('hit', 10)}"


#: Covers by definition: for each end the least of the parts' last places up to it, and of the ends with one such place the first.
_DENSITY = f"""with {_CHUNKS}, {_BY_SENTENCE}, {_ASKED}, {_PARTS["all"]}, {_TERMS}, {_stem_of("terms")}, {_found(False)},
  place as (select query, id, p, spot, spot + len(p) - 1 as ends from part join found using (p)), whole as (select query, id from place group by query, id having count(distinct p) = (select count(*) from part z where z.query = place.query)),
  held as (select place.* from place join whole using (query, id)), last as (select e.query, e.id, e.ends, b.p, max(b.spot) as spot from (select distinct query, id, ends from held) e join held b on b.query = e.query and b.id = e.id and b.ends <= e.ends group by all),
  least as (select query, id, ends, min(spot) as begins from last group by query, id, ends having count(*) = (select count(*) from part z where z.query = last.query)), cover as (select query, id, begins, min(ends) as ends from least group by query, id, begins),
  inside as (select c.query, c.id, c.begins, c.ends, sum(h.ends - h.spot + 1) as words from cover c join held h on h.query = c.query and h.id = c.id and h.spot >= c.begins and h.ends <= c.ends group by all),
  hit as (select query, id, 32 * sum(0.1 / (1 + greatest(0, ends - begins + 1 - words))) as score, score * (1 + 0.3 * any_value(coalesce(importance, 0.5))) as lifted from inside join sized using (id) where not excluded group by query, id)
  {_ranked("hit", 10)}"""
_EXACT = fixed.EXACT_TOKEN.replace("'", "''")
_DUAL = f"""with {_CHUNKS}, {_BY_ITEM}, {_ASKED}, {_PARTS["any"]}, {_PARTS["all"].replace("part as", "strict as")}, {_PARTS["phrase"].replace("part as", "phrase as")}, {_TERMS}, {_stem_of("terms")},
  {_found(False)}, {_found(False, "strict", "of_strict")}, {_found(False, "phrase", "of_phrase")}, {_found(True, "part", "literal")},
  {_scored("a", "found", "part", "any")}, {_scored("b", "of_strict", "strict", "all")}, {_scored("c", "of_phrase", "phrase", "phrase")}, {_scored("e", "literal", "part", "any")},
  lists as ({" union all ".join(f"select '{x}' as list, * from ({_ranked(x, 10)})" for x in "abce")}), many as (select query from a group by query having count(*) >= 200),
  run as (select * from lists where list = 'a' or (list in ('b', 'c') and query in (select query from many)) or (list = 'e' and query in (select query from asked where regexp_matches(x, '{_EXACT}')))),
  hit as (select query, id, sum(1 / (20 + rank)) as score, sum(1 / (20 + rank)) as lifted from run group by query, id) {_ranked("hit", 10)}"""

QUERIES = {f.__name__: f for f in (r3_stemmed_search, r3_exact_search, r4_cover_density, r4_phrases, r2_dual_search, index_vocabulary)}
ORACLES = {
    "r3_stemmed_search": _search(_BY_ITEM, "any", False),
    "r3_exact_search": _search(_BY_ITEM, "any", True, "lang = 'en'"),
    "r4_cover_density": _DENSITY,
    "r4_phrases": _search(_BY_SENTENCE, "phrase", False),
    "r2_dual_search": _DUAL,
    "index_vocabulary": f"with {_CHUNKS}, {_stem_of('word')} select term, stem, count(distinct id) as chunks, count(*) as places from word join stems using (term) group by term, stem",
}


#: The search path over documents with vectors: agents are sources, ages and importances fields that vary; budget of a context in tokens.
BUDGET, SHOWN = 2_000, 20


def r12_search(spark, sf_dir):
    """The whole path (R12, R13, R20): both rankings fused, aged, lifted, cut, rescued, capped, and packed into the budget in order of place."""
    docs = _table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").alias("id"), "text", F.coalesce("source", F.lit("")).alias("agent"), (F.col("n_chars") % 45).cast("double").alias("age_days"), (F.col("n_chars") % 11 / 10).alias("importance"))
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = _items(spark, sf_dir).join(vectors.withColumnRenamed("id", "query"), "query", "left").withColumn("own", F.col("query"))
    hits = ranking.search(chunks, vectors, asked, SHOWN).join(docs.select(F.col("doc_id").alias("id"), F.greatest(F.lit(1), F.floor(F.length("text") / 4)).alias("tokens")), "id")
    packed = ordered.pack_greedy(hits.select("query", F.col("place").alias("rank"), "id", "tokens"), BUDGET)
    return hits.join(packed.select("query", "id", "packed"), ["query", "id"]).select("query", "id", F.round("score", 5).alias("score"), "place", "rescued", "packed")


_BOTH = duck_text(f"{retrieval.BM25}, {retrieval.COSINE}")
_SEARCH_PATH = f"""with recursive {_BOTH}, lex as (select item_id, doc_id, score, rn from lexical where rn <= 64),
  near as (select item_id, doc_id, score, row_number() over (partition by item_id order by round(score, 6) desc, doc_id) as rn from cos where doc_id in (select doc_id from documents)), vec as (select * from near where rn <= 64),
  every as (select item_id, doc_id, rn from lex union all select item_id, doc_id, rn from vec), r as (select item_id, doc_id, sum(cast(1 as double) / (20 + rn)) as rrf from every group by all),
  k as (select r.item_id, count(vec.doc_id) as nv, count(lex.doc_id) as nl from r left join vec on vec.item_id = r.item_id and vec.doc_id = r.doc_id left join lex on lex.item_id = r.item_id and lex.doc_id = r.doc_id group by r.item_id),
  f as (select r.item_id, r.doc_id, case when nl = 0 then v.score when nv = 0 then l.score * 0.3 when v.rn <= 8 then greatest(rrf, v.score + 0.5) else rrf end as score
    from r join k using (item_id) left join vec v on v.item_id = r.item_id and v.doc_id = r.doc_id left join lex l on l.item_id = r.item_id and l.doc_id = r.doc_id),
  fused as (select *, row_number() over (partition by item_id order by round(score, 6) desc, doc_id) as rn from f),
  aged as (select item_id, doc_id, coalesce(source, '') as agent, score * exp(-ln(2.0) * (n_chars % 45) / 30) * (1 + 0.3 * (n_chars % 11 / 10 - 0.5)) as score from fused join documents using (doc_id) where rn <= 64),
  ranked as (select *, row_number() over (partition by item_id order by round(score, 6) desc, doc_id) as rn from aged),
  s as (select item_id, count(*) as n, max(score) as top, median(score) as med, stddev_samp(score) as sd from ranked group by item_id),
  t as (select item_id, case when n < 4 then least(0.4, top * 0.55) else least(0.4, greatest(0.25, top * 0.55, case when sd = 0 then med * 0.5 else med - 1.5 * sd end)) end as threshold from s),
  kept as (select ranked.*, threshold from ranked join t using (item_id) where score >= threshold or rn <= 3),
  good as (select lex.item_id, lex.doc_id, row_number() over (partition by lex.item_id order by round(lex.score, 6) desc, lex.doc_id) as nth from lex where lex.score >= 0.6 * (select max(score) from lex x where x.item_id = lex.item_id)
    and not exists (select 1 from kept where kept.item_id = lex.item_id and kept.doc_id = lex.doc_id)),
  merged as (select item_id, doc_id, score, false as rescued from kept union all select item_id, doc_id, threshold, true from good join t using (item_id) where nth <= 3),
  placed as (select item_id, doc_id, score, rescued, coalesce(source, '') as agent, greatest(1, length(text) // 4) as tokens, row_number() over (partition by item_id order by round(score, 6) desc, doc_id) as rn from merged join documents using (doc_id)),
  c as (select *, row_number() over (partition by item_id, agent order by rn) as of_agent, greatest(1, floor(count(*) over (partition by item_id) * 0.6)) as cap from placed),
  o as (select *, row_number() over (partition by item_id order by case when of_agent > cap then 1 else 0 end, rn) as place from c),
  walk as (select item_id, cast(0 as bigint) as place, cast(0 as bigint) as used, cast(0 as bigint) as n, false as packed from (select distinct item_id from o)
    union all select w.item_id, o.place, case when used + tokens <= {BUDGET} or n < 3 then used + tokens else used end, case when used + tokens <= {BUDGET} or n < 3 then n + 1 else n + 1 end, used + tokens <= {BUDGET} or n < 3
    from walk w join o on o.item_id = w.item_id and o.place = w.place + 1 where o.place <= {SHOWN})
  select o.item_id as query, doc_id as id, round(score, 5) as score, o.place, rescued, packed from o join walk w on w.item_id = o.item_id and w.place = o.place"""
QUERIES["r12_search"] = r12_search


def r1_vector_index(spark, sf_dir):
    """The ten nearest of every row whose id is divisible by 100, by the lists of an index over all rows. Approximate, so without SQL; the tests measure recall."""
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index = vectors.VectorIndex.build(rows, scratch.folder(spark, "vectors"))
    return _shown(index.search(rows.where("id % 100 = 0").select(F.col("id").alias("query"), "vector", F.col("id").alias("own")), 10))


QUERIES["r1_vector_index"] = r1_vector_index
ORACLES["r12_search"] = _SEARCH_PATH
