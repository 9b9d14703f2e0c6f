"""Text rules as columns, JVM-side: needles, search expressions, word sets, votes, entities, paths.

A null text gives empty arrays, zero counts and "general" or empty labels.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed

#: White space as the rules' own language has it, for ASCII texts.
BLANK = r"[\x09-\x0D\x1C-\x20]"


def _some(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def _strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_some(text), F.lit(pattern), F.lit(group))


def blank_parts(text: Column) -> Column:
    """What stands between runs of white space."""
    return F.filter(F.split(_some(text), f"{BLANK}+"), lambda x: x != "")


def needles(text: Column) -> dict[str, Column]:
    """Matches of each needle pattern, by kind."""
    return {kind: matches(text, pattern) for kind, pattern in fixed.NEEDLES.items()}


def literal_tokens(text: Column, least: int = 3) -> Column:
    """Needles of a query, by kind and then by place, stripped, those of `least` characters or more."""
    found = F.concat(*needles(text).values())
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, f"^{BLANK}+|{BLANK}+$", "")), lambda x: F.char_length(x) >= least)


def asks_exactly(text: Column) -> Column:
    """Whether a text holds an exact token."""
    return _some(text).rlike(fixed.EXACT_TOKEN)


def clean_token(token: Column) -> Column:
    """A token without brackets, quotes and marks at its ends."""
    return F.btrim(token, F.lit(fixed.TOKEN_EDGES))


def search_tokens(text: Column) -> Column:
    return F.filter(F.transform(blank_parts(text), clean_token), lambda x: x != "")


def content_tokens(text: Column) -> Column:
    """Lower-cased tokens of two characters or more that are no stop words."""
    return F.filter(F.transform(search_tokens(text), F.lower), lambda x: (F.char_length(x) >= 2) & ~F.array_contains(_strings(*fixed.SEARCH_STOP_WORDS), x))


def _joined(tokens: Column, least: int, mark: str, between: str, around: str = "") -> Column:
    quoted = F.array_join(F.transform(tokens, lambda x: F.concat(F.lit(mark), x, F.lit(mark))), between)
    return F.when(F.size(tokens) >= least, F.concat(F.lit(around), quoted, F.lit(around))).otherwise(F.lit(""))


def any_expression(text: Column) -> Column:
    return _joined(search_tokens(text), 1, '"', " OR ")


def all_expression(text: Column) -> Column:
    return _joined(content_tokens(text), 2, '"', " AND ")


def phrase_expression(text: Column) -> Column:
    return _joined(content_tokens(text), 2, "", " ", '"')


def _lexemes(text: Column) -> Column:
    return F.filter(F.transform(search_tokens(text), lambda x: F.replace(x, F.lit("'"), F.lit(""))), lambda x: x != "")


def _content_lexemes(text: Column) -> Column:
    return F.filter(F.transform(_lexemes(text), F.lower), lambda x: (F.char_length(x) >= 2) & ~F.array_contains(_strings(*fixed.SEARCH_STOP_WORDS), x))


def any_lexemes(text: Column) -> Column:
    return _joined(_lexemes(text), 1, "'", " | ")


def all_lexemes(text: Column) -> Column:
    return _joined(_content_lexemes(text), 2, "'", " & ")


def lexemes_in_order(text: Column) -> Column:
    return _joined(_content_lexemes(text), 2, "'", " <-> ")


def blank_word_set(text: Column) -> Column:
    """Distinct lower-cased words between white space, of two characters or more (F12, of facts)."""
    return F.array_distinct(F.filter(blank_parts(F.lower(text)), lambda x: F.char_length(x) >= 2))


def letter_word_set(text: Column) -> Column:
    """Distinct lower-cased runs of letters, digits and underscores, of three characters or more (F12, of conflicts)."""
    return F.array_distinct(F.filter(matches(F.lower(text), "[a-z0-9_]+"), lambda x: F.char_length(x) > 2))


def tip_tokens(text: Column) -> Column:
    """Lower-cased runs of two or more letters, digits and underscores, repeats included, that tell something of a task."""
    return F.filter(matches(F.lower(_some(text)), "[a-z0-9_]{2,}"), lambda x: ~F.array_contains(_strings(*fixed.TIP_STOP_WORDS), x))


def task_fingerprint(text: Column) -> Column:
    """The same for tasks that differ in case and white space only."""
    return F.substring(F.sha2(F.array_join(blank_parts(F.lower(_some(text))), " "), 256), 1, 16)


def headings(text: Column) -> Column:
    return F.transform(matches(text, fixed.HEADING, 1), lambda x: F.regexp_replace(x, f"^{BLANK}+|{BLANK}+$", ""))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(_some(text), F.lit(pattern))


def votes(counted: list[tuple[str, Column]]) -> Column:
    """Labels with votes, most votes first, and in the given order among equals."""
    every = F.array(*[F.struct((-n).cast("long").alias("less"), F.lit(k).alias("place"), F.lit(label).alias("label")) for k, (label, n) in enumerate(counted)])
    return F.array_sort(F.filter(every, lambda x: x["less"] < 0))


def _among(words: Column, known) -> Column:
    return F.filter(words, lambda w: F.array_contains(_strings(*known), w))


def thought_type(text: Column, least: int = 2) -> Column:
    """The type with most votes of headings and body, or "general" under `least` votes (F21). Headings vote first among equals."""
    heads = F.flatten(F.transform(headings(text), lambda x: blank_parts(F.lower(x))))
    every = []
    for kind, pattern in fixed.THOUGHT_BODIES.items():
        every.append((kind, 3 * F.size(_among(heads, fixed.THOUGHT_HEADS[kind])) + _count(text, pattern)))
    first = F.get(votes(every), F.lit(0))
    return F.when(first["less"] <= -least, first["label"]).otherwise(F.lit("general"))


def _apart(words: tuple[str, ...]) -> list[list[str]]:
    """Words in lists in each of which no two can meet in a text, so that one search for any of them finds all matches of each. Matches of words that begin
    and end with a letter, digit or underscore only meet where they share a whole run of these."""
    lists: list[tuple[set[str], list[str]]] = []
    for word in words:
        runs = re.findall(r"\w+", word.lower(), flags=re.ASCII)
        alone = not re.fullmatch(r"\w(.*\w)?", word, flags=re.ASCII | re.DOTALL) or len(set(runs)) < len(runs)
        for held, of in [] if alone else lists:
            if held and held.isdisjoint(runs):
                held.update(runs)
                of.append(word)
                break
        else:
            lists.append((set() if alone else set(runs), [word]))
    return [of for _, of in lists]


def _topic_votes(text: Column, topics: dict[str, tuple[str, ...]]) -> Column:
    escaped = lambda w: re.sub(r"([^\w])", r"\\\1", w, flags=re.ASCII)
    counted = lambda words: _count(text, rf"(?i)\b(?:{'|'.join(map(escaped, words))})\b")
    return votes([(topic, sum(map(counted, _apart(words)), F.lit(0))) for topic, words in topics.items()])


def _first_topics(votes: Column, most: int, least: int) -> Column:
    return F.transform(F.slice(F.filter(votes, lambda x: x["less"] <= -least), 1, most), lambda x: x["label"])


def topics(text: Column, most: int = 2, least: int = 2, of: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Up to `most` topics with `least` keyword matches or more."""
    return _first_topics(_topic_votes(text, of or fixed.TOPICS), most, least)


def query_topic(text: Column, of: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The topic of a query, from one match on, or an empty string."""
    return F.coalesce(F.get(topics(text, 1, 1, of), F.lit(0)), F.lit(""))


def with_topics(rows: DataFrame, text: Column, most: int = 2, least: int = 2, of: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Rows with topics and query_topic of a text, from votes that are counted once."""
    voted = rows.withColumn("_votes", _topic_votes(text, of or fixed.TOPICS))
    first = F.coalesce(F.get(_first_topics(F.col("_votes"), 1, 1), F.lit(0)), F.lit(""))
    return voted.select(*rows.columns, _first_topics(F.col("_votes"), most, least).alias("topics"), first.alias("query_topic"))


def query_kind(text: Column) -> Column:
    """type and subcategory of a query (F23), empty where nothing matches; a subcategory of another type is dropped."""
    counts = [(kind, sub, _count(text, rf"(?i)\b(?:{words})\b")) for kind, sub, words in fixed.QUERY_KINDS]
    kinds = {}
    for kind, _, n in counts:
        kinds[kind] = kinds.get(kind, F.lit(0)) + n
    best, sub = F.get(votes(list(kinds.items())), F.lit(0))["label"], F.get(votes([(s, n) for _, s, n in counts]), F.lit(0))["label"]
    of = F.create_map(*[F.lit(x) for kind, s, _ in fixed.QUERY_KINDS for x in (s, kind)])
    return F.struct(F.coalesce(best, F.lit("")).alias("type"), F.when(F.element_at(of, sub) == best, sub).otherwise(F.lit("")).alias("subcategory"))


def entity_kind(name: Column) -> Column:
    """What a name tells of its kind."""
    out = F.lit("unknown")
    for kind, pattern in reversed(fixed.ENTITY_HINTS):
        out = F.when(name.rlike(pattern), kind).otherwise(out)
    return out


def _firsts(names: Column, key) -> Column:
    """Names of which no earlier one has the same key."""
    keys = F.transform(names, key)
    return F.filter(names, lambda x, k: F.array_position(keys, key(x)) == k + 1)


def entities(text: Column, most: int = fixed.MOST_ENTITIES) -> Column:
    """name and kind of what stands in bold or backticks, the first spelling of each."""
    found = F.concat(matches(text, fixed.BOLD_ENTITY, 1), matches(text, fixed.TICKED_ENTITY, 1))
    found = F.filter(found, lambda x: ~F.array_contains(_strings(*fixed.NO_ENTITIES), F.lower(x)))
    return F.transform(F.slice(_firsts(found, F.lower), 1, most), lambda x: F.struct(x.alias("name"), entity_kind(x).alias("kind")))


def needle_entities(text: Column) -> Column:
    """name and kind of addresses, ids, tickets and hosts; a host has a digit."""
    parts = [(kind, matches(text, pattern)) for kind, pattern in (("ip_address", fixed.NEEDLES["ip"]), ("uuid", fixed.NEEDLES["uuid"]), ("ticket_id", fixed.NEEDLES["ticket"]))]
    parts.append(("hostname", F.filter(matches(text, fixed.HOST), lambda x: x.rlike("[0-9]"))))
    named = lambda kind, found: F.transform(F.filter(found, lambda x: F.char_length(x) >= 3), lambda x: F.struct(x.alias("name"), F.lit(kind).alias("kind")))
    every = F.concat(*[named(kind, found) for kind, found in parts])
    return _firsts(every, lambda x: x["name"])


def temporal_intent(query: Column) -> Column:
    """"historical", "recency" or "neutral" (D4)."""
    q = _some(query)
    one = lambda cond, points=1: F.when(cond, points).otherwise(0)
    dated = q.rlike(fixed.ISO_DATE)
    historical = one(dated, 3) + one(q.rlike(fixed.MONTH_YEAR), 2) + one(q.rlike(fixed.YEAR) & ~dated)
    historical += sum((one(q.rlike(p), 2) for p in fixed.HISTORICAL_PATTERNS), F.lit(0)) + sum((one(F.contains(F.lower(q), F.lit(w))) for w in fixed.HISTORICAL_WORDS), F.lit(0))
    recency = sum((one(q.rlike(p), 2) for p in fixed.RECENCY_PATTERNS), F.lit(0)) + sum((one(F.contains(F.lower(q), F.lit(w))) for w in fixed.RECENCY_WORDS), F.lit(0))
    return F.when((historical >= 3) & (historical > recency), "historical").when((recency >= 2) & (recency > historical), "recency").otherwise("neutral")


def agent_of_path(path: Column) -> Column:
    """The part of a path after its first "agents", or else its first "memories" (F33)."""
    parts = F.split(_some(path), "/")
    after = lambda name: F.when(F.array_position(parts, F.lit(name)) > 0, F.get(parts, F.array_position(parts, F.lit(name)).cast("int")))
    return F.coalesce(after("agents"), after("memories"), F.lit(""))


def without_fences(text: Column) -> Column:
    """A text without the code fence around it."""
    stripped = F.regexp_replace(_some(text), rf"^{BLANK}+|{BLANK}+$", "")
    inner = F.regexp_replace(F.regexp_replace(stripped, r"^```(?:json)?\n?", ""), r"\n?```$", "")
    return F.regexp_replace(F.when(stripped.startswith("```"), inner).otherwise(stripped), rf"^{BLANK}+|{BLANK}+$", "")


def safe_label(label: Column, most: int = 48) -> Column:
    """Letters, digits, dashes and underscores, all else as underscores."""
    return F.substring(F.regexp_replace(_some(label), "[^A-Za-z0-9_-]", "_"), 1, most)


def safe_provenance(entries: Column) -> Column:
    """A map's entries that may be shown: known keys with a value, and none that looks like a secret."""
    return F.map_filter(entries, lambda k, v: F.array_contains(_strings(*fixed.SAFE_PROVENANCE), k) & (F.coalesce(v, F.lit("")) != "") & ~k.rlike(fixed.SECRET_KEY))
