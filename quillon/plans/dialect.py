"""One text for a query, said in Spark SQL or in the SQL of the engine that checks it.

Texts name tables in braces and use a few words in capitals for what the two say differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Fixed values, in both: the pattern of REDACTED, and what it puts in place of a credential.
_SPARK = {
    "EXPLODE": "explode({0})",
    "TOKENS": "filter(split(lower({0}), '[^a-z0-9]+'), x -> x <> '')",
    "JSON_K": "cast(get_json_object({0}, '$.k') as bigint)",
    "SHA256": "sha2({0}, 256)",
    "MICROS": "unix_micros(cast({0} as timestamp))",
    "ITEMS": "size({0})",
    "COMMON": "size(array_intersect({0}, {1}))",
    "EITHER": "size(array_union({0}, {1}))",
    "MATCHES": "({0} rlike {1})",
    "HITS": "regexp_count({0}, {1})",
    "SWAP": "regexp_replace({0}, {1}, {2})",
    "COSINE": "aggregate(zip_with({0}, {1}, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, x) -> s + x) / (sqrt(aggregate({0}, 0D, (s, x) -> s + cast(x as double) * cast(x as double))) * sqrt(aggregate({1}, 0D, (s, x) -> s + cast(x as double) * cast(x as double))))",
    "SORTED": "array_sort(collect_set({0}))",
    "JOINED": "array_join({0}, {1})",
    "LISTED": "array_join(transform(array_sort(collect_list(named_struct('a', {0}, 'b', {1}))), x -> x.b), {2})",
    "WORDS": "filter(split({0}, '[^a-z0-9_]+'), x -> length(x) > 2)",
    "SORTEDSET": "array_sort(array_distinct({0}))",
    "REDACTED": "regexp_replace({0}, '(?i)\\\\b(api[_-]?key|token|password|secret|bearer|authorization)\\\\b[ \t\n]*[:=][ \t\n]*[^ \t\n]+', '$1=[REDACTED]')",
    "DAYS": "make_interval(0, 0, 0, cast({0} as int))",
}
_DUCK = {
    "EXPLODE": "unnest({0})",
    "TOKENS": "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')",
    "JSON_K": "cast(json_extract_string({0}, '$.k') as bigint)",
    "SHA256": "sha256({0})",
    "MICROS": "epoch_us({0})",
    "ITEMS": "len({0})",
    "COMMON": "len(list_intersect({0}, {1}))",
    "EITHER": "len(list_distinct(list_concat({0}, {1})))",
    "MATCHES": "regexp_matches({0}, {1})",
    "HITS": "len(regexp_extract_all({0}, {1}))",
    "SWAP": "regexp_replace({0}, {1}, {2}, 'g')",
    "COSINE": "list_dot_product(cast({0} as double[]), cast({1} as double[])) / (sqrt(list_dot_product(cast({0} as double[]), cast({0} as double[]))) * sqrt(list_dot_product(cast({1} as double[]), cast({1} as double[]))))",
    "SORTED": "list_sort(list(distinct {0}))",
    "JOINED": "array_to_string({0}, {1})",
    "LISTED": "string_agg({1}, {2} order by {0}, {1})",
    "WORDS": "list_filter(regexp_split_to_array({0}, '[^a-z0-9_]+'), lambda x: length(x) > 2)",
    "SORTEDSET": "list_sort(list_distinct({0}))",
    "REDACTED": "regexp_replace({0}, '(?i)\\b(api[_-]?key|token|password|secret|bearer|authorization)\\b[ \t\n]*[:=][ \t\n]*[^ \t\n]+', '\\1=[REDACTED]', 'g')",
    "DAYS": "to_days(cast({0} as int))",
}


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """The arguments of a call whose bracket opens at `at`, and the place after it."""
    out, depth, start, quoted = [], 0, at + 1, False
    for k in range(at, len(text)):
        c = text[k]
        quoted ^= c == "'"
        if quoted:
            continue
        depth += (c == "(") - (c == ")")
        if depth == 0:
            return [*out, text[start:k].strip()], k + 1
        if c == "," and depth == 1:
            out.append(text[start:k].strip())
            start = k + 1
    raise ValueError(f"open bracket: {text[at:at + 40]}")


def said(text: str, words: dict[str, str]) -> str:
    pattern = re.compile(r"\b(" + "|".join(words) + r")\(")
    while m := pattern.search(text):
        args, end = _arguments(text, m.end() - 1)
        text = text[: m.start()] + words[m[1]].format(*args) + text[end:]
    return text


def tables_of(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


def spark_frame(spark: SparkSession, text: str, frames: dict[str, DataFrame]) -> DataFrame:
    """The query over the frames that it names."""
    return spark.sql(said(text, _SPARK), **{k: frames[k] for k in tables_of(text)})


def with_frames(text: str, shared: dict[str, str]) -> str:
    """The text with each shared part that it holds said over frames: shared names parts and what stands for them."""
    for part, other in shared.items():
        text = text.replace(part, other)
    return text


def duck_text(text: str) -> str:
    return said(re.sub(r"\{(\w+)\}", r"\1", text), _DUCK)
