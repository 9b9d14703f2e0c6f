"""The life of memories and facts as changes of tables: (table, changes) -> table. Nothing is updated in place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Share of an old fact's words that a new one must hold to supersede it; overlap from which facts are merged; limits of
# forgetting; days, tries and delays of the outbox.
SUPERSEDES, MERGES = 0.6, 0.85
COLD, UNIMPORTANT, AGED_DAYS, FORGOTTEN = 0.05, 0.4, 14, 20
BATCH, TRIES, LONGEST_DELAY, ORPHAN_SECONDS, KEPT_DAYS, PRUNED = 50, 5, 60.0, 60, 7, 1000
RETENTION = ("ephemeral", "standard", "durable", "permanent")
# What is learnt from an outcome.
LESSONS = (
    ("recovery", ("failure", "failed", "error"), "Avoid repeating the failing approach; verify preconditions and rollback paths."),
    ("strategy", ("success", "ok", "completed"), "Reuse the successful approach for similar tasks."),
    ("optimization", (), "Record what was attempted and clarify success criteria next time."),
)


def merged(table: DataFrame, changes: DataFrame, key: list[str], rules: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """table after changes, one row of each for a key: rows of either side as they are, those of both by the rule of each column."""
    new = changes.select(*key, *[F.col(c).alias(f"_{c}") for c in rules], F.lit(True).alias("_new"))
    old = table.select(*key, *rules, F.lit(True).alias("_old"))
    value = lambda c: F.when(F.col("_old").isNull(), F.col(f"_{c}")).when(F.col("_new").isNull(), F.col(c)).otherwise(rules[c](F.col(c), F.col(f"_{c}"))).alias(c)
    return old.join(new, key, "full").select(*key, *map(value, rules))


def higher_retention(old: Column, new: Column) -> Column:
    order = F.array(*map(F.lit, RETENTION))
    return F.when(F.array_position(order, new) > F.array_position(order, old), new).otherwise(old)


def upsert_entities(table: DataFrame, seen: DataFrame) -> DataFrame:
    """entities(id, mention_count, last_seen, retention) after sightings(id, at, retention), any number of each (M1)."""
    rank = F.array_position(F.array(*map(F.lit, RETENTION)), F.col("retention"))
    new = seen.groupBy("id").agg(F.count("*").alias("mention_count"), F.max("at").alias("last_seen"), F.max_by("retention", rank).alias("retention"))
    return merged(table, new, ["id"], {"mention_count": lambda a, b: a + b, "last_seen": F.greatest, "retention": higher_retention})


def supersede(facts: DataFrame) -> DataFrame:
    """facts(id, entity, fact) with superseded_by: the first later fact of the entity that holds SUPERSEDES of its words (M3, J19). Pairs of
    an entity's facts are held against each other where the facts meet, and only the first of each fact goes on."""
    words = facts.select("id", "entity", text.blank_word_set(F.col("fact")).alias("words"))
    words = words.where(F.size("words") > 0)
    met = words.join(words.select(F.col("id").alias("by"), "entity", F.col("words").alias("others")).hint("merge"), "entity").where(F.col("by") > F.col("id"))
    first = met.where(F.size(F.array_intersect("words", "others")) >= SUPERSEDES * F.size("words")).groupBy("id").agg(F.min("by").alias("superseded_by"))
    return facts.join(first, "id", "left")


def resolutions(pairs: DataFrame) -> DataFrame:
    """pairs(entity, a, b, text_a, text_b, at_a, at_b, trigger) with action, winner, loser, merged text and the id by which it is applied once (M10, Z9): near-equal facts are merged, of opposing
    ones of different times the newer wins, others are both kept."""
    a, b = text.letter_word_set(F.col("text_a")), text.letter_word_set(F.col("text_b"))
    either = F.size(F.array_union(a, b))
    overlap = F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / either).otherwise(F.lit(0.0))
    merge = (F.col("trigger") == "near_duplicate") | (overlap >= MERGES)
    opposed = F.coalesce(F.contains("trigger", F.lit("/")), F.lit(False)) & (F.col("at_a") != F.col("at_b"))
    action = F.when(F.coalesce(merge, F.lit(False)), "merge").when(opposed, "supersede").otherwise("keep_both")
    newer = F.col("at_a") >= F.col("at_b")
    out = pairs.withColumn("action", action)
    wins = F.col("action") == "supersede"
    out = out.withColumns({"winner": F.when(wins, F.when(newer, F.col("a")).otherwise(F.col("b"))), "loser": F.when(wins, F.when(newer, F.col("b")).otherwise(F.col("a")))})
    out = out.withColumn("merged", F.when(F.col("action") == "merge", merged_text(F.col("text_a"), F.col("text_b"))))
    named = F.concat_ws(":", F.col("entity").cast("string"), F.least("a", "b").cast("string"), F.greatest("a", "b").cast("string"), "action")
    return out.withColumn("resolution_id", F.substring(F.sha2(named, 256), 1, 16))


def forget_candidates(chunks: DataFrame, hotness: DataFrame, now: Column, most: int = FORGOTTEN) -> DataFrame:
    """id and rule of cold, unimportant chunks(id, importance, created_at, ttl_at), the coldest `most`."""
    rows = chunks.join(hotness.select("id", "hotness"), "id", "left").where(F.coalesce("importance", F.lit(0.5)) <= UNIMPORTANT)
    aged = F.coalesce(F.col("created_at") < now - F.expr(f"interval {AGED_DAYS} days"), F.lit(False))
    over = F.coalesce(F.col("ttl_at") < now, F.lit(False))
    rows = rows.where(F.coalesce(F.col("hotness") <= COLD, F.lit(False)) | (F.col("hotness").isNull() & (aged | over)))
    rule = F.when(over, "ttl_expired_cold").when(F.col("hotness").isNull(), "unscored_aged_low_importance").otherwise("cold_low_importance")
    return rows.withColumn("rule", rule).orderBy(F.coalesce("hotness", F.lit(0.0)), F.coalesce("importance", F.lit(0.5)), "id").limit(most).select("id", "rule")


def without(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """table without rows whose key is in gone(id)."""
    return table.join(gone.select(F.col("id").alias(key)), key, "left_anti")


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, children: tuple[str, str] | None = None) -> dict[str, DataFrame]:
    """tables, by name (rows, column that names the memory), after memories and their children are deleted (M15). children names the table
    and the column of its own ids; what it holds of a deleted memory is deleted from all tables too."""
    every = gone.select("id")
    if children:
        rows, parent = tables[children[0]]
        every = every.union(rows.join(gone.select(F.col("id").alias(parent)), parent, "left_semi").select(F.col(children[1]).alias("id")))
    out = {name: without(rows, every, key) for name, (rows, key) in tables.items()}
    if children:
        out[children[0]] = without(out[children[0]], every, children[1])
    return out


def expired(table: DataFrame, now: Column, most: int = 1000) -> DataFrame:
    """ids whose time to live has passed, the first `most` by time."""
    return table.where((F.col("expires_at") > 0) & (F.col("expires_at") <= now)).orderBy("expires_at", "id").limit(most).select("id")


def merge_groups(members: DataFrame, how: str) -> DataFrame:
    """One memory for each group of members(group, id, at, agent, content, version) of two or more (M13, Z16): the newest content with the
    version after its own ("latest"), or all by time, each under its time and agent, with the version after the highest ("concat")."""
    parts = F.array_sort(F.collect_list(F.struct("at", "id", "agent", "content", "version")))
    rows = members.groupBy("group").agg(parts.alias("parts"), F.max("version").alias("version"), F.count("*").alias("n")).where("n >= 2")
    headed = F.transform("parts", lambda x: F.concat(F.lit("["), F.coalesce(x["at"].cast("string"), F.lit("?")), F.lit(" — "), F.coalesce(x["agent"], F.lit("?")), F.lit("]\n"), x["content"]))
    if how == "latest":
        last = F.element_at("parts", -1)
        return rows.select("group", last["content"].alias("content"), (last["version"] + 1).alias("version"), "n")
    return rows.select("group", F.array_join(headed, "\n\n---\n\n").alias("content"), (F.col("version") + 1).alias("version"), "n")


def merged_text(a: Column, b: Column) -> Column:
    """Two texts as one: the longer where it holds the other, whatever the case."""
    a, b = F.trim(F.coalesce(a, F.lit(""))), F.trim(F.coalesce(b, F.lit("")))
    return F.when(a == "", b).when((b == "") | (F.lower(a) == F.lower(b)), a).when(F.contains(F.lower(b), F.lower(a)), b).when(F.contains(F.lower(a), F.lower(b)), a).otherwise(F.concat(a, F.lit(" | "), b))


def reflections(runs: DataFrame) -> DataFrame:
    """id, category and tip of runs(id, task, outcome, score)."""
    outcome = F.lower(F.trim(F.coalesce(F.when(F.col("outcome") != "", F.col("outcome")), F.lit("unknown"))))
    category, lesson = F.lit(LESSONS[-1][0]), F.lit(LESSONS[-1][2])
    for name, outcomes, said in reversed(LESSONS[:-1]):
        category, lesson = F.when(outcome.isin(*outcomes), name).otherwise(category), F.when(outcome.isin(*outcomes), said).otherwise(lesson)
    score = F.when(F.col("score").isNotNull(), F.concat(F.lit(" (score="), F.col("score").cast("string"), F.lit(")"))).otherwise(F.lit(""))
    task = F.substring(F.coalesce(F.when(F.col("task") != "", F.col("task")), F.lit("task")), 1, 200)
    return runs.select("id", category.alias("category"), F.concat(F.lit("Reflection on '"), task, F.lit("': outcome="), outcome, score, F.lit(". "), lesson).alias("tip"))


def session_summaries(runs: DataFrame) -> DataFrame:
    """One text for each session of runs(session, at, outcome, task): a line for each run in order of time."""
    line = F.concat(F.lit("- ["), F.coalesce("outcome", F.lit("unknown")), F.lit("] "), F.substring(F.coalesce("task", F.lit("")), 1, 200))
    rows = runs.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))).alias("lines"), F.count("*").alias("runs"))
    return rows.select("session", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("summary"), "runs")


def drain_cycle(outbox: DataFrame, failures: DataFrame, now: Column, batch: int = BATCH) -> DataFrame:
    """outbox(id, status, tries, last_attempt, created_at) after one cycle (T1, T2, T3, T11): rows left in work for ORPHAN_SECONDS are pending again
    with a try more, rows applied KEPT_DAYS ago go (PRUNED at most), and of the pending rows that are due the first `batch` by time are applied,
    or for failures(id) tried again after 0.5 x 2^tries seconds, or dead after TRIES."""
    seconds = lambda n: F.make_dt_interval(secs=n)
    orphan = F.coalesce((F.col("status") == "processing") & (F.col("last_attempt") < now - seconds(F.lit(float(ORPHAN_SECONDS)))), F.lit(False))
    rows = outbox.withColumns({"tries": F.when(orphan, F.col("tries") + 1).otherwise(F.col("tries")), "status": F.when(orphan, "pending").otherwise(F.col("status"))})
    old = (F.col("status") == "applied") & (F.col("last_attempt") < now - F.make_dt_interval(days=F.lit(KEPT_DAYS)))
    pruned = rows.where(old).orderBy("last_attempt", "id").limit(PRUNED).select("id")
    rows = rows.join(F.broadcast(pruned), "id", "left_anti")
    due = rows.where((F.col("status") == "pending") & (F.col("last_attempt").isNull() | (F.col("last_attempt") < now)))
    claimed = due.orderBy("created_at", "id").limit(batch).select("id").join(failures.select("id", F.lit(True).alias("fails")), "id", "left").withColumn("claimed", F.lit(True))
    rows = rows.join(F.broadcast(claimed), "id", "left")
    mine, fails = F.col("claimed").isNotNull(), F.col("fails").isNotNull()
    tries = F.when(mine & fails, F.col("tries") + 1).otherwise(F.col("tries"))
    delay = F.least(F.pow(F.lit(2.0), tries) * 0.5, F.lit(LONGEST_DELAY))
    status = F.when(mine & ~fails, "applied").when(mine & (tries >= TRIES), "dead").when(mine, "pending").otherwise(F.col("status"))
    attempt = F.when(mine & fails & (tries < TRIES), now + seconds(delay)).when(mine, now).otherwise(F.col("last_attempt"))
    return rows.select("id", status.alias("status"), tries.alias("tries"), attempt.alias("last_attempt"), "created_at")


def bootstrap(values: DataFrame, rounds: int = 1000, least: int = 30, seed: int = 42) -> DataFrame:
    """(key, n, mean, low, high) of values(key, value): the mean and its 95 % interval over resamples, the interval from `least` values on.

    A resample takes each value a Poisson-distributed number of times, drawn from a hash of the row and round, so a resample is a sum that is
    combined map-side and no key's values meet in one task."""
    uniform = lambda k: (F.pmod(F.xxhash64("key", "id", k, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    thresholds, term, total = [], 0.36787944117144233, 0.0
    for k in range(12):
        total += term
        thresholds.append(total)
        term /= k + 1
    times = lambda u: sum((F.when(u > t, 1).otherwise(0) for t in thresholds), F.lit(0))
    drawn = values.select("key", "id", "value", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn("times", times(uniform(F.col("round"))))
    means = drawn.groupBy("key", "round").agg(F.try_divide(F.sum(F.col("value") * F.col("times")), F.sum("times").cast("double")).alias("mean"))
    spread = means.groupBy("key").agg(F.array_sort(F.collect_list("mean")).alias("means"))  # one number a round
    at = lambda k: F.element_at("means", F.greatest(F.lit(1), F.least(F.size("means"), F.lit(k))))
    low, high = at(int(0.025 * rounds) + 1), at(int(0.975 * rounds))
    whole = values.groupBy("key").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    shown = F.col("n") >= least
    return whole.join(spread, "key").select("key", "n", F.round("mean", 4).alias("mean"), F.when(shown, F.round(low, 4)).alias("low"), F.when(shown, F.round(high, 4)).alias("high"))
