"""Titles of sessions, from what they say and do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions import texts
from tallyspark.operators import activity

# What makes no title, and where topics and bugs are named.
SKIPPED = (
    r"(?i)^(yes|no|ok|okay|sure|thanks|thank you|continue|go ahead|sounds good|looks good|perfect|great|nice|cool|done|got it)\.?$",
    r"(?i)^(y|n|k)$",
    r"^```",
)
TOPICS = (
    r"(?i)(?:about|for|with|using)\s+([a-z][a-z0-9\s-]{2,20})",
    r"(?i)([a-z][a-z0-9\s-]{2,15})\s+(?:feature|component|module|function|api)",
)
BUG = r"(?i)(?:fix|bug|error|issue)[:\s]+([^.!?\n]{5,40})"
LEAST_SCORE, FIRST_TEXTS, LONG_WORDS, CUT_WORDS = 40, 3, 50, 20
# End of fixed values.

TRIMMED = r"^\s+|\s+$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, TRIMMED, "")


def candidate(text: Column) -> Column:
    """text and score of a user text as a title; null where it makes none."""
    words = F.split(text, r"\s+")
    sentence = F.split(text, "[.!?]")[0]
    short = F.when(F.size(words) > LONG_WORDS, F.when(F.length(sentence) > 10, sentence).otherwise(F.array_join(F.slice(words, 1, CUT_WORDS), " "))).otherwise(text)
    skip = F.size(words) < 3
    for pattern in SKIPPED:
        skip = skip | text.rlike(pattern)
    score = texts.title_score(short)
    return F.when(~skip & (score > 0), F.struct(short.alias("text"), score.alias("score")))


def first_match(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(text.rlike(p), trimmed(F.regexp_extract(text, p, 1))) for p in patterns])


def user_candidates(messages: DataFrame) -> DataFrame:
    """session_id and best, the first of a session's first user texts that makes a title."""
    first = F.row_number().over(W.partitionBy("session_id").orderBy("timestamp", "position"))
    asked = messages.filter("type = 'user'").select("session_id", "timestamp", "position", "content").withColumn("nth", first).filter(F.col("nth") <= FIRST_TEXTS)
    rows = asked.select("session_id", "nth", candidate(trimmed(F.col("content"))).alias("c"))
    return rows.groupBy("session_id").agg(F.min(F.when(F.col("c").isNotNull(), F.struct("nth", "c")))["c"].alias("best"))


def primary_files(messages: DataFrame) -> DataFrame:
    """session_id and file, the name of the file that is edited most, the first of equals."""
    edit = F.filter("tool_calls", lambda x: x["name"].isin(*texts.EDIT_TOOLS) & (x["path"] != ""))
    names = messages.select("session_id", "timestamp", "position", F.posexplode(edit).alias("k", "call")).select("session_id", F.struct("timestamp", "position", "k").alias("at"), F.substring_index("call.path", "/", -1).alias("file"))
    counts = names.groupBy("session_id", "file").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    return counts.groupBy("session_id").agg(F.min_by("file", F.struct(-F.col("n"), F.col("at"))).alias("file"))


def subjects(messages: DataFrame) -> DataFrame:
    """session_id, topic and bug that the user texts name: of each pattern the first text that has it, so no session's texts are gathered."""
    at = F.struct("timestamp", "position")
    named = {f"topic{k}": first_match(F.lower("content"), (p,)) for k, p in enumerate(TOPICS)} | {"bug": first_match(F.col("content"), (BUG,))}
    rows = messages.filter("type = 'user'").select("session_id", "timestamp", "position", *[v.alias(n) for n, v in named.items()])
    by = rows.groupBy("session_id").agg(*[F.min(F.when(F.col(n).isNotNull(), F.struct(at.alias("at"), n)))[n].alias(n) for n in named])
    return by.select("session_id", F.coalesce(*[f"topic{k}" for k in range(len(TOPICS))]).alias("topic"), "bug")


def generated_titles(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """session_id, title, source and character of sessions (session_id, project_name, summary).

    The summary makes the title if there is one; else a good user text, what the session's character says, any
    user text, and at last the project's name.
    """
    features = activity.character_features(messages)
    kinds = features.select("session_id", "message_count", activity.session_character(features).alias("character"))
    rows = sessions.join(kinds, "session_id", "left").join(user_candidates(messages), "session_id", "left").join(primary_files(messages), "session_id", "left").join(subjects(messages), "session_id", "left")
    file, topic = F.coalesce("file", F.lit("files")), F.coalesce(F.nullif("topic", F.lit("")), "project_name")
    says = {
        "deep_focus": ("Deep work: ", file), "bug_hunt": ("Fixed: ", F.coalesce(F.nullif("bug", F.lit("")), file)), "feature_build": ("Built: ", topic), "exploration": ("Explored: ", topic),
        "refactor": ("Refactored: ", file), "learning": ("Learned: ", topic), "quick_task": ("Updated: ", file),
    }
    by_character = F.lit(None).cast("string")
    for name, (word, what) in says.items():
        by_character = F.when(F.col("character") == name, F.concat(F.lit(word), what)).otherwise(by_character)
    summary = F.when(trimmed(F.col("summary")) != "", texts.clean_title(F.col("summary")))
    good, any_ = F.col("best.score") >= LEAST_SCORE, F.col("best.text").isNotNull()
    asked = texts.clean_title(F.col("best.text"))
    last = F.concat("project_name", F.lit(" session ("), F.coalesce("message_count", F.lit(0)).cast("string"), F.lit(" messages)"))
    title = F.when(summary.isNotNull(), summary).when(good, asked).when(by_character.isNotNull(), by_character).when(any_, asked).otherwise(last)
    source = F.when(summary.isNotNull(), "claude").when(good, "user_message").when(by_character.isNotNull(), "character").when(any_, "user_message").otherwise("fallback")
    return rows.select("session_id", title.alias("title"), source.alias("source"), F.when(source == "character", F.col("character")).alias("character"))
