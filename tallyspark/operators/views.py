"""Lists of sessions and insights as the pages filter, group and look them up."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import formats, markup, nested, texts
from tallyspark.operators import scope

EXPORTED, PROMPT_MESSAGES, BACKGROUNDS, RECURRING = 100, 500, 4, 200


def session_type_counts(insights: DataFrame) -> DataFrame:
    """Insights of each session by type."""
    return insights.groupBy("session_id", "type").agg(F.count(F.lit(1)).alias("count"))


def grouped(insights: DataFrame, view: str, today: date) -> DataFrame:
    """key, count and latest of the groups of a view (timeline, type, project, session), in its order."""
    key = {"type": F.col("type"), "project": F.col("project_id"), "session": F.col("session_id")}.get(view, formats.date_group(F.col("timestamp"), today))
    rows = insights.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("count"), F.max("timestamp").alias("latest"))
    order = {"type": ["key"], "project": [F.desc("count"), "key"]}.get(view, [F.desc("latest"), "key"])
    return rows.orderBy(*order)


def last_outcomes(facets: DataFrame) -> DataFrame:
    """session_id and outcome, as last extracted."""
    return facets.groupBy("session_id").agg(F.max_by("outcome_satisfaction", "extracted_at").alias("outcome"))


def last_scores(quality: DataFrame, score: Column) -> DataFrame:
    """session_id and score of the last insight (by id) that has one."""
    return quality.withColumn("score", score).filter("score IS NOT NULL").groupBy("session_id").agg(F.max_by("score", F.col("id").cast("long")).alias("score"))


def filter_sessions(sessions: DataFrame, outcomes: DataFrame, analysed: DataFrame, character: str | None = None, status: str | None = None, query: str | None = None, outcome: str | None = None, bounds: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """Sessions by character, analysed or not, text, start and outcome; those without an outcome pass every one."""
    rows = sessions
    if character:
        rows = rows.filter(F.col("session_character") == character)
    if status in ("analyzed", "unanalyzed"):
        rows = rows.join(analysed.select(F.col("session_id").alias("id")).distinct(), "id", "left_semi" if status == "analyzed" else "left_anti")
    if query:
        title = texts.display_title(F.col("custom_title"), F.col("generated_title"), F.col("summary"), blanks_count=False)
        rows = rows.filter(F.lower(title).contains(query.lower()) | F.lower("project_name").contains(query.lower()))
    for bound, keep in zip(bounds, (scope.from_text, scope.upto_text)):
        rows = rows.filter(keep(F.col("started_at"), bound)) if bound else rows
    if outcome:
        rows = rows.join(outcomes.select(F.col("session_id").alias("id"), "outcome"), "id", "left").filter(F.col("outcome").isNull() | (F.col("outcome") == outcome)).drop("outcome")
    return rows


def filter_insights(insights: DataFrame, sessions: DataFrame, types: tuple[str, ...] = (), query: str | None = None, source: str | None = None, members: DataFrame | None = None) -> DataFrame:
    """Insights by types, text, the tool of their session, and a group of ids (id)."""
    rows = insights
    if types:
        rows = rows.filter(F.col("type").isin(*types))
    if query:
        rows = rows.filter(F.lower("title").contains(query.lower()) | F.lower("content").contains(query.lower()))
    if source:
        rows = rows.join(sessions.filter(F.col("source_tool") == source).select(F.col("id").alias("session_id")), "session_id", "left_semi")
    return rows if members is None else rows.join(members.select("id").distinct(), "id", "left_semi")


def latest_session(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc("started_at"), "id").limit(1)


def present(rows: DataFrame, condition: Column) -> DataFrame:
    """One row, whether any of rows meets a condition; the scan ends at the first that does."""
    return rows.filter(condition).limit(1).agg((F.count(F.lit(1)) > 0).alias("present"))


def primary_session(insights: DataFrame, sessions: DataFrame, least: int = 2) -> DataFrame:
    """The newest live session of at least so many insights."""
    many = insights.groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("insights")).filter(F.col("insights") >= least)
    return sessions.join(many, "id").orderBy(F.desc("started_at"), "id").limit(1)


def deleted_counts(sessions: DataFrame) -> DataFrame:
    """project_id and deleted: how many sessions of a project are hidden."""
    return sessions.filter("deleted_at IS NOT NULL").groupBy("project_id").agg(F.count(F.lit(1)).alias("deleted"))


def message_page(messages: DataFrame, session_id: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of a session's messages in order."""
    return messages.filter(F.col("session_id") == session_id).orderBy("timestamp", "position").offset(offset).limit(limit)


def recurring_candidates(insights: DataFrame, most: int = RECURRING) -> DataFrame:
    """The newest insights that can recur: no summaries, and nothing about prompts."""
    return insights.filter(~F.col("type").isin("summary", "prompt_quality")).orderBy(F.desc("timestamp"), "id").limit(most)


def matching_messages(messages: DataFrame, query: str) -> DataFrame:
    """Ids of messages with the text."""
    return messages.filter(F.lower("content").contains(query.lower())).select("id")


def prompt_messages(sessions: DataFrame, messages: DataFrame, most: int = PROMPT_MESSAGES) -> DataFrame:
    """The user messages of the latest sessions, which tell the language of a report."""
    asked = messages.filter("type = 'user'").select("session_id", F.col("id").alias("message_id"), "content", "timestamp")
    rows = sessions.select(F.col("id").alias("session_id"), "started_at").join(asked, "session_id")
    return rows.orderBy(F.desc("started_at"), "timestamp", "message_id").limit(most)


def tool_outputs(messages: DataFrame) -> DataFrame:
    """session_id, id, name and output of each tool call; output is null where no result has its id. Of calls or results of one id the first counts."""
    first = lambda c, name, *fields: (
        messages.select("session_id", F.struct("timestamp", "position").alias("at"), F.explode(c).alias("x")).groupBy("session_id", F.col("x.id").alias("id")).agg(*[F.min_by(f"x.{f}", "at").alias(f) for f in fields])
    )
    return first("tool_calls", "call", "name").join(first("tool_results", "result", "output"), ["session_id", "id"], "left")


def session_backgrounds(insights: DataFrame, sessions: DataFrame, most: int = BACKGROUNDS) -> DataFrame:
    """Of the sessions of chosen insights those with a summary that have most of them."""
    counts = insights.groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("insights"))
    title = F.coalesce("custom_title", "generated_title", F.lit("Untitled"))
    rows = sessions.filter("summary IS NOT NULL AND summary <> ''").join(counts, "id")
    return rows.select("id", title.alias("title"), "session_character", "summary", "insights").orderBy(F.desc("insights"), "id").limit(most)


def exported(sessions: DataFrame, insights: DataFrame, project: str | None = None, most: int = EXPORTED) -> DataFrame:
    """Insights of the latest live sessions, of a project or of all, by type and time."""
    rows = sessions.filter("deleted_at IS NULL")
    rows = rows.filter(F.col("project_id") == project) if project else rows
    latest = rows.orderBy(F.desc("started_at"), "id").limit(most).select(F.col("id").alias("session_id"))
    return insights.join(latest, "session_id", "left_semi").orderBy("type", "timestamp", "id")


def dispatch_prefill(sessions: DataFrame, facets: DataFrame) -> DataFrame:
    """id, title and context that a post about a session starts with: three patterns, three points the user can act on."""
    described = lambda c: F.filter(F.coalesce(F.try_variant_get(nested.variant(F.col(c)), "$", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.lit(True))
    lines = lambda items: F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), nested.text_field(x, "$.description"))), "\n")
    learned = F.slice(described("effective_patterns"), 1, 3)
    hard = F.slice(F.filter(described("friction_points"), lambda x: nested.text_field(x, "$.attribution") == "user-actionable"), 1, 3)
    context = F.concat_ws("\n\n", F.when(F.size(learned) > 0, F.concat(F.lit("## What you learned\n"), lines(learned))), F.when(F.size(hard) > 0, F.concat(F.lit("## What was hard\n"), lines(hard))))
    title = F.coalesce("custom_title", "generated_title", F.lit("Untitled Session"))
    return sessions.join(facets.select(F.col("session_id").alias("id"), "effective_patterns", "friction_points"), "id").select("id", title.alias("title"), context.alias("context"))


def dispatch_context(insights: DataFrame, context: str, backgrounds: DataFrame | None = None) -> DataFrame:
    """session_id and text: what the author says, the background of the session, if it has one (id, title, session_character, summary), and its insights as numbered blocks. They meet in one row, as a prompt's do."""
    m = F.struct("timestamp", "id", "type", "summary", "content", "bullets").alias("m")
    by = insights.select("session_id", m).groupBy("session_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    blocks = F.array_join(F.transform("ms", lambda x, k: markup.insight_block(k + 1, x["type"], x["summary"], x["content"], x["bullets"])), "\n\n")
    told = F.lit(None).cast("string")
    if backgrounds is not None:
        by = by.join(backgrounds.select(F.col("id").alias("session_id"), "title", "session_character", F.col("summary").alias("background")), "session_id", "left")
        told = markup.background_block(F.col("title"), F.col("session_character"), F.col("background"))
    count = F.concat(F.lit("---\n\nINSIGHTS ("), F.size("ms").cast("string"), F.lit(" selected by author):\n\n"))
    return by.select("session_id", F.concat(F.lit(f"Context from the author:\n{context}\n\n"), F.coalesce(told, F.lit("")), count, blocks).alias("text"))


def merged_ids(a: Column, b: Column) -> Column:
    """Both lists of ids, each id once, in order."""
    return F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def shares(rows: DataFrame, column: str) -> DataFrame:
    """value, count and percent of all that have a value."""
    by = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = by.agg(F.sum("count").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("value", "count", F.round(F.col("count") * 100.0 / F.col("total"), 4).alias("percent"))  # one row


def top_characters(sessions: DataFrame, most: int = 3) -> DataFrame:
    return sessions.filter("session_character IS NOT NULL").groupBy("session_character").agg(F.count(F.lit(1)).alias("sessions")).orderBy(F.desc("sessions"), "session_character").limit(most)


def cost_means(sessions: DataFrame) -> DataFrame:
    """Cost in all, of a day that has any session, and of a session with a cost."""
    days = F.count_distinct(F.to_date("started_at"))
    cost = F.sum("estimated_cost_usd")
    return sessions.agg(F.round(cost, 4).alias("cost"), F.round(cost / days, 6).alias("per_day"), F.round(cost / F.count("estimated_cost_usd"), 6).alias("per_session"))
