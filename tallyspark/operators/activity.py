"""Feeds, groups and tables that the pages show, and conversations."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions import texts, times

DEPTH = {"essential": 25, "standard": 80, "comprehensive": 200}


def insight_type(c: Column) -> Column:
    """Techniques are learnings."""
    return F.when(c == "technique", "learning").otherwise(c)


def daily_activity(sessions: DataFrame, insights: DataFrame) -> DataFrame:
    """Sessions and insights of each day that has any."""
    one, none = F.lit(1), F.lit(0)
    days = sessions.select(F.to_date("started_at").alias("day"), one.alias("s"), none.alias("i")).union(insights.select(F.to_date("timestamp"), none, one))
    return days.groupBy("day").agg(F.sum("s").alias("sessions"), F.sum("i").alias("insights")).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "sessions", "insights")


def insight_type_counts(insights: DataFrame) -> DataFrame:
    return insights.groupBy(insight_type(F.col("type")).alias("type")).agg(F.count(F.lit(1)).alias("count"))


def project_pivot(insights: DataFrame, types: list[str]) -> DataFrame:
    """Insights of each project by type, a column a type."""
    return insights.groupBy("project_id").agg(F.count(F.lit(1)).alias("insights"), *[F.count_if(insight_type(F.col("type")) == t).alias(t) for t in types])


def activity_feed(sessions: DataFrame, insights: DataFrame, most: int = 7) -> DataFrame:
    """The latest of both."""
    both = sessions.select(F.lit("session").alias("kind"), "id", F.col("started_at").alias("happened")).unionByName(insights.select(F.lit("insight").alias("kind"), "id", F.col("timestamp").alias("happened")))
    return both.orderBy(F.desc("happened"), "kind", "id").limit(most)


def journal_weeks(insights: DataFrame) -> DataFrame:
    return insights.groupBy(F.date_format(times.iso_monday(F.col("timestamp")), "yyyy-MM-dd").alias("week")).agg(F.count(F.lit(1)).alias("insights"), F.count_distinct("session_id").alias("sessions"))


def week_inventory(sessions: DataFrame, facets: DataFrame, monday: str, weeks: int) -> DataFrame:
    """week, sessions and sessions with facets for the weeks up to one, empty weeks too."""
    last = date.fromisoformat(monday)
    s = sessions.filter(times.on_days(F.col("started_at"), last - timedelta(days=7 * (weeks - 1)), last + timedelta(days=6))).withColumn("week", times.iso_monday(F.col("started_at")))
    analysed = s.join(facets.select(F.col("session_id").alias("id")).distinct(), "id", "left_semi")
    counts = s.groupBy("week").agg(F.count(F.lit(1)).alias("sessions"))
    with_facets = analysed.groupBy("week").agg(F.count(F.lit(1)).alias("analysed"))
    days = sessions.sparkSession.range(1).select(F.explode(F.expr(f"sequence(date_sub(DATE '{monday}', {7 * (weeks - 1)}), DATE '{monday}', INTERVAL 7 DAY)")).alias("week"))
    zero = F.lit(0)
    return days.join(counts, "week", "left").join(with_facets, "week", "left").select(times.iso_week(F.col("week")).alias("week"), F.coalesce("sessions", zero).alias("sessions"), F.coalesce("analysed", zero).alias("analysed"))


def session_context(sessions: DataFrame) -> DataFrame:
    """What an export says of its sessions."""
    return sessions.agg(F.count(F.lit(1)).alias("sessions"), F.count_distinct("project_id").alias("projects"), F.date_format(F.min("started_at"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("ended_at"), "yyyy-MM-dd").alias("last"), F.max_by("project_name", F.struct("ended_at", "id")).alias("project_name"))


def depth_capped(insights: DataFrame, depth: str) -> DataFrame:
    """The most confident insights, as many as the depth allows."""
    return insights.orderBy(F.desc("confidence"), F.desc("timestamp"), "id").limit(DEPTH[depth])


def budgeted(insights: DataFrame, key: str, tokens: int = 300, budget: int = 60_000) -> DataFrame:
    """Of each key the most confident insights while their running token cost stays in the budget."""
    # every insight costs the same, so the budget is a rank, which Spark cuts to before it shuffles
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("confidence"), F.desc("timestamp"), "id"))
    return insights.withColumn("rank", rank).filter(F.col("rank") <= budget // tokens).withColumn("spent", F.col("rank") * tokens).drop("rank")


def deduplicated_titles(insights: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Of each session and type the first insight of a title, up to the type's cap."""
    first = W.partitionBy("session_id", "type", F.lower(F.trim("title"))).orderBy("timestamp", "id")
    rows = insights.withColumn("again", F.row_number().over(first)).filter("again = 1").drop("again")
    cap = F.lit(None).cast("int")
    for kind, n in caps.items():
        cap = F.when(F.col("type") == kind, n).otherwise(cap)
    rank = F.row_number().over(W.partitionBy("session_id", "type").orderBy("timestamp", "id"))
    return rows.withColumn("rank", rank).filter(cap.isNull() | (F.col("rank") <= cap))


def labelled_messages(messages: DataFrame) -> DataFrame:
    """Messages with class and label; genuine user turns and assistant turns are numbered from 0 in their session."""
    kind = F.when(F.col("type") == "user", F.when(texts.is_tool_result(F.col("content")), "tool-result").otherwise(texts.message_class(F.col("content"))))
    rows = messages.withColumn("class", kind)
    so_far = W.partitionBy("session_id").orderBy("timestamp", "position").rowsBetween(W.unboundedPreceding, W.currentRow)
    human, assistant = F.coalesce(F.col("class") == "human", F.lit(False)), F.col("type") == "assistant"
    number = lambda what: (F.sum(what.cast("int")).over(so_far) - 1).cast("string")
    label = (
        F.when(human, F.concat(F.lit("User#"), number(human)))
        .when(assistant, F.concat(F.lit("Assistant#"), number(assistant)))
        .when(F.col("class") == "tool-result", "[tool-result]")
        .when(F.col("class") == "auto-compact", "[auto-compact]")
        .when(F.col("type") == "user", "[system]")
        .otherwise("System")
    )
    return rows.withColumn("label", label)


#: Characters of thinking and of a tool's output in a prompt.
PROMPT_THINKING, PROMPT_OUTPUT = 1_000, 500


def hour_breaks(messages: DataFrame) -> DataFrame:
    """Where the author or the hour changes within a session."""
    order = W.partitionBy("session_id").orderBy("timestamp", "position")
    before = F.lag("type").over(order)
    hour, earlier = F.date_trunc("hour", "timestamp"), F.lag(F.date_trunc("hour", "timestamp")).over(order)
    return messages.select("id", F.coalesce(~before.eqNullSafe(F.col("type")), F.lit(True)).alias("author_change"), F.coalesce(hour != earlier, F.lit(True)).alias("hour_change"))


def transcript(messages: DataFrame) -> DataFrame:
    """session_id and text: the labelled messages in order, with thinking, the names of tools and their outputs where there are such columns, each cut. A session's messages meet in one row, as its prompt does."""
    rows = labelled_messages(messages)
    note = lambda head, text: F.when(text != "", F.concat(F.lit(f"\n[{head}: "), text, F.lit("]")))
    said = [F.lit("### "), F.col("label"), F.lit(":\n"), F.col("content")]
    if "thinking" in messages.columns:
        said.append(F.coalesce(note("Thinking", F.left("thinking", F.lit(PROMPT_THINKING))), F.lit("")))
    for head, column, text in (("Tools used", "tool_calls", lambda x: F.coalesce(F.nullif(x["name"], F.lit("")), F.lit("unknown"))), ("Tool results", "tool_results", lambda x: F.left(F.coalesce(x["output"], F.lit("")), F.lit(PROMPT_OUTPUT)))):
        if column in messages.columns:
            listed = F.array_join(F.transform(column, text), ", " if column == "tool_calls" else " | ")
            said.append(F.when(F.size(column) > 0, F.concat(F.lit(f"\n[{head}: "), listed, F.lit("]"))).otherwise(""))
    part = F.concat(*said)
    return rows.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("timestamp", "position", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("text"))


def language_votes(messages: DataFrame) -> DataFrame:
    """Language of the analysis of each session: the script of its genuine user turns."""
    human = (F.col("type") == "user") & ~texts.is_tool_result(F.col("content")) & (texts.message_class(F.col("content")) == "human")
    han = human & F.col("content").rlike(r"\p{IsHan}")
    other = human & ~F.col("content").rlike(r"\p{IsHan}") & F.col("content").rlike(r"\p{L}")
    return messages.groupBy("session_id").agg(F.count_if(han).alias("han"), F.count_if(other).alias("other")).withColumn("language", texts.language_vote(F.col("han"), F.col("other")))


def session_character(features: DataFrame) -> Column:
    """The first character that fits the counts of a session: message_count, tool_call_count, files_edited, files_created, edits, reads, has_error, has_fix, questions."""
    c = F.col
    return (
        F.when((c("message_count") >= 50) & c("files_edited").between(1, 3), "deep_focus")
        .when(c("has_error") & c("has_fix") & (c("edits") > 0), "bug_hunt")
        .when(c("files_created") >= 3, "feature_build")
        .when((c("reads") > c("edits") * 3) & (c("edits") < 5), "exploration")
        .when((c("edits") > 10) & (c("files_created") == 0), "refactor")
        .when((c("questions") >= 3) & (c("tool_call_count") < c("message_count")), "learning")
        .when((c("message_count") < 10) & (c("edits") > 0), "quick_task")
    )


def character_features(messages: DataFrame) -> DataFrame:
    """Counts of each session for session_character(); messages have tool_calls, an array of name and path."""
    calls = F.col("tool_calls")
    edit = F.filter(calls, lambda x: x["name"].isin(*texts.EDIT_TOOLS))
    created = F.filter(edit, lambda x: x["name"].isin(*texts.CREATE_TOOLS))
    rows = messages.select("session_id", "type", "content", F.size(calls).alias("calls"), F.size(edit).alias("e"), F.size(F.filter(calls, lambda x: x["name"].isin(*texts.READ_TOOLS))).alias("r"), edit["path"].alias("ep"), created["path"].alias("cp"))
    base = rows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("message_count"), F.sum("calls").alias("tool_call_count"), F.sum("e").alias("edits"), F.sum("r").alias("reads"),
        F.coalesce(F.bool_or(F.col("content").rlike(texts.HAS_ERROR)), F.lit(False)).alias("has_error"), F.coalesce(F.bool_or(F.col("content").rlike(texts.HAS_FIX)), F.lit(False)).alias("has_fix"),
        F.count_if((F.col("type") == "user") & F.col("content").contains("?")).alias("questions"),
    )
    for paths, name in (("ep", "files_edited"), ("cp", "files_created")):
        files = rows.select("session_id", F.explode(paths).alias("p")).filter("p IS NOT NULL AND p <> ''").groupBy("session_id").agg(F.count_distinct("p").alias(name))
        base = base.join(files, "session_id", "left").fillna(0, [name])
    return base
