"""Which sessions a query is about, lists of them, and search."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import texts, times

#: Ids of a request that may travel by broadcast.
MAX_LOOKUP = 500
DATE_LITERAL = re.compile(r"\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?")
KNOWN_SOURCES = ("claude-code", "codex-cli", "copilot-cli", "copilot", "cursor")


def live(sessions: DataFrame) -> DataFrame:
    """Sessions that aren't deleted."""
    return sessions.filter("deleted_at IS NULL")


def scoped(sessions: DataFrame, period: str = "all", project: str | None = None, source: str | None = None, as_of: datetime | None = None, rolling: bool = True, zone: str = "UTC") -> DataFrame:
    """Live sessions of a period, project and source: one conjunction of predicates that reaches the scan."""
    keep: Column = F.col("deleted_at").isNull()
    if as_of is not None:
        keep = keep & times.in_period(F.col("started_at"), period, as_of, rolling, zone)
    if project:
        keep = keep & (F.col("project_id") == project)
    if source:
        keep = keep & (F.col("source_tool") == source)
    return sessions.filter(keep)


def safe_int(value: str | None, default: int) -> int:
    """A page size or offset as it comes from a request."""
    m = re.match(r"\s*[+-]?\d+", value or "")
    return int(m[0]) if m else default


def check_date(value: str) -> str:
    if not DATE_LITERAL.fullmatch(value):
        raise ValueError(f"not a date: {value}")
    return value


def page(rows: DataFrame, *order: Column, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page in a total order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def iso_text(ts: Column) -> Column:
    """A timestamp as the text that bounds are compared with."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def from_text(ts: Column, bound: str) -> Column:
    """Is a time, as text, at or after a text bound? A comparison of timestamps, so that it reaches the scan."""
    at = times.text_moment(bound)
    return iso_text(ts) >= bound if at is None else ts >= times.moment(at)


def upto_text(ts: Column, bound: str) -> Column:
    """Is a time, as text, at or before a text bound? A bound that is no whole text of a second leaves its last unit out."""
    at = times.text_moment(bound)
    if at is None:
        return iso_text(ts) <= bound
    return ts < times.moment(at + timedelta(seconds=1) if len(bound) == 20 and bound.endswith("Z") else at)


def session_list(sessions: DataFrame, query: str | None = None, date_from: str | None = None, date_to: str | None = None, **scope) -> DataFrame:
    """Live sessions by text in any of four columns and by text bounds of the start: a bare end date leaves out its own day."""
    rows = scoped(sessions, **scope)
    if query:
        found = F.lit(False)
        for c in ("custom_title", "generated_title", "summary", "project_name"):
            found = found | F.coalesce(texts.like_literal(F.col(c), query), F.lit(False))
        rows = rows.filter(found)
    if date_from:
        rows = rows.filter(from_text(F.col("started_at"), check_date(date_from)))
    if date_to:
        rows = rows.filter(upto_text(F.col("started_at"), check_date(date_to)))
    return rows


def search_sessions(sessions: DataFrame, query: str) -> DataFrame:
    """Live sessions whose title or summary has the query, with the field that has it and a snippet."""
    columns = ("custom_title", "generated_title", "summary")
    hit = {c: F.coalesce(texts.like_literal(F.col(c), query), F.lit(False)) for c in columns}
    field = F.when(hit["custom_title"], "custom_title").when(hit["generated_title"], "generated_title").when(hit["summary"], "summary")
    value = F.when(hit["custom_title"], F.col("custom_title")).when(hit["generated_title"], F.col("generated_title")).otherwise(F.col("summary"))
    rows = live(sessions).withColumn("match_field", field).filter("match_field IS NOT NULL")
    title = texts.display_title(F.col("custom_title"), F.col("generated_title"), F.col("summary"), blanks_count=False)
    return rows.select("id", "started_at", title.alias("title"), "match_field", texts.snippet(value, query).alias("snippet"))


def search_insights(insights: DataFrame, sessions: DataFrame, query: str) -> DataFrame:
    """Insights of live sessions whose title or content has the query."""
    in_title, in_content = texts.like_literal(F.col("title"), query), texts.like_literal(F.col("content"), query)
    rows = insights.filter(in_title | in_content).join(live(sessions).select(F.col("id").alias("session_id")), "session_id", "left_semi")
    return rows.select("id", "timestamp", F.when(in_title, "title").otherwise("content").alias("match_field"), texts.snippet(F.when(in_title, F.col("title")).otherwise(F.col("content")), query).alias("snippet"))


def resolve_project(projects: DataFrame, name: str, most: int = 3) -> DataFrame:
    """How a project name is meant: exact, one that contains it, or similar ones by edit distance, with a rank of the kind."""
    low = F.lower("project_name")
    distance = F.levenshtein(low, F.lit(name.lower()))
    rank = F.when(low == name.lower(), 0).when(low.contains(name.lower()), 1).when(distance <= most, 2)
    found = projects.select("project_id", "project_name", rank.alias("rank"), distance.alias("distance")).filter("rank IS NOT NULL")
    return found.orderBy("rank", "distance", "project_name", "project_id")


def ordered_lookup(rows: DataFrame, ids: list[str]) -> DataFrame:
    """Rows by a list of ids, with their position in the list."""
    wanted = rows.sparkSession.createDataFrame(list(enumerate(ids)), "position long, id string")
    return rows.join(F.broadcast(wanted) if len(ids) <= MAX_LOOKUP else wanted, "id")


def navigable_weeks(weeks: DataFrame, present: str) -> DataFrame:
    """Weeks (week, sessions) with any session, and the present one."""
    return weeks.filter((F.col("sessions") > 0) | (F.col("week") == present))
