"""Statistics of usage and cost. Cost and token totals use sessions that have a cost; counts use all."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions import costs, times

TOKENS = ("total_input_tokens", "total_output_tokens", "cache_creation_tokens", "cache_read_tokens")


def total(c: str | Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def with_cost(c: Column) -> Column:
    return F.when(F.col("estimated_cost_usd").isNotNull(), c)


def all_tokens() -> Column:
    out = F.lit(0).cast("long")
    for t in TOKENS:
        out = out + F.coalesce(F.col(t), F.lit(0))
    return out


def dashboard_stats(sessions: DataFrame, *by: str) -> DataFrame:
    """Counts, projects, sums and whole minutes (negative spans count, as they stand)."""
    minutes = F.sum(times.minutes_between(F.col("started_at"), F.col("ended_at"), clamp=False)).cast("long")
    return sessions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_distinct("project_id").alias("projects"),
        total("message_count").alias("messages"),
        total("tool_call_count").alias("tool_calls"),
        F.coalesce(minutes, F.lit(0)).alias("minutes"),
        F.sum(sum((F.col(t) for t in TOKENS[1:]), F.col(TOKENS[0]))).alias("tokens"),
    )


def overview(sessions: DataFrame, as_of: datetime) -> DataFrame:
    """Totals, and sessions of today, yesterday and this week."""
    day = F.to_date("started_at")
    today = F.lit(as_of.date())
    return sessions.agg(
        F.count(F.lit(1)).alias("sessions"),
        total("message_count").alias("messages"),
        F.count_distinct("project_id").alias("projects"),
        F.round(total("estimated_cost_usd"), 4).alias("cost"),
        total(with_cost(all_tokens())).alias("tokens"),
        F.count("estimated_cost_usd").alias("sessions_with_cost"),
        F.count_if(day == today).alias("today"),
        F.count_if(day == F.date_sub(today, 1)).alias("yesterday"),
        F.count_if(day >= times.iso_monday(today)).alias("this_week"),
    )


def source_breakdown(sessions: DataFrame) -> DataFrame:
    """Sessions by tool, only if there are at least two tools."""
    by = sessions.groupBy("source_tool").agg(F.count(F.lit(1)).alias("sessions"))
    return by.withColumn("tools", F.count(F.lit(1)).over(W.partitionBy())).filter("tools >= 2").drop("tools")


def share_of(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Percentage of the sum over all rows of an aggregated table, which is a scalar subquery: no row moves for it."""
    whole = rows.agg(F.sum(value)).scalar()
    return rows.withColumn(name, F.round(costs.percent(F.col(value), whole), 4))


def top_projects(sessions: DataFrame, most: int = 10) -> DataFrame:
    """Projects with the most sessions, with their cost and share of all sessions."""
    by = sessions.groupBy("project_id").agg(F.max("project_name").alias("project_name"), F.count(F.lit(1)).alias("sessions"), F.round(total("estimated_cost_usd"), 4).alias("cost"))
    return share_of(by, "sessions", "percent").orderBy(F.desc("sessions"), "project_id").limit(most)


def cost_by(sessions: DataFrame, key: str) -> DataFrame:
    """Cost of each key and its share."""
    by = sessions.groupBy(key).agg(F.round(total("estimated_cost_usd"), 4).alias("cost"))
    return share_of(by, "cost", "percent")


def most_frequent(sessions: DataFrame, key: str, value: str) -> DataFrame:
    """key and its most frequent value; of equals the one seen first, from the latest session back."""
    counts = sessions.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("started_at", "id")).alias("seen"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("n", "seen")).alias(value))


def project_stats(sessions: DataFrame) -> DataFrame:
    """Of each project: counts, cost, minutes, tokens, usual model and tool, last activity."""
    minutes = F.sum(times.minutes_between(F.col("started_at"), F.col("ended_at")))
    base = sessions.groupBy("project_id").agg(
        F.max("project_name").alias("project_name"),
        F.count(F.lit(1)).alias("sessions"),
        F.round(total("estimated_cost_usd"), 4).alias("cost"),
        F.round(minutes, 2).alias("minutes"),
        total(with_cost(all_tokens())).alias("tokens"),
        F.max("ended_at").alias("last_activity"),
    )
    for value in ("primary_model", "source_tool"):
        base = base.join(most_frequent(sessions, "project_id", value), "project_id", "left")
    return base


def model_stats(sessions: DataFrame) -> DataFrame:
    """Of each model: sessions, cost, their shares, the mean, and the cost split of its tokens by price."""
    model = F.coalesce("primary_model", F.lit("unknown"))
    by = sessions.withColumn("model", model).groupBy("model").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.round(total("estimated_cost_usd"), 4).alias("cost"),
        total(with_cost(F.col("total_input_tokens"))).alias("input_tokens"),
        total(with_cost(F.col("total_output_tokens"))).alias("output_tokens"),
    )
    by = share_of(share_of(by, "sessions", "session_percent"), "cost", "cost_percent")
    mega = lambda c: F.col(c) / 1_000_000
    return by.select(
        "*",
        F.round(F.col("cost") / F.col("sessions"), 4).alias("cost_per_session"),
        F.round(mega("input_tokens") * costs.model_price(F.col("model"), 0), 8).alias("input_cost"),
        F.round(mega("output_tokens") * costs.model_price(F.col("model"), 1), 8).alias("output_cost"),
    )


def token_costs(sessions: DataFrame) -> DataFrame:
    """Cost of each kind of token by the session's model, and the share of input read from the cache."""
    model = F.coalesce("primary_model", F.lit(""))
    mega = lambda c: with_cost(F.coalesce(F.col(c), F.lit(0)) / 1_000_000)
    price = costs.model_price(model, 0)
    reads, fresh = total(with_cost(F.col("cache_read_tokens"))), total(with_cost(F.col("total_input_tokens")))
    return sessions.agg(
        F.round(F.sum(mega("total_input_tokens") * price), 2).alias("input_cost"),
        F.round(F.sum(mega("total_output_tokens") * costs.model_price(model, 1)), 2).alias("output_cost"),
        F.round(F.sum(mega("cache_creation_tokens") * price * costs.CACHE_WRITE_FACTOR), 2).alias("cache_write_cost"),
        F.round(F.sum(mega("cache_read_tokens") * price * costs.CACHE_READ_FACTOR), 2).alias("cache_read_cost"),
        F.round(costs.percent(reads, fresh + reads), 4).alias("cache_hit_rate"),
    )


def series(sessions: DataFrame, period: str, as_of: datetime) -> DataFrame:
    """One row for each bucket of the chart's window, empty ones with zeros; sessions before the window fall away."""
    by = sessions.groupBy(times.bucket_key(F.col("started_at"), period).alias("bucket")).agg(F.count(F.lit(1)).alias("sessions"), total("estimated_cost_usd").alias("cost"))
    buckets = times.calendar(sessions.sparkSession, period, as_of)  # at most 30 rows
    filled = by.join(F.broadcast(buckets), "bucket", "right")
    return filled.select("bucket", F.coalesce("sessions", F.lit(0)).alias("sessions"), F.round(F.coalesce("cost", F.lit(0.0)), 2).alias("cost"))


def peak(points: DataFrame) -> DataFrame:
    """The bucket of the highest cost, the earliest of equals."""
    return points.orderBy(F.desc("cost"), "bucket").limit(1)


def local_days(sessions: DataFrame, first: date, last: date, zone: str) -> DataFrame:
    """day, sessions, cost and minutes of the days of a range in a zone, empty days too."""
    rows = sessions.filter(times.on_days(F.col("started_at"), first, last, zone))
    by = rows.groupBy(times.local_day(F.col("started_at"), zone).alias("day")).agg(F.count(F.lit(1)).alias("sessions"), F.round(total("estimated_cost_usd"), 4).alias("cost"), F.round(F.sum(times.minutes_between(F.col("started_at"), F.col("ended_at"))), 2).alias("minutes"))
    days = sessions.sparkSession.range((last - first).days + 1).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("day"))
    return days.join(by, "day", "left").select("day", F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce("minutes", F.lit(0.0)).alias("minutes"))


def days_in_period(sessions: DataFrame) -> DataFrame:
    """Days that all sessions span, at least one."""
    span = (F.unix_micros(F.max("started_at")) - F.unix_micros(F.min("started_at"))) / 86_400_000_000
    return sessions.agg(F.greatest(F.lit(1), F.ceil(span) + 1).cast("long").alias("days"))


def streak(sessions: DataFrame, as_of: datetime, zone: str = "UTC") -> DataFrame:
    """Days in a row in a zone with sessions that end today or yesterday."""
    today = as_of.replace(tzinfo=timezone.utc).astimezone(ZoneInfo(zone)).date()
    days = sessions.filter(F.col("started_at") < times.moment(times.day_start(today + timedelta(days=1), zone))).select(times.local_day(F.col("started_at"), zone).alias("day")).distinct()
    # one row for each day that has sessions, whatever the number of sessions
    numbered = days.withColumn("rank", F.row_number().over(W.orderBy(F.desc("day")))).withColumn("last", F.max("day").over(W.partitionBy()))
    run = numbered.filter(F.col("day") == F.date_sub("last", F.col("rank") - 1)).filter(F.col("last") >= F.date_sub(F.lit(today), 1))
    return run.agg(F.count(F.lit(1)).alias("streak"))


def rollup(projects: DataFrame, sessions: DataFrame) -> DataFrame:
    """Totals of every project, zeros for those without sessions."""
    by = sessions.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.sum("estimated_cost_usd").alias("cost"), F.sum(all_tokens()).alias("tokens"), F.max("ended_at").alias("last"))
    zero = F.lit(0)
    return projects.join(by, "project_id", "left").select("project_id", F.coalesce("n", zero).alias("sessions"), F.round(F.coalesce("cost", F.lit(0.0)), 4).alias("cost"), F.coalesce("tokens", zero).alias("tokens"), F.col("last").alias("last_activity"))
