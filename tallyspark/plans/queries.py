"""The queries of session analytics over the driver's tables, each with DuckDB SQL that gives the same rows.

A query is a function of Tables, which projects the driver's tables lazily, so that Catalyst sees one plan from
scan to result. Times leave as text, sums of doubles rounded.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import categories, costs, texts, times
from tallyspark.operators import activity, facets, graph, quality, scope, state, stats
from tallyspark.plans import adapters

ORDERS_NOW, EVENTS_NOW = (datetime.fromisoformat(x) for x in (adapters.AS_OF_ORDERS, adapters.AS_OF_EVENTS))


class Tables:
    """The logical tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    sessions = cached_property(lambda self: adapters.sessions(self.spark, self.sf_dir))
    live = cached_property(lambda self: scope.live(self.sessions))
    events = cached_property(lambda self: scope.live(adapters.events(self.spark, self.sf_dir)))
    insights = cached_property(lambda self: adapters.insights(self.spark, self.sf_dir))
    facets = cached_property(lambda self: adapters.facets(self.spark, self.sf_dir))
    pq = cached_property(lambda self: adapters.prompt_quality(self.spark, self.sf_dir))
    messages = cached_property(lambda self: adapters.messages(self.spark, self.sf_dir))
    queue = cached_property(lambda self: adapters.queue(self.spark, self.sf_dir))
    usage = cached_property(lambda self: adapters.usage(self.spark, self.sf_dir))


CTES = {
    "sessions": adapters.SESSIONS_SQL,
    "live": "live AS (SELECT * FROM sessions WHERE deleted_at IS NULL)",
    "events": adapters.EVENTS_SQL + ", ev AS (SELECT * FROM events_s WHERE deleted_at IS NULL)",
    "insights": adapters.INSIGHTS_SQL,
    "facets": adapters.FACETS_SQL,
    "pq": adapters.PROMPT_QUALITY_SQL,
    "messages": adapters.MESSAGES_SQL,
    "queue": adapters.QUEUE_SQL,
    "usage": adapters.USAGE_SQL,
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, ctes: str = "", sql: str | None = None):
    """Register a function of Tables, and SQL over the common table expressions named."""

    def add(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql:
            named = ", ".join(CTES[c] for c in ctes.split())
            ORACLES[name] = (f"WITH {named}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}") if named else sql
        return build

    return add


def when_text(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def sql_time(c: str, name: str | None = None) -> str:
    return f"strftime({c}::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS {name or c}"


def sql_price(model: str, side: int) -> str:
    exact = " ".join(f"WHEN {model} = '{m}' THEN {p[side]}" for m, p in costs.MODEL_PRICES.items())
    prefix = " ".join(f"WHEN starts_with({model}, '{m}') THEN {p[side]}" for m, p in costs.MODEL_PRICES.items())
    return f"CAST(CASE {exact} {prefix} ELSE {costs.DEFAULT_PRICE[side]} END AS DOUBLE)"


def sql_category(raw: str, words: categories.Vocabulary) -> str:
    low, known = f"lower({raw})", words.canonical
    alias = " ".join(f"WHEN '{a}' THEN '{t}'" for a, t in words.aliases.items())
    near = " ".join(f"WHEN levenshtein({low}, '{c}') = {n} THEN '{c}'" for n in (1, 2) for c in known)
    inside = " ".join(f"WHEN least(length({low}), {len(c)}) >= 5 AND 2 * least(length({low}), {len(c)}) >= greatest(length({low}), {len(c)}) AND (contains({low}, '{c}') OR contains('{c}', {low})) THEN '{c}'" for c in known)
    listed = ", ".join(f"'{c}'" for c in known)
    return f"CASE WHEN {low} IN ({listed}) THEN {low} ELSE coalesce(CASE {low} {alias} END, CASE {near} END, CASE {inside} END, {raw}) END"


MINUTES = "(epoch_us(ended_at::TIMESTAMP) - epoch_us(started_at::TIMESTAMP)) / 60000000.0"
TOKENS = " + ".join(f"coalesce({t}, 0)" for t in stats.TOKENS)
LABEL = "array_to_string(list_transform(string_split({0}, '-'), lambda w: upper(left(w, 1)) || substring(w, 2)), ' ')"

# --- usage and cost -----------------------------------------------------------------------------------------


@query("dashboard_stats", "sessions live", f"""
SELECT source_tool, count(*) AS sessions, count(DISTINCT project_id) AS projects, CAST(sum(message_count) AS BIGINT) AS messages,
  CAST(sum(tool_call_count) AS BIGINT) AS tool_calls, CAST(trunc(sum({MINUTES})) AS BIGINT) AS minutes, CAST(sum({" + ".join(stats.TOKENS)}) AS BIGINT) AS tokens
FROM live GROUP BY source_tool""")
def dashboard_stats(t: Tables) -> DataFrame:
    return stats.dashboard_stats(t.live, "source_tool")


@query("dashboard_stats_week", "sessions live", f"""
SELECT count(*) AS sessions, count(DISTINCT project_id) AS projects, CAST(coalesce(sum(message_count), 0) AS BIGINT) AS messages,
  CAST(coalesce(sum(tool_call_count), 0) AS BIGINT) AS tool_calls, CAST(coalesce(trunc(sum({MINUTES})), 0) AS BIGINT) AS minutes, CAST(sum({" + ".join(stats.TOKENS)}) AS BIGINT) AS tokens
FROM live WHERE started_at >= TIMESTAMP '1997-03-03' AND started_at < TIMESTAMP '1997-03-10' AND source_tool = 'ASIA'""")
def dashboard_stats_week(t: Tables) -> DataFrame:
    return stats.dashboard_stats(scope.scoped(t.sessions, "1997-W10", source="ASIA", as_of=ORDERS_NOW))


@query("overview_totals", "sessions live", f"""
SELECT count(*) AS sessions, CAST(sum(message_count) AS BIGINT) AS messages, count(DISTINCT project_id) AS projects, round(sum(estimated_cost_usd), 4) AS cost,
  CAST(sum(CASE WHEN estimated_cost_usd IS NOT NULL THEN {TOKENS} END) AS BIGINT) AS tokens, count(estimated_cost_usd) AS sessions_with_cost,
  count(*) FILTER (started_at::DATE = DATE '2001-08-02') AS today, count(*) FILTER (started_at::DATE = DATE '2001-08-01') AS yesterday,
  count(*) FILTER (started_at::DATE >= DATE '2001-07-30') AS this_week
FROM live""")
def overview_totals(t: Tables) -> DataFrame:
    return stats.overview(t.live, ORDERS_NOW)


@query("source_breakdown", "sessions live", "SELECT source_tool, count(*) AS sessions FROM live GROUP BY source_tool QUALIFY count(*) OVER () >= 2")
def source_breakdown(t: Tables) -> DataFrame:
    return stats.source_breakdown(t.live)


@query("top_projects", "sessions live", """
SELECT project_id, any_value(project_name) AS project_name, count(*) AS sessions, round(coalesce(sum(estimated_cost_usd), 0), 4) AS cost, round(count(*) * 100.0 / (SELECT count(*) FROM live), 4) AS percent
FROM live GROUP BY project_id ORDER BY sessions DESC, project_id LIMIT 10""")
def top_projects(t: Tables) -> DataFrame:
    return stats.top_projects(t.live)


@query("cost_by_project", "sessions live", """
SELECT project_id, cost, round(coalesce(cost * 100.0 / nullif(sum(cost) OVER (), 0), 0), 4) AS percent
FROM (SELECT project_id, round(coalesce(sum(estimated_cost_usd), 0), 4) AS cost FROM live GROUP BY project_id)""")
def cost_by_project(t: Tables) -> DataFrame:
    return stats.cost_by(t.live, "project_id")


@query("cost_by_model", "sessions live", """
SELECT primary_model, cost, round(coalesce(cost * 100.0 / nullif(sum(cost) OVER (), 0), 0), 4) AS percent
FROM (SELECT primary_model, round(coalesce(sum(estimated_cost_usd), 0), 4) AS cost FROM live WHERE primary_model IS NOT NULL GROUP BY primary_model)""")
def cost_by_model(t: Tables) -> DataFrame:
    return stats.cost_by(t.live.filter("primary_model IS NOT NULL"), "primary_model")


_MEGA = "(CASE WHEN estimated_cost_usd IS NOT NULL THEN coalesce({0}, 0) / 1000000.0::DOUBLE END)"


@query("token_costs", "sessions live", f"""
SELECT round(sum({_MEGA.format("total_input_tokens")} * {sql_price("coalesce(primary_model, '')", 0)}), 2) AS input_cost,
  round(sum({_MEGA.format("total_output_tokens")} * {sql_price("coalesce(primary_model, '')", 1)}), 2) AS output_cost,
  round(sum({_MEGA.format("cache_creation_tokens")} * {sql_price("coalesce(primary_model, '')", 0)} * 1.25::DOUBLE), 2) AS cache_write_cost,
  round(sum({_MEGA.format("cache_read_tokens")} * {sql_price("coalesce(primary_model, '')", 0)} * 0.1::DOUBLE), 2) AS cache_read_cost,
  round(sum(cache_read_tokens) FILTER (estimated_cost_usd IS NOT NULL) * 100.0::DOUBLE / (sum(total_input_tokens) FILTER (estimated_cost_usd IS NOT NULL) + sum(cache_read_tokens) FILTER (estimated_cost_usd IS NOT NULL)), 4) AS cache_hit_rate
FROM live""")
def token_costs(t: Tables) -> DataFrame:
    return stats.token_costs(t.live)


@query("project_stats", "sessions live", f"""+
ranked AS (SELECT project_id, v, kind, row_number() OVER (PARTITION BY project_id, kind ORDER BY n DESC, seen DESC, seen_id DESC) AS r FROM (
    SELECT project_id, 'm' AS kind, primary_model AS v, count(*) AS n, max(started_at) AS seen, arg_max(id, (started_at, id)) AS seen_id FROM live WHERE primary_model IS NOT NULL GROUP BY project_id, primary_model
    UNION ALL SELECT project_id, 't', source_tool, count(*), max(started_at), arg_max(id, (started_at, id)) FROM live WHERE source_tool IS NOT NULL GROUP BY project_id, source_tool)),
  base AS (SELECT project_id, max(project_name) AS project_name, count(*) AS sessions, round(coalesce(sum(estimated_cost_usd), 0), 4) AS cost, round(sum(greatest(0, {MINUTES})), 2) AS minutes,
    CAST(coalesce(sum(CASE WHEN estimated_cost_usd IS NOT NULL THEN {TOKENS} END), 0) AS BIGINT) AS tokens, max(ended_at) AS last FROM live GROUP BY project_id)
SELECT base.project_id, project_name, sessions, cost, minutes, tokens, strftime(last::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS last_activity, m.v AS primary_model, s.v AS source_tool
FROM base LEFT JOIN ranked m ON m.project_id = base.project_id AND m.kind = 'm' AND m.r = 1 LEFT JOIN ranked s ON s.project_id = base.project_id AND s.kind = 't' AND s.r = 1""")
def project_stats(t: Tables) -> DataFrame:
    return stats.project_stats(t.live).withColumn("last_activity", when_text("last_activity"))


@query("model_stats", "sessions live", f"""+
by_model AS (SELECT coalesce(primary_model, 'unknown') AS model, count(*) AS sessions, round(coalesce(sum(estimated_cost_usd), 0), 4) AS cost,
    CAST(coalesce(sum(total_input_tokens) FILTER (estimated_cost_usd IS NOT NULL), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(total_output_tokens) FILTER (estimated_cost_usd IS NOT NULL), 0) AS BIGINT) AS output_tokens
  FROM live GROUP BY 1)
SELECT *, round(sessions * 100.0 / sum(sessions) OVER (), 4) AS session_percent, round(cost * 100.0 / sum(cost) OVER (), 4) AS cost_percent, round(cost / sessions, 4) AS cost_per_session,
  round(input_tokens / 1000000.0::DOUBLE * {sql_price("model", 0)}, 8) AS input_cost, round(output_tokens / 1000000.0::DOUBLE * {sql_price("model", 1)}, 8) AS output_cost
FROM by_model""")
def model_stats(t: Tables) -> DataFrame:
    return stats.model_stats(t.live)


@query("today_detail", "sessions live", f"""
SELECT id, {sql_time("started_at")}, coalesce(custom_title, generated_title, summary, 'Untitled Session') AS title, round(estimated_cost_usd, 4) AS cost FROM live WHERE started_at::DATE = DATE '1996-01-02'""")
def today_detail(t: Tables) -> DataFrame:
    day = t.live.filter(F.to_date("started_at") == F.lit("1996-01-02").cast("date"))
    return day.select("id", when_text("started_at"), texts.display_title(F.col("custom_title"), F.col("generated_title"), F.col("summary")).alias("title"), F.round("estimated_cost_usd", 4).alias("cost"))


def _series_sql(buckets: str, key: str, table: str) -> str:
    return f"""
SELECT b.bucket, coalesce(sessions, 0) AS sessions, round(coalesce(cost, 0), 2) AS cost FROM ({buckets}) b
LEFT JOIN (SELECT {key} AS bucket, count(*) AS sessions, sum(estimated_cost_usd) AS cost FROM {table} GROUP BY 1) s ON s.bucket = b.bucket"""


_DAYS_7 = "SELECT strftime(d, '%Y-%m-%d') AS bucket FROM generate_series(TIMESTAMP '2024-01-24', TIMESTAMP '2024-01-30', INTERVAL 1 DAY) g(d)"
_DAYS_30 = "SELECT strftime(d, '%Y-%m-%d') AS bucket FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY) g(d)"


@query("daily_buckets", "events", _series_sql(_DAYS_7, "strftime(started_at, '%Y-%m-%d')", "ev"))
def daily_buckets(t: Tables) -> DataFrame:
    return stats.series(t.events, "7d", EVENTS_NOW)


@query("range_stats", "events", _series_sql(_DAYS_30, "strftime(started_at, '%Y-%m-%d')", "ev"))
def range_stats(t: Tables) -> DataFrame:
    return stats.series(t.events, "30d", EVENTS_NOW)


@query("weekly_buckets", "events", _series_sql("SELECT strftime(d, '%G-W%V') AS bucket FROM generate_series(TIMESTAMP '2023-11-07', TIMESTAMP '2024-01-30', INTERVAL 7 DAY) g(d)", "strftime(started_at, '%G-W%V')", "ev"))
def weekly_buckets(t: Tables) -> DataFrame:
    return stats.series(t.events, "90d", EVENTS_NOW)


@query("monthly_buckets", "sessions live", _series_sql("SELECT strftime(d, '%Y-%m') AS bucket FROM generate_series(TIMESTAMP '2000-09-01', TIMESTAMP '2001-08-01', INTERVAL 1 MONTH) g(d)", "strftime(started_at::TIMESTAMP, '%Y-%m')", "live"))
def monthly_buckets(t: Tables) -> DataFrame:
    return stats.series(t.live, "all", ORDERS_NOW)


@query("peak_day", "events", f"SELECT * FROM ({_series_sql(_DAYS_30, "strftime(started_at, '%Y-%m-%d')", 'ev')}) ORDER BY cost DESC, bucket LIMIT 1")
def peak_day(t: Tables) -> DataFrame:
    return stats.peak(range_stats(t))


@query("days_in_period", "events", "SELECT greatest(1, CAST(ceil((epoch_us(max(started_at)) - epoch_us(min(started_at))) / 86400000000.0) AS BIGINT) + 1) AS days FROM ev")
def days_in_period(t: Tables) -> DataFrame:
    return stats.days_in_period(t.events)


@query("most_frequent_model", "sessions live", """
SELECT project_id, primary_model FROM (SELECT project_id, primary_model, count(*) AS n, max(started_at) AS seen, arg_max(id, (started_at, id)) AS seen_id FROM live WHERE primary_model IS NOT NULL GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY n DESC, seen DESC, seen_id DESC) = 1""")
def most_frequent_model(t: Tables) -> DataFrame:
    return stats.most_frequent(t.live, "project_id", "primary_model")


@query("streak", "events", """+
days AS (SELECT DISTINCT started_at::DATE AS d FROM ev WHERE started_at::DATE <= DATE '2024-01-30'),
numbered AS (SELECT d, row_number() OVER (ORDER BY d DESC) AS r, max(d) OVER () AS last FROM days)
SELECT count(*) AS streak FROM numbered WHERE d = last - CAST(r - 1 AS INTEGER) AND last >= DATE '2024-01-29'""")
def streak(t: Tables) -> DataFrame:
    return stats.streak(t.events, EVENTS_NOW)


@query("project_rollup", "sessions live", f"""
SELECT CAST(c_custkey AS VARCHAR) AS project_id, coalesce(n, 0) AS sessions, round(coalesce(cost, 0), 4) AS cost, coalesce(tokens, 0) AS tokens, strftime(last::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS last_activity
FROM customer LEFT JOIN (SELECT project_id, count(*) AS n, sum(estimated_cost_usd) AS cost, CAST(sum({TOKENS}) AS BIGINT) AS tokens, max(ended_at) AS last FROM live GROUP BY 1) s ON s.project_id = CAST(c_custkey AS VARCHAR)""")
def project_rollup(t: Tables) -> DataFrame:
    projects = adapters.table(t.spark, t.sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("project_id"))
    return stats.rollup(projects, t.live).withColumn("last_activity", when_text("last_activity"))


@query("usage_recompute", "sessions live", f"""
SELECT count(*) AS sessions, CAST(sum({TOKENS}) AS BIGINT) AS tokens, round(sum(coalesce(estimated_cost_usd, 0)), 4) AS cost FROM live WHERE total_input_tokens IS NOT NULL""")
def usage_recompute(t: Tables) -> DataFrame:
    return t.live.filter("total_input_tokens IS NOT NULL").agg(F.count(F.lit(1)).alias("sessions"), F.sum(stats.all_tokens()).alias("tokens"), F.round(F.sum(F.coalesce("estimated_cost_usd", F.lit(0.0))), 4).alias("cost"))


@query("session_cost", "sessions live", f"""
SELECT id, floor((coalesce(total_input_tokens, 0) / 1000000.0::DOUBLE * pi + coalesce(total_output_tokens, 0) / 1000000.0::DOUBLE * po + coalesce(cache_creation_tokens, 0) / 1000000.0::DOUBLE * pi * 1.25::DOUBLE + coalesce(cache_read_tokens, 0) / 1000000.0::DOUBLE * pi * 0.1::DOUBLE) * 10000 + 0.5) / 10000.0::DOUBLE AS cost
FROM (SELECT *, {sql_price("primary_model", 0)} AS pi, {sql_price("primary_model", 1)} AS po FROM live)""")
def session_cost(t: Tables) -> DataFrame:
    return t.live.select("id", costs.session_cost(F.col("primary_model"), *[F.col(c) for c in stats.TOKENS]).alias("cost"))


@query("price_lookup", "sessions live", f"SELECT DISTINCT primary_model, {sql_price('primary_model', 0)} AS input_price, {sql_price('primary_model', 1)} AS output_price FROM live")
def price_lookup(t: Tables) -> DataFrame:
    m = F.col("primary_model")
    return t.live.select(m, costs.model_price(m, 0).alias("input_price"), costs.model_price(m, 1).alias("output_price")).distinct()


@query("cost_estimate", "sessions live", """
SELECT id, floor((CASE WHEN s = 0 AND message_count > 0 THEN least(message_count * 500.0::DOUBLE, 80000) ELSE s END / 1000000 * 3.0::DOUBLE + 0.03::DOUBLE) * 1000000 + 0.5) / 1000000.0::DOUBLE AS cost
FROM (SELECT id, message_count, least(coalesce(total_input_tokens, 0) * 0.03::DOUBLE, 80000.0::DOUBLE) AS s FROM live)""")
def cost_estimate(t: Tables) -> DataFrame:
    return t.live.select("id", costs.estimated_cost(F.col("total_input_tokens"), F.col("message_count"), (3.0, 15.0), 2000).alias("cost"))


@query("model_short_names", "sessions live", f"""
SELECT DISTINCT primary_model, CASE {" ".join(f"WHEN starts_with(primary_model, '{p}') THEN '{s}'" for p, s in texts.MODEL_NAMES.items())} ELSE left(primary_model, 20) END AS short FROM live WHERE primary_model IS NOT NULL""")
def model_short_names(t: Tables) -> DataFrame:
    return t.live.filter("primary_model IS NOT NULL").select("primary_model", texts.short_model(F.col("primary_model")).alias("short")).distinct()


@query("session_durations", "sessions live", f"""
SELECT id, CASE WHEN m < 1 THEN '<1m' WHEN m < 60 THEN m || 'm' WHEN m < 1440 THEN (m // 60) || 'h' || CASE WHEN m % 60 > 0 THEN ' ' || (m % 60) || 'm' ELSE '' END
  ELSE (m // 1440) || 'd' || CASE WHEN (m // 60) % 24 > 0 THEN ' ' || ((m // 60) % 24) || 'h' ELSE '' END END AS duration
FROM (SELECT id, CAST(floor({MINUTES} + 0.5) AS BIGINT) AS m FROM live)""")
def session_durations(t: Tables) -> DataFrame:
    return t.live.select("id", times.format_duration(F.col("started_at"), F.col("ended_at")).alias("duration"))


@query("iso_weeks", "sessions live", "SELECT strftime(started_at::TIMESTAMP, '%G-W%V') AS week, strftime(date_trunc('week', started_at::TIMESTAMP), '%Y-%m-%d') AS monday, count(*) AS sessions FROM live GROUP BY 1, 2")
def iso_weeks(t: Tables) -> DataFrame:
    start = F.col("started_at")
    return t.live.groupBy(times.iso_week(start).alias("week"), F.date_format(times.iso_monday(start), "yyyy-MM-dd").alias("monday")).agg(F.count(F.lit(1)).alias("sessions"))


# --- facets -------------------------------------------------------------------------------------------------

_FRICTION = "named AS (SELECT *, " + sql_category("category", categories.FRICTION) + " AS name FROM friction WHERE trim(category) <> '')"
_RATE = "regexp_matches(name, '(?i)rate.?limit|throttl')"


@query("friction_categories", "facets", f"""+ {_FRICTION}
SELECT name AS category, count(*) AS count, count(DISTINCT session_id) AS sessions, round(avg(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END), 4) AS avg_severity,
  array_to_string(list(description ORDER BY description)[1:10], '|') AS examples
FROM named WHERE NOT {_RATE} GROUP BY name""")
def friction_categories(t: Tables) -> DataFrame:
    return facets.friction_categories(facets.friction_points(t.facets)).withColumn("examples", F.array_join("examples", "|"))


@query("rate_limit_info", "facets", f"""+ {_FRICTION}
SELECT count(*) AS count, count(DISTINCT session_id) AS sessions, array_to_string(list(DISTINCT name ORDER BY name)[1:3], '|') AS kinds FROM named WHERE {_RATE}""")
def rate_limit_info(t: Tables) -> DataFrame:
    return facets.rate_limits(facets.friction_points(t.facets)).withColumn("kinds", F.array_join("kinds", "|"))


@query("friction_attribution", "facets", "SELECT coalesce(attribution, 'unattributed') AS attribution, count(*) AS count FROM friction WHERE trim(category) <> '' GROUP BY 1")
def friction_attribution(t: Tables) -> DataFrame:
    return facets.attribution_counts(facets.friction_points(t.facets))


_PATTERN = "named AS (SELECT *, " + sql_category("category", categories.PATTERN) + " AS name FROM patterns WHERE confidence >= 50)"


@query("effective_patterns", "facets", f"""+ {_PATTERN}
SELECT name AS category, count(*) AS frequency, round(avg(confidence), 4) AS avg_confidence, array_to_string(list(description ORDER BY confidence DESC, description)[1:10], '|') AS descriptions,
  CASE WHEN name = 'self-correction' THEN 'Self-Correction' ELSE {LABEL.format("name")} END AS label
FROM named GROUP BY name""")
def effective_patterns(t: Tables) -> DataFrame:
    return facets.effective_patterns(facets.pattern_points(t.facets)).withColumn("descriptions", F.array_join("descriptions", "|"))


@query("pattern_drivers", "facets", f"+ {_PATTERN} SELECT name AS category, coalesce(driver, 'unlabeled') AS driver, count(*) AS count FROM named GROUP BY 1, 2")
def pattern_drivers(t: Tables) -> DataFrame:
    return facets.pattern_drivers(facets.pattern_points(t.facets))


_STRENGTHS = ", ".join(f"'{c}'" for c in categories.PROMPT_QUALITY_STRENGTHS)


@query("pq_findings", "pq", f"""
SELECT name AS category, {LABEL.format("name")} AS label, CASE WHEN name IN ({_STRENGTHS}) THEN 'strength' ELSE 'deficit' END AS type, count(DISTINCT session_id) AS sessions
FROM (SELECT session_id, {sql_category("category", categories.PROMPT_QUALITY)} AS name FROM pq_findings) GROUP BY name HAVING count(DISTINCT session_id) >= 2""")
def pq_findings(t: Tables) -> DataFrame:
    return facets.quality_findings(t.pq)


_DIMENSIONS = ", ".join(f"floor(avg(CASE WHEN (doc_id * {3 + 2 * k}) % 120 <= 100 THEN (doc_id * {3 + 2 * k}) % 120 END) + 0.5) AS {d}" for k, d in enumerate(adapters.PQ_DIMENSIONS))


@query("pq_dimension_scores", "pq", f"""
SELECT *, floor(({" + ".join(adapters.PQ_DIMENSIONS)}) / {len(adapters.PQ_DIMENSIONS)} + 0.5) AS overall FROM (SELECT {_DIMENSIONS} FROM pq WHERE kind = 'full')""")
def pq_dimension_scores(t: Tables) -> DataFrame:
    found = facets.dimension_scores(t.pq, adapters.PQ_DIMENSIONS)
    return found.select(*[F.col(c).cast("double").alias(c) for c in found.columns])


@query("pq_score_tiers", "pq", """
SELECT id, CAST(doc_id % 101 AS DOUBLE) AS score, CASE WHEN doc_id % 101 >= 80 THEN 'excellent' WHEN doc_id % 101 >= 60 THEN 'good' WHEN doc_id % 101 >= 40 THEN 'fair' ELSE 'poor' END AS tier FROM pq WHERE kind IN ('full', 'legacy')""")
def pq_score_tiers(t: Tables) -> DataFrame:
    score = facets.quality_score(F.col("metadata"))
    return t.pq.select("id", score.alias("score")).filter("score IS NOT NULL").withColumn("tier", costs.score_tier(F.col("score")))


for _name, _column in (("outcome_distribution", "outcome_satisfaction"), ("workflow_distribution", "workflow_pattern")):
    query(_name, "facets", f"SELECT {_column} AS value, count(*) AS count FROM facets WHERE {_column} IS NOT NULL GROUP BY 1")(lambda t, c=_column: facets.distribution(t.facets, c))


@query("character_distribution", "sessions live", "SELECT session_character AS value, count(*) AS count FROM live WHERE session_character IS NOT NULL GROUP BY 1")
def character_distribution(t: Tables) -> DataFrame:
    return facets.distribution(t.live, "session_character")


@query("facet_sessions", "sessions live facets", """
SELECT source_tool, count(*) AS analysed, count(*) FILTER (had_course_correction) AS corrected, CAST(sum(iteration_count) AS BIGINT) AS iterations FROM live JOIN facets ON live.id = facets.session_id GROUP BY source_tool""")
def facet_sessions(t: Tables) -> DataFrame:
    rows = t.live.join(t.facets.withColumnRenamed("session_id", "id"), "id")
    return rows.groupBy("source_tool").agg(F.count(F.lit(1)).alias("analysed"), F.count_if("had_course_correction").alias("corrected"), F.sum("iteration_count").cast("long").alias("iterations"))


@query("missing_facets", "sessions live insights facets", "SELECT DISTINCT id FROM live WHERE id IN (SELECT session_id FROM insights) AND id NOT IN (SELECT session_id FROM facets)")
def missing_facets(t: Tables) -> DataFrame:
    return facets.missing_facets(t.live, t.insights, t.facets)


@query("missing_pq", "sessions live insights pq", "SELECT DISTINCT id FROM live WHERE id IN (SELECT session_id FROM insights) AND id NOT IN (SELECT session_id FROM pq)")
def missing_pq(t: Tables) -> DataFrame:
    return facets.missing_facets(t.live, t.insights, t.pq)


@query("outdated_facets", "facets", "SELECT DISTINCT session_id FROM (SELECT session_id FROM patterns WHERE driver IS NULL UNION SELECT session_id FROM friction WHERE attribution IS NULL)")
def outdated_facets(t: Tables) -> DataFrame:
    return facets.outdated_facets(t.facets)


@query("outdated_pq", "pq", "SELECT id FROM pq WHERE kind = 'legacy'")
def outdated_pq(t: Tables) -> DataFrame:
    return facets.outdated_quality(t.pq).select("id")


@query("facet_coverage", "sessions live facets", "SELECT count(*) AS sessions, count(*) FILTER (id IN (SELECT session_id FROM facets)) AS analysed, count(*) FILTER (id IN (SELECT session_id FROM facets)) * 2 < count(*) AS warn FROM live")
def facet_coverage(t: Tables) -> DataFrame:
    return quality.coverage(t.live, t.facets)


@query("category_labels", "facets", f"+ {_FRICTION} SELECT DISTINCT category AS raw, name AS category, {LABEL.format('name')} AS label FROM named")
def category_labels(t: Tables) -> DataFrame:
    rows = facets.friction_points(t.facets).select(F.col("category").alias("raw")).distinct()
    rows = rows.withColumn("category", categories.normalize_category(F.col("raw"), categories.FRICTION))
    return rows.withColumn("label", categories.category_label(F.col("category"), categories.FRICTION))


# --- lists, search and paging -------------------------------------------------------------------------------

_ASKED = "50%_A\\B 1"


@query("session_search", "sessions live", f"""
SELECT id, {sql_time("started_at")}, coalesce(nullif(custom_title, ''), nullif(generated_title, ''), nullif(summary, ''), 'Untitled Session') AS title, 'summary' AS match_field, summary AS snippet FROM live WHERE contains(lower(summary), '{_ASKED.lower()}')""")
def session_search(t: Tables) -> DataFrame:
    return scope.search_sessions(t.sessions, _ASKED).withColumn("started_at", when_text("started_at"))


@query("insight_search", "sessions live insights", f"""+
hits AS (SELECT id, timestamp, contains(lower(title), 'ing th') AS in_title, CASE WHEN contains(lower(title), 'ing th') THEN title ELSE content END AS v FROM insights
  WHERE (contains(lower(title), 'ing th') OR contains(lower(content), 'ing th')) AND session_id IN (SELECT id FROM live)),
cut AS (SELECT *, greatest(0, instr(lower(v), 'ing th') - 61) AS a, least(length(v), greatest(0, instr(lower(v), 'ing th') - 61) + 120) AS b FROM hits)
SELECT id, {sql_time("timestamp")}, CASE WHEN in_title THEN 'title' ELSE 'content' END AS match_field, CASE WHEN a > 0 THEN '...' ELSE '' END || substring(v, a + 1, b - a) || CASE WHEN b < length(v) THEN '...' ELSE '' END AS snippet FROM cut""")
def insight_search(t: Tables) -> DataFrame:
    return scope.search_insights(t.insights, t.sessions, "ing TH").withColumn("timestamp", when_text("timestamp"))


@query("session_page", "sessions live", f"SELECT id, {sql_time('started_at')} FROM live ORDER BY live.started_at DESC, id LIMIT 50 OFFSET 100")
def session_page(t: Tables) -> DataFrame:
    return scope.page(t.live, F.desc("started_at"), F.asc("id"), offset=100).select("id", when_text("started_at"))


@query("session_list", "sessions live", """
SELECT id FROM live WHERE started_at >= TIMESTAMP '1995-01-01' AND started_at < TIMESTAMP '1996-01-15'
  AND (contains(lower(custom_title), 'custom 1') OR contains(lower(generated_title), 'custom 1') OR contains(lower(summary), 'custom 1') OR contains(lower(project_name), 'custom 1'))""")
def session_list(t: Tables) -> DataFrame:
    return scope.session_list(t.sessions, "CUSTOM 1", "1995-01-01", "1996-01-15").select("id")


@query("insight_page", "insights", f"SELECT id, type, {sql_time('timestamp')} FROM insights WHERE type = 'decision' ORDER BY insights.timestamp DESC, id LIMIT 40 OFFSET 5")
def insight_page(t: Tables) -> DataFrame:
    return scope.page(t.insights.filter("type = 'decision'"), F.desc("timestamp"), F.asc("id"), limit=40, offset=5).select("id", "type", when_text("timestamp"))


@query("depth_capped_insights", "insights", "SELECT id, confidence FROM insights ORDER BY confidence DESC, timestamp DESC, id LIMIT 80")
def depth_capped_insights(t: Tables) -> DataFrame:
    return activity.depth_capped(t.insights, "standard").select("id", "confidence")


@query("budgeted_insights", "insights", "SELECT project_id, id, r * 300 AS spent FROM (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY confidence DESC, timestamp DESC, id) AS r FROM insights) WHERE r * 300 <= 6000")
def budgeted_insights(t: Tables) -> DataFrame:
    return activity.budgeted(t.insights, "project_id", budget=6000).select("project_id", "id", F.col("spent").cast("long").alias("spent"))


@query("deduplicated_titles", "insights", """
SELECT id FROM (SELECT id, type, row_number() OVER (PARTITION BY session_id, type ORDER BY timestamp, id) AS r
  FROM (SELECT * FROM insights QUALIFY row_number() OVER (PARTITION BY session_id, type, lower(trim(title)) ORDER BY timestamp, id) = 1))
WHERE type NOT IN ('decision', 'learning') OR (type = 'decision' AND r <= 3) OR (type = 'learning' AND r <= 5)""")
def deduplicated_titles(t: Tables) -> DataFrame:
    return activity.deduplicated_titles(t.insights, {"decision": 3, "learning": 5}).select("id")


@query("similar_names", "", """
SELECT CAST(c_custkey AS VARCHAR) AS project_id, c_name AS project_name, CASE WHEN lower(c_name) = 'customer#000000012' THEN 0 WHEN contains(lower(c_name), 'customer#000000012') THEN 1 ELSE 2 END AS rank,
  levenshtein(lower(c_name), 'customer#000000012') AS distance FROM customer WHERE contains(lower(c_name), 'customer#000000012') OR levenshtein(lower(c_name), 'customer#000000012') <= 1""")
def similar_names(t: Tables) -> DataFrame:
    names = adapters.table(t.spark, t.sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("project_id"), F.col("c_name").alias("project_name"))
    found = scope.resolve_project(names, "Customer#000000012", most=1)
    return found.select("project_id", "project_name", F.col("rank").cast("long").alias("rank"), F.col("distance").cast("long").alias("distance"))


@query("ordered_lookup", "sessions live", "SELECT id, position, project_name FROM live JOIN (VALUES ('7', 0), ('1', 1), ('999999999', 2), ('3', 3)) v(k, position) ON id = k")
def ordered_lookup(t: Tables) -> DataFrame:
    return scope.ordered_lookup(t.live, ["7", "1", "999999999", "3"]).select("id", "position", "project_name")


@query("session_context", "sessions live", """
SELECT count(*) AS sessions, count(DISTINCT project_id) AS projects, strftime(min(started_at)::TIMESTAMP, '%Y-%m-%d') AS first, strftime(max(ended_at)::TIMESTAMP, '%Y-%m-%d') AS last, arg_max(project_name, (ended_at, id)) AS project_name FROM live""")
def session_context(t: Tables) -> DataFrame:
    return activity.session_context(t.live)


@query("dominant_tool", "sessions live", "SELECT source_tool, count(*) AS sessions FROM live GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def dominant_tool(t: Tables) -> DataFrame:
    return t.live.groupBy("source_tool").agg(F.count(F.lit(1)).alias("sessions")).orderBy(F.desc("sessions"), "source_tool").limit(1)


# --- activity -----------------------------------------------------------------------------------------------


@query("daily_activity_merge", "events insights", """
SELECT day, CAST(sum(s) AS BIGINT) AS sessions, CAST(sum(i) AS BIGINT) AS insights
FROM (SELECT strftime(started_at, '%Y-%m-%d') AS day, 1 AS s, 0 AS i FROM ev UNION ALL SELECT strftime(timestamp, '%Y-%m-%d'), 0, 1 FROM insights) GROUP BY day""")
def daily_activity_merge(t: Tables) -> DataFrame:
    return activity.daily_activity(t.events, t.insights)


@query("insight_type_counts", "insights", "SELECT CASE WHEN type = 'technique' THEN 'learning' ELSE type END AS type, count(*) AS count FROM insights GROUP BY 1")
def insight_type_counts(t: Tables) -> DataFrame:
    return activity.insight_type_counts(t.insights)


@query("project_insight_pivot", "insights", """
SELECT project_id, count(*) AS insights, count(*) FILTER (type = 'summary') AS summary, count(*) FILTER (type = 'decision') AS decision, count(*) FILTER (type IN ('learning', 'technique')) AS learning FROM insights GROUP BY 1""")
def project_insight_pivot(t: Tables) -> DataFrame:
    return activity.project_pivot(t.insights, ["summary", "decision", "learning"])


@query("activity_feed", "events insights", f"""
SELECT kind, id, {sql_time("happened")} FROM (SELECT 'session' AS kind, id, started_at AS happened FROM ev UNION ALL SELECT 'insight', id, timestamp FROM insights ORDER BY happened DESC, kind, id LIMIT 7)""")
def activity_feed(t: Tables) -> DataFrame:
    return activity.activity_feed(t.events, t.insights).withColumn("happened", when_text("happened"))


@query("journal_weeks", "insights", "SELECT strftime(date_trunc('week', timestamp), '%Y-%m-%d') AS week, count(*) AS insights, count(DISTINCT session_id) AS sessions FROM insights GROUP BY 1")
def journal_weeks(t: Tables) -> DataFrame:
    return activity.journal_weeks(t.insights)


@query("week_inventory", "sessions live facets", """
SELECT strftime(d, '%G-W%V') AS week, coalesce(n, 0) AS sessions, coalesce(a, 0) AS analysed FROM generate_series(TIMESTAMP '2001-07-30' - INTERVAL 3633 DAY, TIMESTAMP '2001-07-30', INTERVAL 7 DAY) g(d)
LEFT JOIN (SELECT date_trunc('week', started_at::TIMESTAMP) AS w, count(*) AS n, count(*) FILTER (id IN (SELECT session_id FROM facets)) AS a FROM live GROUP BY 1) ON w = d""")
def week_inventory(t: Tables) -> DataFrame:
    return activity.week_inventory(t.live, t.facets, "2001-07-30", 520)


# --- conversations ------------------------------------------------------------------------------------------

_COMMAND = """split_part(trim(coalesce(nullif(regexp_extract(content, '<command-name>(/[^<]+)</command-name>', 1), ''), CASE WHEN regexp_matches(trim(content), '^/[a-z]') AND len(string_split(trim(content), chr(10))) <= 2 THEN trim(content) END)), ' ', 1)"""
_CLASS = f"""CASE WHEN type = 'user' THEN CASE WHEN starts_with(content, '[') AND contains(content, '"tool_result"') THEN 'tool-result' WHEN starts_with(content, '<task-notification>') THEN 'task-notification'
    WHEN starts_with(content, 'Base directory for this skill:') THEN 'skill-load' WHEN starts_with(content, 'This session is being continued') OR starts_with(content, 'Here is a summary of our conversation') THEN 'auto-compact'
    WHEN {_COMMAND} = '/compact' THEN 'user-compact' WHEN {_COMMAND} IN ('/exit', '/quit') THEN 'exit-command' WHEN {_COMMAND} IS NOT NULL THEN 'slash-command'
    WHEN starts_with(content, '<local-command-caveat>') OR starts_with(content, '<local-command-stdout>') THEN 'command-frame' ELSE 'human' END END"""


@query("message_labels", "messages", f"""+
classed AS (SELECT id, session_id, timestamp, position, type, {_CLASS} AS class FROM messages)
SELECT id, class, CASE WHEN class = 'human' THEN 'User#' || (count(*) FILTER (class = 'human') OVER so_far - 1) WHEN type = 'assistant' THEN 'Assistant#' || (count(*) FILTER (type = 'assistant') OVER so_far - 1)
  WHEN class = 'tool-result' THEN '[tool-result]' WHEN class = 'auto-compact' THEN '[auto-compact]' WHEN type = 'user' THEN '[system]' ELSE 'System' END AS label
FROM classed WINDOW so_far AS (PARTITION BY session_id ORDER BY timestamp, position ROWS UNBOUNDED PRECEDING)""")
def message_labels(t: Tables) -> DataFrame:
    return activity.labelled_messages(t.messages).select("id", "class", "label")


@query("slash_commands", "messages", f"SELECT {_COMMAND} AS command, count(*) AS count FROM messages WHERE type = 'user' AND {_COMMAND} IS NOT NULL GROUP BY 1")
def slash_commands(t: Tables) -> DataFrame:
    command = texts.slash_command(F.col("content"))
    return t.messages.filter("type = 'user'").groupBy(command.alias("command")).agg(F.count(F.lit(1)).alias("count")).filter("command IS NOT NULL")


@query("hour_breaks", "messages", """
SELECT id, coalesce(type <> lag(type) OVER w, true) AS author_change, coalesce(date_trunc('hour', timestamp) <> lag(date_trunc('hour', timestamp)) OVER w, true) AS hour_change
FROM messages WINDOW w AS (PARTITION BY session_id ORDER BY timestamp, position)""")
def hour_breaks(t: Tables) -> DataFrame:
    return activity.hour_breaks(t.messages)


@query("transcripts", "messages", f"""+
classed AS (SELECT id, session_id, timestamp, position, type, content, {_CLASS} AS class FROM messages),
labelled AS (SELECT *, CASE WHEN class = 'human' THEN 'User#' || (count(*) FILTER (class = 'human') OVER so_far - 1) WHEN type = 'assistant' THEN 'Assistant#' || (count(*) FILTER (type = 'assistant') OVER so_far - 1)
  WHEN class = 'tool-result' THEN '[tool-result]' WHEN class = 'auto-compact' THEN '[auto-compact]' WHEN type = 'user' THEN '[system]' ELSE 'System' END AS label
FROM classed WINDOW so_far AS (PARTITION BY session_id ORDER BY timestamp, position ROWS UNBOUNDED PRECEDING))
SELECT session_id, string_agg('### ' || label || ':' || chr(10) || content || CASE WHEN type = 'assistant' AND content <> '' THEN chr(10) || '[Thinking: ' || left(repeat(content, 5), 1000) || ']' ELSE '' END
  || coalesce(chr(10) || '[Tools used: ' || CASE k % 6 WHEN 1 THEN 'Write' WHEN 2 THEN 'Read, Grep' WHEN 3 THEN CASE WHEN position < 2 THEN 'Edit' END WHEN 4 THEN 'Edit, Edit, Edit, Edit' WHEN 5 THEN CASE WHEN position = 0 THEN 'Edit' END END || ']', '')
  || CASE WHEN position % 2 = 1 THEN chr(10) || '[Tool results: ' || left(content || content, 500) || ' | ]' ELSE '' END, chr(10) || chr(10) ORDER BY timestamp, position) AS text FROM (SELECT *, CAST(session_id AS BIGINT) AS k FROM labelled) GROUP BY 1""")
def transcripts(t: Tables) -> DataFrame:
    out = lambda text: F.struct(F.lit("c").alias("id"), text.alias("output"))
    results = F.when(F.col("position") % 2 == 1, F.array(out(F.concat("content", "content")), out(F.lit(None).cast("string")))).otherwise(F.array().cast("array<struct<id:string,output:string>>"))
    return activity.transcript(t.messages.withColumn("thinking", F.when(F.col("type") == "assistant", F.repeat("content", 5))).withColumn("tool_results", results))


@query("language_votes", "messages", rf"""
SELECT session_id, count(*) FILTER (h AND regexp_matches(content, '\p{{Han}}')) AS han, count(*) FILTER (h AND NOT regexp_matches(content, '\p{{Han}}') AND regexp_matches(content, '\p{{L}}')) AS other,
  CASE WHEN count(*) FILTER (h AND regexp_matches(content, '\p{{Han}}')) > count(*) FILTER (h AND NOT regexp_matches(content, '\p{{Han}}') AND regexp_matches(content, '\p{{L}}')) THEN 'zh-CN' ELSE 'en-US' END AS language
FROM (SELECT session_id, content, coalesce({_CLASS} = 'human', false) AS h FROM messages) GROUP BY 1""")
def language_votes(t: Tables) -> DataFrame:
    return activity.language_votes(t.messages)


def sql_text(pattern: str) -> str:
    """A pattern of functions or operators as a literal of SQL."""
    return "'" + pattern.replace("'", "''") + "'"


#: Titles in SQL, of a text in place of {0} and, for the score, its number of words in n; the patterns are the marked ones of functions.texts.
SQL_CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, " + sql_text(texts.TITLE_OPENINGS[0]) + ", ''), " + sql_text(texts.TITLE_OPENINGS[1]) + ", ''), '[*_`#]', '', 'g'), '\\s+', ' ', 'g'))"
SQL_TITLE = "(SELECT upper(left(k, 1)) || substring(k, 2) FROM (SELECT CASE WHEN length(k) > 60 THEN left(k, 57) || '...' ELSE k END AS k FROM (SELECT " + SQL_CLEAN + " AS k)))"
SQL_SCORE = (
    "CASE WHEN n < 3 OR n > 100 THEN 0 WHEN regexp_matches({0}, " + sql_text(texts.ACTION_VERBS) + ") THEN CASE WHEN n BETWEEN 5 AND 15 THEN 80 WHEN n BETWEEN 16 AND 30 THEN 70 ELSE 60 END"
    " WHEN contains({0}, '?') THEN CASE WHEN n BETWEEN 5 AND 20 THEN 70 ELSE 50 END ELSE CASE WHEN n BETWEEN 5 AND 15 THEN 60 WHEN n BETWEEN 16 AND 50 THEN 40 ELSE 20 END END"
)


@query("title_scores", "messages", f"""+
counted AS (SELECT id, content, len(regexp_split_to_array(content, '\\s+')) AS n FROM messages WHERE type = 'user')
SELECT id, CAST({SQL_SCORE.format("content")} AS BIGINT) AS score FROM counted""")
def title_scores(t: Tables) -> DataFrame:
    return t.messages.filter("type = 'user'").select("id", texts.title_score(F.col("content")).cast("long").alias("score"))


@query("clean_titles", "messages", f"SELECT id, {SQL_TITLE.format('content')} AS title FROM messages WHERE type = 'user'")
def clean_titles(t: Tables) -> DataFrame:
    return t.messages.filter("type = 'user'").select("id", texts.clean_title(F.col("content")).alias("title"))


@query("session_characters", "messages", """+
per AS (SELECT session_id, conv_id % 6 AS kind, count(*) AS message_count, count(*) FILTER (type = 'user' AND contains(content, '?')) AS questions,
    bool_or(regexp_matches(content, '(?i)error|bug|fix|issue|broken|fail')) AS has_error, bool_or(regexp_matches(content, '(?i)fixed|resolved|working now')) AS has_fix,
    count(DISTINCT turn) AS turns, count(*) FILTER (turn < 2) AS early, count(*) FILTER (turn = 0) AS at_start FROM messages GROUP BY 1, 2),
  counted AS (SELECT *, CASE kind WHEN 1 THEN message_count WHEN 3 THEN early WHEN 4 THEN 4 * message_count WHEN 5 THEN at_start ELSE 0 END AS edits,
    CASE kind WHEN 1 THEN turns WHEN 3 THEN least(early, 1) WHEN 4 THEN turns WHEN 5 THEN at_start ELSE 0 END AS files_edited, CASE WHEN kind = 1 THEN turns ELSE 0 END AS files_created,
    CASE WHEN kind = 2 THEN 2 * message_count ELSE 0 END AS reads FROM per)
SELECT session_id, message_count, questions, CASE WHEN message_count >= 50 AND files_edited BETWEEN 1 AND 3 THEN 'deep_focus' WHEN has_error AND has_fix AND edits > 0 THEN 'bug_hunt'
  WHEN files_created >= 3 THEN 'feature_build' WHEN reads > 3 * edits AND edits < 5 THEN 'exploration' WHEN edits > 10 AND files_created = 0 THEN 'refactor'
  WHEN questions >= 3 AND edits + reads < message_count THEN 'learning' WHEN message_count < 10 AND edits > 0 THEN 'quick_task' END AS character FROM counted""")
def session_characters(t: Tables) -> DataFrame:
    found = activity.character_features(t.messages)
    return found.select("session_id", "message_count", "questions", activity.session_character(found).alias("character"))


@query("input_hashes", "messages", """
SELECT session_id, sha256(string_agg(sha256(to_json({'id': id, 'type': type, 'content': content})::VARCHAR), ',' ORDER BY timestamp, position)) AS hash FROM messages GROUP BY 1""")
def input_hashes(t: Tables) -> DataFrame:
    return state.input_hash(t.messages)


# --- queue, usage and state ---------------------------------------------------------------------------------


@query("queue_counts", "queue", """
SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, max(error_message) AS last_error FROM queue""")
def queue_counts(t: Tables) -> DataFrame:
    return state.queue_counts(t.queue)


@query("next_wake", "queue", """
SELECT strftime(min(due)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS wake_at FROM (SELECT coalesce(retry_after, enqueued_at) AS due FROM queue WHERE status = 'pending' UNION ALL SELECT started_at + INTERVAL 10 MINUTE FROM queue WHERE status = 'processing')""")
def next_wake(t: Tables) -> DataFrame:
    return state.next_wake(t.queue).select(when_text("wake_at"))


@query("claim_next", "queue", "SELECT session_id, seq FROM queue WHERE status = 'pending' AND (retry_after IS NULL OR retry_after <= TIMESTAMP '1996-06-01') ORDER BY enqueued_at, seq LIMIT 20")
def claim_next(t: Tables) -> DataFrame:
    return state.next_claims(t.queue, datetime(1996, 6, 1), 20).select("session_id", "seq")


_QUEUE = ("session_id", "status", "attempt_count")


@query("fail_backoff", "queue", """
SELECT session_id, CASE WHEN h AND (rerun_requested OR attempt_count + 1 < max_attempts) THEN 'pending' WHEN h THEN 'failed' ELSE status END AS status, CASE WHEN h AND rerun_requested THEN 0 ELSE attempt_count + CAST(h AS BIGINT) END AS attempt_count,
  CASE WHEN h AND rerun_requested THEN NULL WHEN h THEN 'key [REDACTED] refused' ELSE error_message END AS error_message,
  strftime(CASE WHEN NOT h THEN retry_after WHEN NOT rerun_requested AND attempt_count + 1 < max_attempts THEN TIMESTAMP '2001-08-02' + to_seconds(([30, 60, 120, 240, 480])[least(attempt_count + 1, 5)]) END, '%Y-%m-%d %H:%M:%S') AS retry_after
FROM (SELECT *, status = 'processing' AND seq % 4 = 1 AS h FROM queue)""")
def fail_backoff(t: Tables) -> DataFrame:
    ids = t.queue.filter("seq % 4 = 1").select("session_id")
    return state.fail(t.queue, ids, "key sk-abc.123 refused", ORDERS_NOW).select(*_QUEUE, "error_message", when_text("retry_after"))


@query("complete_items", "queue", """
SELECT session_id, CASE WHEN h AND rerun_requested THEN 'pending' WHEN h THEN 'completed' ELSE status END AS status, CASE WHEN h AND rerun_requested THEN 0 ELSE attempt_count END AS attempt_count,
  strftime(CASE WHEN h AND rerun_requested THEN TIMESTAMP '2001-08-02' ELSE enqueued_at::TIMESTAMP END, '%Y-%m-%d %H:%M:%S') AS enqueued_at FROM (SELECT *, status = 'processing' AND seq % 4 = 1 AS h FROM queue)""")
def complete_items(t: Tables) -> DataFrame:
    return state.complete(t.queue, t.queue.filter("seq % 4 = 1").select("session_id"), ORDERS_NOW).select(*_QUEUE, when_text("enqueued_at"))


@query("reset_stale", "queue", """
SELECT session_id, CASE WHEN h AND (rerun_requested OR attempt_count + 1 < max_attempts) THEN 'pending' WHEN h THEN 'failed' ELSE status END AS status, CASE WHEN h AND rerun_requested THEN 0 ELSE attempt_count + CAST(h AS BIGINT) END AS attempt_count,
  strftime(CASE WHEN NOT h THEN retry_after WHEN NOT rerun_requested AND attempt_count + 1 < max_attempts THEN TIMESTAMP '1996-06-01' + to_seconds(([30, 60, 120, 240, 480])[least(attempt_count + 1, 5)]) END, '%Y-%m-%d %H:%M:%S') AS retry_after,
  CASE WHEN h AND rerun_requested THEN NULL WHEN h THEN 'Worker stopped before analysis completed' ELSE error_message END AS error_message
FROM (SELECT *, coalesce(status = 'processing' AND (started_at IS NULL OR started_at <= TIMESTAMP '1996-06-01' - INTERVAL 10 MINUTE), false) AS h FROM queue)""")
def reset_stale(t: Tables) -> DataFrame:
    return state.reset_stale(t.queue, datetime(1996, 6, 1)).select(*_QUEUE, when_text("retry_after"), "error_message")


@query("pruned_queue", "queue", "SELECT session_id, status, attempt_count FROM queue WHERE NOT (status IN ('completed', 'failed') AND enqueued_at <= TIMESTAMP '1996-06-01' - INTERVAL 7 DAY)")
def pruned_queue(t: Tables) -> DataFrame:
    return state.prune_finished(t.queue, datetime(1996, 6, 1)).select(*_QUEUE)


@query("retry_failed", "queue", "SELECT session_id, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'failed' THEN 0 ELSE attempt_count END AS attempt_count FROM queue")
def retry_failed(t: Tables) -> DataFrame:
    return state.retry_failed(t.queue).select(*_QUEUE)


@query("enqueue", "queue", """
SELECT coalesce(q.session_id, v.k) AS session_id, CASE WHEN v.k IS NOT NULL AND coalesce(status, '') <> 'processing' THEN 'pending' ELSE status END AS status,
  CASE WHEN v.k IS NOT NULL AND coalesce(status, '') <> 'processing' THEN 0 ELSE attempt_count END AS attempt_count, CASE WHEN v.k IS NULL THEN rerun_requested ELSE coalesce(status, '') = 'processing' END AS rerun_requested
FROM queue q FULL JOIN (VALUES ('1'), ('2'), ('3'), ('7'), ('32'), ('new')) v(k) ON v.k = q.session_id""")
def enqueue(t: Tables) -> DataFrame:
    return state.enqueue(t.queue, ["1", "2", "3", "7", "32", "new", "1"], ORDERS_NOW).select(*_QUEUE, "rerun_requested")


@query("error_histogram", "queue", """
SELECT CASE WHEN contains(error_message, '429') AND contains(error_message, 'rate limit') THEN 'RATE_LIMIT' WHEN contains(error_message, 'Unauthorized') OR contains(error_message, 'missing the API key') THEN 'AUTHENTICATION'
  WHEN contains(error_message, 'input revision') THEN 'INPUT_CHANGED' WHEN contains(error_message, 'no_json_found') THEN 'INVALID_MODEL_OUTPUT' ELSE 'ANALYSIS_FAILED' END AS code, count(*) AS count
FROM queue WHERE error_message IS NOT NULL GROUP BY 1""")
def error_histogram(t: Tables) -> DataFrame:
    return quality.error_histogram(t.queue)


@query("batch_progress", "queue", """
SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'failed') AS failed,
  count(*) - count(*) FILTER (status IN ('pending', 'processing', 'failed')) AS completed
FROM (SELECT CAST(o_orderkey AS VARCHAR) AS k FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT 'gone') b LEFT JOIN queue ON session_id = k""")
def batch_progress(t: Tables) -> DataFrame:
    ids = t.queue.filter("seq % 50 = 0").select("session_id").union(t.spark.sql("SELECT 'gone'"))
    return quality.batch_progress(t.queue, ids)


@query("quality_checks", "sessions queue", """
SELECT 'missing_time' AS "check", count(*) AS count FROM sessions WHERE started_at IS NULL UNION ALL SELECT 'unknown_tool', count(*) FROM sessions WHERE source_tool NOT IN ('ASIA', 'EUROPE')
UNION ALL SELECT 'orphan_queue', count(*) FROM queue WHERE session_id NOT IN (SELECT id FROM sessions WHERE deleted_at IS NULL)
UNION ALL SELECT 'stuck_queue', count(*) FROM queue WHERE status = 'processing' AND started_at < TIMESTAMP '1996-06-01' - INTERVAL 10 MINUTE UNION ALL SELECT 'failed_queue', count(*) FROM queue WHERE status = 'failed'""")
def quality_checks(t: Tables) -> DataFrame:
    found = quality.checks(t.sessions, t.queue, ("ASIA", "EUROPE"), datetime(1996, 6, 1))
    orphans = quality.checks(t.live, t.queue, ("ASIA", "EUROPE"), datetime(1996, 6, 1)).filter("check = 'orphan_queue'")
    return found.filter("check <> 'orphan_queue'").union(orphans)


@query("analysis_freshness", "sessions live usage", """
SELECT session_id FROM (SELECT session_id, input_revision, language, count(DISTINCT analysis_type) AS n FROM usage JOIN live ON live.id = session_id WHERE pipeline_revision = 'v2' AND session_message_count = message_count GROUP BY 1, 2, 3)
GROUP BY 1 HAVING max(n) = 2""")
def analysis_freshness(t: Tables) -> DataFrame:
    return state.fresh_sessions(t.usage, t.live, "v2")


@query("unanalysed_tiers", "sessions live usage", """+
fresh AS (SELECT session_id FROM (SELECT session_id, input_revision, language, count(DISTINCT analysis_type) AS n FROM usage JOIN live ON live.id = session_id WHERE pipeline_revision = 'v2' AND session_message_count = message_count GROUP BY 1, 2, 3) GROUP BY 1 HAVING max(n) = 2)
SELECT CASE WHEN message_count <= 2 THEN 'trivial' WHEN message_count <= 10 THEN 'short' ELSE 'full' END AS tier, count(*) AS sessions FROM live WHERE id NOT IN (SELECT session_id FROM fresh) GROUP BY 1""")
def unanalysed_tiers(t: Tables) -> DataFrame:
    return quality.unanalysed(t.live, analysis_freshness(t))


@query("analysis_candidates", "sessions live messages usage", """+
have AS (SELECT session_id, bool_or(analysis_type = 'session') AS s, bool_or(analysis_type = 'prompt_quality') AS q FROM usage GROUP BY 1)
SELECT id, coalesce(s, false) AS has_session, coalesce(q, false) AS has_quality FROM live LEFT JOIN have ON have.session_id = id WHERE id IN (SELECT session_id FROM messages) AND NOT coalesce(s AND q, false)""")
def analysis_candidates(t: Tables) -> DataFrame:
    return quality.analysis_candidates(t.sessions, t.messages, t.usage).drop("started_at")


@query("usage_totals", "usage", f"""
SELECT provider, count(*) AS passes, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  round(sum(floor(CASE provider WHEN 'anthropic' THEN i * {sql_price("model", 0)} + o * {sql_price("model", 1)} + w * {sql_price("model", 0)} * 1.25::DOUBLE + r * {sql_price("model", 0)} * 0.1::DOUBLE
    WHEN 'openai' THEN i * 2.5::DOUBLE + o * 10.0::DOUBLE + r * 2.5::DOUBLE * 0.5::DOUBLE WHEN 'gemini' THEN i * 1.25::DOUBLE + o * 5.0::DOUBLE ELSE 0 END * 1000000 + 0.5) / 1000000.0::DOUBLE), 2) AS cost,
  round(sum(CASE WHEN provider = 'anthropic' THEN r * {sql_price("model", 0)} * 0.9::DOUBLE ELSE 0 END), 2) AS saved
FROM (SELECT *, input_tokens / 1000000.0::DOUBLE AS i, output_tokens / 1000000.0::DOUBLE AS o, cache_creation_tokens / 1000000.0::DOUBLE AS w, cache_read_tokens / 1000000.0::DOUBLE AS r FROM usage) GROUP BY provider""")
def usage_totals(t: Tables) -> DataFrame:
    return quality.usage_totals(t.usage).withColumn("cost", F.round("cost", 2)).withColumn("saved", F.round("saved", 2))


@query("invalidate_usage", "usage", "SELECT session_id, analysis_type, CASE WHEN CAST(session_id AS BIGINT) % 3 <> 0 THEN session_message_count END AS session_message_count FROM usage")
def invalidate_usage(t: Tables) -> DataFrame:
    return state.invalidate(t.usage, t.usage.filter("CAST(session_id AS BIGINT) % 3 = 0").select("session_id")).select("session_id", "analysis_type", "session_message_count")


@query("snapshot_diff", "queue", """
SELECT session_id AS id, CASE WHEN now = 'failed' AND was IS DISTINCT FROM 'failed' THEN 'new_failure' WHEN was = 'failed' AND now = 'completed' THEN 'recovered' WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT session_id, CASE WHEN seq % 10 <> 0 THEN status END AS was, CASE WHEN seq % 9 = 0 THEN NULL WHEN seq % 4 = 0 THEN 'completed' WHEN seq % 7 = 0 THEN 'failed' ELSE status END AS now FROM queue)
WHERE was IS DISTINCT FROM now""")
def snapshot_diff(t: Tables) -> DataFrame:
    old = t.queue.filter("seq % 10 <> 0").select(F.col("session_id").alias("id"), "status")
    new = t.queue.filter("seq % 9 <> 0").select(F.col("session_id").alias("id"), F.when(F.col("seq") % 4 == 0, "completed").when(F.col("seq") % 7 == 0, "failed").otherwise(F.col("status")).alias("status"))
    return quality.snapshot_diff(old, new)


# --- changes of tables --------------------------------------------------------------------------------------

_NUMBER = "CAST(id AS BIGINT)"


@query("session_upsert", "sessions", """+
a AS (SELECT * FROM sessions WHERE CAST(id AS BIGINT) % 3 <> 0), b AS (SELECT * REPLACE ('New ' || id AS generated_title, 'X' AS custom_title, 'fresh' AS summary, NULL AS deleted_at) FROM sessions WHERE CAST(id AS BIGINT) % 2 = 0)
SELECT coalesce(a.id, b.id) AS id, coalesce(a.generated_title, b.generated_title) AS generated_title, CASE WHEN a.id IS NOT NULL THEN a.custom_title ELSE b.custom_title END AS custom_title,
  CASE WHEN b.id IS NOT NULL THEN b.summary ELSE a.summary END AS summary, a.deleted_at IS NOT NULL AS deleted FROM a FULL JOIN b ON a.id = b.id""")
def session_upsert(t: Tables) -> DataFrame:
    new = t.sessions.filter(f"{_NUMBER} % 2 == 0").withColumns({"generated_title": F.concat(F.lit("New "), "id"), "custom_title": F.lit("X"), "summary": F.lit("fresh"), "deleted_at": F.lit(None).cast("timestamp")})
    merged = state.merge(t.sessions.filter(f"{_NUMBER} % 3 != 0"), new, ["id"], state.SESSION_POLICY)
    return merged.select("id", "generated_title", "custom_title", "summary", F.col("deleted_at").isNotNull().alias("deleted"))


@query("project_upsert", "", """+
WITH p AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey AS k FROM customer) SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NOT NULL THEN 'new' ELSE 'old' END AS name,
  CASE WHEN a.id IS NULL THEN b.k % 100 WHEN b.id IS NULL THEN a.k % 70 ELSE greatest(a.k % 70, b.k % 100) END AS last_activity
FROM (SELECT * FROM p WHERE k % 3 <> 0) a FULL JOIN (SELECT * FROM p WHERE k % 2 = 0) b ON a.id = b.id""".replace("+\nWITH", "WITH"))
def project_upsert(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    base = adapters.table(t.spark, t.sf_dir, "customer")
    side = lambda rows, name, n: rows.select(k.cast("string").alias("id"), F.lit(name).alias("name"), F.pmod(k, F.lit(n)).cast("long").alias("last_activity"))
    return state.merge(side(base.filter(k % 3 != 0), "old", 70), side(base.filter(k % 2 == 0), "new", 100), ["id"], state.PROJECT_POLICY)


@query("message_insert_ignore", "messages", "SELECT id, CASE WHEN position < 4 THEN content ELSE 'new' END AS content FROM messages WHERE position < 4 OR position < 7")
def message_insert_ignore(t: Tables) -> DataFrame:
    new = t.messages.filter("position < 7").withColumn("content", F.lit("new"))
    return state.insert_or_ignore(t.messages.filter("position < 4"), new.union(new), "id", F.col("timestamp")).select("id", "content")


@query("snapshot_replace", "messages", """
SELECT id, session_id, CASE WHEN CAST(session_id AS BIGINT) % 3 = 0 THEN 'again' ELSE content END AS content FROM messages WHERE CAST(session_id AS BIGINT) % 3 <> 0 OR position < 2""")
def snapshot_replace(t: Tables) -> DataFrame:
    new = t.messages.filter("CAST(session_id AS BIGINT) % 3 = 0 AND position < 2").withColumn("content", F.lit("again"))
    return state.replace_snapshot(t.messages, new).select("id", "session_id", "content")


@query("snapshot_changed", "messages", "SELECT DISTINCT session_id, CAST(session_id AS BIGINT) % 2 = 0 AS changed FROM messages WHERE CAST(session_id AS BIGINT) % 3 = 0")
def snapshot_changed(t: Tables) -> DataFrame:
    new = t.messages.filter("CAST(session_id AS BIGINT) % 3 = 0").withColumn("content", F.when(F.col("session_id").cast("long") % 2 == 0, "again").otherwise(F.col("content")))
    return state.snapshot_changed(t.messages, new)


@query("soft_delete", "sessions", "SELECT id, CASE WHEN deleted_at IS NOT NULL THEN strftime(deleted_at::TIMESTAMP, '%Y-%m-%d') WHEN CAST(id AS BIGINT) % 5 = 0 THEN '2001-08-02' END AS deleted FROM sessions")
def soft_delete(t: Tables) -> DataFrame:
    return state.soft_delete(t.sessions, t.sessions.filter(f"{_NUMBER} % 5 == 0"), ORDERS_NOW).select("id", F.date_format("deleted_at", "yyyy-MM-dd").alias("deleted"))


@query("restore_sessions", "sessions", "SELECT id, deleted_at IS NOT NULL AND CAST(id AS BIGINT) % 2 <> 0 AS deleted FROM sessions")
def restore_sessions(t: Tables) -> DataFrame:
    return state.restore(t.sessions, t.sessions.filter(f"{_NUMBER} % 2 == 0")).select("id", F.col("deleted_at").isNotNull().alias("deleted"))


@query("prune_trivial", "sessions", "SELECT id, deleted_at IS NOT NULL OR message_count <= 2 AS deleted FROM sessions")
def prune_trivial(t: Tables) -> DataFrame:
    return state.prune_trivial(t.sessions, ORDERS_NOW).select("id", F.col("deleted_at").isNotNull().alias("deleted"))


@query("rename_session", "sessions", "SELECT id, CASE WHEN id = '33' THEN NULL ELSE custom_title END AS custom_title FROM sessions")
def rename_session(t: Tables) -> DataFrame:
    return state.rename(t.sessions, "33", "  ").select("id", "custom_title")


@query("replace_insights", "insights", """
SELECT id, title FROM insights WHERE NOT (CAST(session_id AS BIGINT) % 4 = 0 AND type IN ('summary', 'decision')) UNION ALL SELECT 'n' || id, 'new' FROM insights WHERE CAST(session_id AS BIGINT) % 4 = 0 AND CAST(id AS BIGINT) % 2 = 0""")
def replace_insights(t: Tables) -> DataFrame:
    new = t.insights.filter("CAST(session_id AS BIGINT) % 4 = 0 AND CAST(id AS BIGINT) % 2 = 0").withColumns({"id": F.concat(F.lit("n"), "id"), "title": F.lit("new")})
    return state.replace_insights(t.insights, new, ["summary", "decision"]).select("id", "title")


@query("apply_titles", "sessions insights", """
SELECT sessions.id, coalesce(generated_title, left(s.title, 120)) AS generated_title FROM sessions LEFT JOIN (SELECT session_id, arg_min(title, (timestamp, id)) AS title FROM insights WHERE type = 'summary' GROUP BY 1) s ON s.session_id = sessions.id""")
def apply_titles(t: Tables) -> DataFrame:
    return state.apply_titles(t.sessions, t.insights).select("id", "generated_title")


@query("move_insights", "sessions insights", "SELECT i.id, coalesce(s.project_id, i.project_id) AS project_id FROM insights i LEFT JOIN sessions s ON s.id = i.session_id")
def move_insights(t: Tables) -> DataFrame:
    return state.move_insights(t.insights, t.sessions).select("id", "project_id")


@query("campaign_items", "sessions messages", """
SELECT id, row_number() OVER (ORDER BY started_at, id) - 1 AS ordinal FROM sessions WHERE deleted_at IS NULL AND started_at::DATE BETWEEN DATE '1993-01-01' AND DATE '1999-12-31' AND id IN (SELECT session_id FROM messages)""")
def campaign_items(t: Tables) -> DataFrame:
    return state.campaign_items(t.sessions, t.messages, "1993-01-01", "1999-12-31").select("id", "ordinal")


@query("next_campaign_items", "queue", """
SELECT session_id AS id, status FROM (SELECT * FROM queue WHERE status IN ('pending', 'failed') AND attempt_count < 3) ORDER BY status = 'failed', seq LIMIT 30""")
def next_campaign_items(t: Tables) -> DataFrame:
    items = t.queue.select(F.col("session_id").alias("id"), F.col("seq").alias("ordinal"), "status", "attempt_count", "max_attempts")
    return state.next_items(items, 30).select("id", "status")


@query("truncated_contents", "insights", """
SELECT id, CASE WHEN length(content) > 100 THEN left(content, 80) || chr(10) || '... [truncated]' ELSE content END AS content FROM insights""")
def truncated_contents(t: Tables) -> DataFrame:
    return t.insights.select("id", texts.truncate_stored(F.col("content"), 100).alias("content"))


# --- names --------------------------------------------------------------------------------------------------


@query("stable_project_id", "", "SELECT c_custkey, left(sha256(CASE WHEN c_custkey % 2 = 0 THEN 'host/' || c_name ELSE c_name END), 16) AS id FROM customer")
def stable_project_id(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return adapters.table(t.spark, t.sf_dir, "customer").select(k, texts.stable_id(F.when(k % 2 == 0, F.concat(F.lit("host/"), "c_name")), F.col("c_name")).alias("id"))


@query("git_url_normalize", "", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN '/srv/' || c_custkey ELSE 'host.org/team/' || c_custkey END AS url FROM customer")
def git_url_normalize(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    url = F.when(k % 4 == 0, F.concat(F.lit("git@host.org:team/"), k, F.lit(".git"))).when(k % 4 == 1, F.concat(F.lit("https://host.org/team/"), k)).when(k % 4 == 2, F.concat(F.lit("ssh://git@host.org/team/"), k, F.lit(".git"))).otherwise(F.concat(F.lit("/srv/"), k))
    return adapters.table(t.spark, t.sf_dir, "customer").select(k, texts.normal_git_url(url).alias("url"))


@query("slugs", "", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, CAST(len(list_filter(regexp_split_to_array(trim(p_name), '\\s+'), lambda x: x <> '')) AS BIGINT) AS words FROM part")
def slugs(t: Tables) -> DataFrame:
    return adapters.table(t.spark, t.sf_dir, "part").select("p_partkey", texts.slug(F.col("p_name")).alias("slug"), texts.word_count(F.col("p_name")).cast("long").alias("words"))


# --- groups -------------------------------------------------------------------------------------------------


def _linked(t: Tables) -> DataFrame:
    """Insights with links: doc d links to two ids that others of its hundred link to as well."""
    d = F.col("doc_id")
    link = F.concat(F.lit('["L'), F.floor(d / 3).cast("string"), F.lit('","M'), F.floor((d + 1) / 3).cast("string"), F.lit('"]'))
    return adapters.table(t.spark, t.sf_dir, "documents").select(d.cast("string").alias("id"), F.col("source").alias("project_id"), adapters.pick(adapters.INSIGHT_TYPES, d).alias("type"), F.when(d % 7 != 0, link).alias("linked_insight_ids"), d.cast("timestamp").alias("timestamp"))


_COMPONENTS = """+
WITH RECURSIVE l AS (SELECT doc_id AS id, unnest(['L' || (doc_id // 3), 'M' || ((doc_id + 1) // 3)]) AS k FROM documents WHERE doc_id % 7 <> 0),
reach AS (SELECT DISTINCT id AS a, id AS b FROM l UNION SELECT reach.a, y.id FROM reach JOIN l x ON x.id = reach.b JOIN l y ON y.k = x.k),
comp AS (SELECT CAST(a AS VARCHAR) AS id, min(CAST(b AS VARCHAR)) AS "group" FROM reach GROUP BY a)
""".replace("+\n", "")


@query("connected_components", "", _COMPONENTS + "SELECT * FROM comp")
def connected_components(t: Tables) -> DataFrame:
    return graph.groups(_linked(t))


@query("group_summary", "", _COMPONENTS + """,
rows AS (SELECT "group", source AS project_id, doc_id, (['summary', 'decision', 'learning', 'technique', 'prompt_quality'])[doc_id % 5 + 1] AS type FROM comp JOIN documents ON id = CAST(doc_id AS VARCHAR)),
kinds AS (SELECT "group", type, row_number() OVER (PARTITION BY "group" ORDER BY count(*) DESC, type) AS r FROM rows GROUP BY 1, 2)
SELECT rows."group", count(*) AS size, count(DISTINCT project_id) AS projects, kinds.type FROM rows JOIN kinds ON kinds."group" = rows."group" AND r = 1 GROUP BY rows."group", kinds.type HAVING count(*) >= 2""")
def group_summary(t: Tables) -> DataFrame:
    rows = _linked(t)
    return graph.group_summary(rows, graph.groups(rows)).drop("latest")


@query("bidirectional_links", "", """
WITH f AS (SELECT DISTINCT doc_id // 4 AS g, CAST(doc_id AS VARCHAR) AS id FROM documents UNION SELECT 1000000000 + doc_id // 6, CAST(doc_id AS VARCHAR) FROM documents)
SELECT g AS "group", id, count(*) OVER (PARTITION BY g) - 1 AS others FROM f QUALIFY others > 0""")
def bidirectional_links(t: Tables) -> DataFrame:
    return graph.linked_groups(_found_groups(t))


@query("links_of_ids", "", """
WITH f AS (SELECT DISTINCT doc_id // 4 AS g, CAST(doc_id AS VARCHAR) AS id FROM documents UNION SELECT 1000000000 + doc_id // 6, CAST(doc_id AS VARCHAR) FROM documents)
SELECT DISTINCT a.id, b.id AS link FROM f a JOIN f b ON a.g = b.g AND a.id <> b.id WHERE a.id IN ('1', '7', '12', 'none')""")
def links_of_ids(t: Tables) -> DataFrame:
    return graph.links_of(t.spark.createDataFrame([("1",), ("7",), ("12",), ("none",)], "id string"), graph.linked_groups(_found_groups(t)))


def _found_groups(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    docs = adapters.table(t.spark, t.sf_dir, "documents")
    return docs.select(F.floor(d / 4).alias("group"), d.cast("string").alias("id")).union(docs.select(F.floor(d / 6) + 1000000000, d.cast("string")))
