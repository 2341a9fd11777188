"""The logical tables of session analytics, projected from the driver's tables: once in Spark, once as SQL.

Each adapter is a lazy DataFrame, so filters and column pruning of a query reach the Parquet scans. The SQL of
the same name is a common table expression for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stand-ins for the present, as the data are of the past.
AS_OF_ORDERS = "2001-08-02 00:00:00"
AS_OF_EVENTS = "2024-01-30 12:00:00"

MODELS = ("claude-opus-4-6", "claude-sonnet-4-5-20250929", "claude-haiku-4-5", "gpt-4o", "claude-3-opus-20240229")
INSIGHT_TYPES = ("summary", "decision", "learning", "technique", "prompt_quality")
#: Raw categories as models write them: canonical, aliased, misspelt, cut, unknown, blank.
FRICTION_RAW = ("wrong-approach", "scope-crep", "api-rate-limit", "throttled-by-api", "race-condition", "Knowledge-Gap", "context-loss-in-session", "novel-thing", "agent-shutdown-failure", "tooling-limitatio", "", "documentation-gap")
PATTERN_RAW = ("structured-planning", "tdd", "context-gatherin", "task-breakdown", "self-correction", "novel-pattern", "schema-first", "systematic-debugging-flow")
PQ_RAW = ("vague-request", "no-context", "late-requirements", "precise-request", "good-context", "scope-drift", "odd-one")
#: Messages of failed analyses, one of each code at least.
ERRORS = ("HTTP 429 rate limit for sk-", "401 Unauthorized: sk-", "missing the API key ", "input revision changed since analysis ", "no_json_found in answer ", "socket closed ")
SEVERITIES = ("high", "medium", "low")
ATTRIBUTIONS = ("user-actionable", "ai-capability", None)
DRIVERS = ("user-driven", "ai-driven", "collaborative", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple, number: Column) -> Column:
    """values[number mod n]."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def _sql_pick(values: tuple, number: str) -> str:
    listed = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"([{listed}])[(({number}) % {len(values)}) + 1]"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session an order; its messages are the order's lines, so some sessions have none."""
    k = F.col("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("l_linenumber") % 2 == 1).alias("n_user"),
        F.sum(F.col("l_linenumber").cast("long")).alias("n_tools"),
        F.sum(F.col("l_quantity").cast("long")).alias("quantity"),
        F.max("l_shipdate").alias("last"),
    )
    where = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    who = table(spark, sf_dir, "customer").join(where, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = table(spark, sf_dir, "orders").join(who, F.col("o_custkey") == F.col("c_custkey")).join(lines, k == F.col("l_orderkey"), "left")
    zero = F.lit(0).cast("long")
    return rows.select(
        k.cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("project_id"),
        F.col("c_name").alias("project_name"),
        F.col("r_name").alias("source_tool"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"),
        F.coalesce("last", "o_orderdate").cast("timestamp").alias("ended_at"),
        F.coalesce("n", zero).alias("message_count"),
        F.coalesce("n_user", zero).alias("user_message_count"),
        (F.coalesce("n", zero) - F.coalesce("n_user", zero)).alias("assistant_message_count"),
        F.coalesce("n_tools", zero).alias("tool_call_count"),
        (F.col("quantity") * 100).alias("total_input_tokens"),
        (F.col("quantity") * 10).alias("total_output_tokens"),
        (F.col("n_tools") * 50).alias("cache_creation_tokens"),
        (F.col("n_tools") * 200).alias("cache_read_tokens"),
        F.when(F.col("o_orderstatus") != "P", F.floor("o_totalprice") / 10000).alias("estimated_cost_usd"),
        F.when(k % 7 != 0, pick(MODELS, k)).alias("primary_model"),
        F.lower("c_mktsegment").alias("session_character"),
        F.when(k % 11 == 0, F.concat(F.lit("Custom "), k)).when(k % 13 == 0, F.lit("")).alias("custom_title"),
        F.when(k % 3 == 0, F.concat(F.lit("Work on part "), k)).alias("generated_title"),
        F.when(k % 5 == 0, F.concat(F.lit("Summary of 50%_a\\b "), k)).alias("summary"),
        F.when(k % 17 == 0, F.col("o_orderdate").cast("timestamp")).alias("deleted_at"),
    )


SESSIONS_SQL = f"""sessions AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS project_id, c_name AS project_name, r_name AS source_tool,
    o_orderdate AS started_at, COALESCE(last, o_orderdate) AS ended_at, COALESCE(n, 0) AS message_count,
    COALESCE(n_user, 0) AS user_message_count, COALESCE(n, 0) - COALESCE(n_user, 0) AS assistant_message_count,
    COALESCE(n_tools, 0) AS tool_call_count, quantity * 100 AS total_input_tokens, quantity * 10 AS total_output_tokens,
    n_tools * 50 AS cache_creation_tokens, n_tools * 200 AS cache_read_tokens,
    CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice) / 10000 END AS estimated_cost_usd,
    CASE WHEN o_orderkey % 7 <> 0 THEN {_sql_pick(MODELS, "o_orderkey")} END AS primary_model,
    lower(c_mktsegment) AS session_character,
    CASE WHEN o_orderkey % 11 = 0 THEN 'Custom ' || o_orderkey WHEN o_orderkey % 13 = 0 THEN '' END AS custom_title,
    CASE WHEN o_orderkey % 3 = 0 THEN 'Work on part ' || o_orderkey END AS generated_title,
    CASE WHEN o_orderkey % 5 = 0 THEN 'Summary of 50%_a\\b ' || o_orderkey END AS summary,
    CASE WHEN o_orderkey % 17 = 0 THEN o_orderdate END AS deleted_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (l_linenumber % 2 = 1) AS BIGINT) AS n_user,
      CAST(sum(l_linenumber) AS BIGINT) AS n_tools, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS quantity, max(l_shipdate) AS last
    FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short sessions of one month: for streaks and series within days."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.cast("string").alias("id"),
        F.col("user_id").cast("string").alias("project_id"),
        F.col("ts").cast("timestamp").alias("started_at"),
        F.col("event_type").alias("session_character"),
        F.when(e % 4 != 0, F.col("value")).alias("estimated_cost_usd"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.when(e % 19 == 0, F.col("ts").cast("timestamp")).alias("deleted_at"),
    )


EVENTS_SQL = """events_s AS (
  SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS project_id, ts AS started_at, event_type AS session_character,
    CASE WHEN event_id % 4 <> 0 THEN value END AS estimated_cost_usd, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CASE WHEN event_id % 19 = 0 THEN ts END AS deleted_at
  FROM events
)"""


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One insight a document, with its whole text as content; it belongs to a session of the orders. A title is short."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d.cast("string").alias("id"),
        F.floor(d / 2).cast("string").alias("session_id"),
        F.col("source").alias("project_id"),
        pick(INSIGHT_TYPES, d).alias("type"),
        F.substring("text", 1, 60).alias("title"),
        F.col("text").alias("content"),
        (F.pmod(d, F.lit(101)) / 100.0).alias("confidence"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.pmod(d, F.lit(5000)).cast("int"))).alias("timestamp"),
    )


INSIGHTS_SQL = f"""insights AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, CAST(doc_id // 2 AS VARCHAR) AS session_id, source AS project_id,
    {_sql_pick(INSIGHT_TYPES, "doc_id")} AS type, substring(text, 1, 60) AS title, text AS content,
    (doc_id % 101) / 100.0::DOUBLE AS confidence, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 5000 AS INTEGER)) AS timestamp
  FROM documents
)"""


def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a label; nested arrays as JSON text, as they are at rest."""
    d = F.col("doc_id")
    friction = F.transform(F.sequence(F.lit(1), F.pmod(d, F.lit(4)).cast("int") + 1), lambda i: F.struct(
        pick(FRICTION_RAW, d * 7 + i * 5).alias("category"), pick(ATTRIBUTIONS, d + i).alias("attribution"),
        F.concat(F.lit("friction "), d, F.lit("-"), i).alias("description"), pick(SEVERITIES, d + i * 2).alias("severity")))
    friction = F.when(d % 9 != 0, F.to_json(friction))
    patterns = F.transform(F.sequence(F.lit(1), F.pmod(d, F.lit(3)).cast("int") + 1), lambda i: F.struct(
        pick(PATTERN_RAW, d * 3 + i).alias("category"), F.concat(F.lit("pattern "), d, F.lit("-"), i).alias("description"),
        F.pmod(d * 13 + i * 29, F.lit(101)).alias("confidence"), pick(DRIVERS, d + i).alias("driver")))
    return table(spark, sf_dir, "labels").select(
        d.cast("string").alias("session_id"),
        F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, "medium").otherwise("high")).otherwise(F.when(F.col("toxic") == 1, "abandoned").otherwise("low")).alias("outcome_satisfaction"),
        F.when(d % 5 != 0, F.concat(F.lit("workflow-"), F.pmod(d, F.lit(3)))).alias("workflow_pattern"),
        (d % 3 == 0).alias("had_course_correction"),
        F.pmod(d, F.lit(5)).alias("iteration_count"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.pmod(d, F.lit(5000)).cast("int"))).alias("extracted_at"),
        friction.alias("friction_points"),
        F.to_json(patterns).alias("effective_patterns"),
    )


FACETS_SQL = f"""facets AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS session_id,
    CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 THEN 'medium' ELSE 'high' END ELSE CASE WHEN toxic = 1 THEN 'abandoned' ELSE 'low' END END AS outcome_satisfaction,
    CASE WHEN doc_id % 5 <> 0 THEN 'workflow-' || (doc_id % 3) END AS workflow_pattern, doc_id % 3 = 0 AS had_course_correction,
    doc_id % 5 AS iteration_count, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 5000 AS INTEGER)) AS extracted_at
  FROM labels
), friction AS (
  SELECT doc_id, session_id, i, {_sql_pick(FRICTION_RAW, "doc_id * 7 + i * 5")} AS category, {_sql_pick(ATTRIBUTIONS, "doc_id + i")} AS attribution,
    'friction ' || doc_id || '-' || i AS description, {_sql_pick(SEVERITIES, "doc_id + i * 2")} AS severity
  FROM facets, generate_series(1, 4) g(i) WHERE doc_id % 9 <> 0 AND i <= doc_id % 4 + 1
), patterns AS (
  SELECT doc_id, session_id, i, {_sql_pick(PATTERN_RAW, "doc_id * 3 + i")} AS category, 'pattern ' || doc_id || '-' || i AS description,
    (doc_id * 13 + i * 29) % 101 AS confidence, {_sql_pick(DRIVERS, "doc_id + i")} AS driver
  FROM facets, generate_series(1, 3) g(i) WHERE i <= doc_id % 3 + 1
)"""


def prompt_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt-quality insights with their metadata as JSON text: current, legacy, without findings, with null findings, broken."""
    d = F.col("doc_id")
    findings = F.transform(F.sequence(F.lit(1), F.pmod(d, F.lit(3)).cast("int") + 1), lambda i: F.struct(pick(PQ_RAW, d + i * 3).alias("category"), pick(("deficit", "strength"), d + i).alias("type")))
    scores = F.struct(*[F.pmod(d * (3 + 2 * k), F.lit(120)).alias(n) for k, n in enumerate(PQ_DIMENSIONS)])
    full = F.to_json(F.struct(F.pmod(d, F.lit(101)).alias("efficiency_score"), findings.alias("findings"), scores.alias("dimension_scores")))
    legacy = F.to_json(F.struct(F.pmod(d, F.lit(101)).alias("efficiencyScore")))
    kind = F.pmod(F.floor(d / 5), F.lit(5))
    return table(spark, sf_dir, "documents").select(
        d.cast("string").alias("id"), F.floor(d / 2).cast("string").alias("session_id"),
        F.when(kind == 0, legacy).when(kind == 1, F.lit('{"findings":null}')).when((kind == 2) & (d % 2 == 0), F.lit("{broken")).otherwise(full).alias("metadata"),
    )


PQ_DIMENSIONS = ("context_provision", "request_specificity", "scope_management", "information_timing", "correction_quality")

_PQ_KIND = "((doc_id // 5) % 5)"
PROMPT_QUALITY_SQL = f"""pq AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, CAST(doc_id // 2 AS VARCHAR) AS session_id,
    CASE WHEN {_PQ_KIND} = 0 THEN 'legacy' WHEN {_PQ_KIND} = 1 THEN 'null' WHEN {_PQ_KIND} = 2 AND doc_id % 2 = 0 THEN 'broken' ELSE 'full' END AS kind
  FROM documents
), pq_findings AS (
  SELECT doc_id, session_id, {_sql_pick(PQ_RAW, "doc_id + i * 3")} AS category, {_sql_pick(("deficit", "strength"), "doc_id + i")} AS type
  FROM pq, generate_series(1, 3) g(i) WHERE kind = 'full' AND i <= doc_id % 3 + 1
)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations; every tenth text is a protocol frame or a command."""
    c, t = F.col("conv_id"), F.col("turn")
    n = F.pmod(c * 3 + t, F.lit(12))
    text = (
        F.when(n == 0, F.lit("<task-notification>done</task-notification>"))
        .when(n == 2, F.lit("<command-name>/review</command-name> now"))
        .when(n == 4, F.lit("/compact"))
        .when(n == 6, F.lit("This session is being continued from before"))
        .when(n == 8, F.concat(F.lit("fix the failing test in module "), c.cast("string"), F.lit("?")))
        .otherwise(F.col("text"))
    )
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", c.cast("string"), t.cast("string")).alias("id"), c.cast("string").alias("session_id"), t.alias("position"),
        F.col("role").alias("type"), text.alias("content"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), (F.pmod(c, F.lit(1000)) * 60 + t * 25).cast("int"))).alias("timestamp"),
        tool_calls(c, t).alias("tool_calls"),
    )


def tool_calls(c: Column, t: Column) -> Column:
    """Calls of a turn: conversations differ in what they do, so that each character occurs."""
    call = lambda name, path: F.struct(F.lit(name).alias("name"), path.alias("path"))
    kind, none = F.pmod(c, F.lit(6)), F.array().cast("array<struct<name:string,path:string>>")
    file = F.concat(F.lit("f"), t.cast("string"))
    return (
        F.when(kind == 1, F.array(call("Write", file)))
        .when(kind == 2, F.array(call("Read", file), call("Grep", F.lit(None).cast("string"))))
        .when((kind == 3) & (t < 2), F.array(call("Edit", F.lit("one"))))
        .when(kind == 4, F.array(*[call("Edit", file)] * 4))
        .when((kind == 5) & (t == 0), F.array(call("Edit", file)))
        .otherwise(none)
    )


MESSAGES_SQL = """messages AS (
  SELECT conv_id || '-' || turn AS id, CAST(conv_id AS VARCHAR) AS session_id, turn AS position, role AS type,
    CASE (conv_id * 3 + turn) % 12 WHEN 0 THEN '<task-notification>done</task-notification>' WHEN 2 THEN '<command-name>/review</command-name> now'
      WHEN 4 THEN '/compact' WHEN 6 THEN 'This session is being continued from before'
      WHEN 8 THEN 'fix the failing test in module ' || conv_id || '?' ELSE text END AS content,
    TIMESTAMP '2024-01-01' + to_minutes(CAST((conv_id % 1000) * 60 + turn * 25 AS BIGINT)) AS timestamp, conv_id, turn
  FROM conversations
)"""


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis queue rows from orders."""
    k = F.col("o_orderkey")
    start = F.col("o_orderdate").cast("timestamp")
    status = F.when(k % 6 == 0, "failed").when(k % 6 == 1, "processing").when(k % 6 == 2, "completed").otherwise("pending")
    return table(spark, sf_dir, "orders").select(
        k.cast("string").alias("session_id"), k.alias("seq"), status.alias("status"), start.alias("enqueued_at"),
        F.when(status == "processing", start + F.expr("INTERVAL 1 HOUR")).alias("started_at"),
        F.when((status == "pending") & (k % 5 == 0), start + F.expr("INTERVAL 2 DAY")).alias("retry_after"),
        F.pmod(k, F.lit(4)).alias("attempt_count"), F.lit(3).cast("long").alias("max_attempts"),
        F.when(status == "failed", F.concat(pick(ERRORS, F.floor(k / 6)), k)).alias("error_message"), (k % 8 == 1).alias("rerun_requested"),
    )


QUEUE_SQL = f"""queue AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS session_id, o_orderkey AS seq, status, o_orderdate AS enqueued_at,
    CASE WHEN status = 'processing' THEN o_orderdate + INTERVAL 1 HOUR END AS started_at,
    CASE WHEN status = 'pending' AND o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 2 DAY END AS retry_after,
    o_orderkey % 4 AS attempt_count, CAST(3 AS BIGINT) AS max_attempts,
    CASE WHEN status = 'failed' THEN {_sql_pick(ERRORS, "o_orderkey // 6")} || o_orderkey END AS error_message, o_orderkey % 8 = 1 AS rerun_requested
  FROM (SELECT *, CASE o_orderkey % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' ELSE 'pending' END AS status FROM orders)
)"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One or two analysis passes of every session, most of them at the current revision."""
    k = F.col("o_orderkey")
    both = F.explode(F.when(k % 4 == 3, F.array(F.lit("session"))).otherwise(F.array(F.lit("session"), F.lit("prompt_quality"))))
    rows = table(spark, sf_dir, "orders").select(k, both.alias("analysis_type"))
    return rows.select(
        k.cast("string").alias("session_id"), "analysis_type",
        F.when((k % 10 != 0) | (F.col("analysis_type") == "session"), F.pmod(k, F.lit(7))).alias("session_message_count"),
        F.when(k % 6 == 0, "v1").otherwise("v2").alias("pipeline_revision"), F.concat(F.lit("r"), F.pmod(k, F.lit(3))).alias("input_revision"),
        pick(("openai", "anthropic", "ollama", "gemini"), k).alias("provider"), pick(("gpt-4o", "claude-opus-4-6", "llama3.3", "gemini-1.5-pro"), k).alias("model"),
        F.when(k % 2 == 0, "en-US").otherwise("zh-CN").alias("language"),
        (F.pmod(k, F.lit(1000)) * 37).alias("input_tokens"), (F.pmod(k, F.lit(500)) * 11).alias("output_tokens"),
        (F.pmod(k, F.lit(300)) * 5).alias("cache_creation_tokens"), (F.pmod(k, F.lit(900)) * 7).alias("cache_read_tokens"),
    )


USAGE_SQL = f"""usage AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS session_id, analysis_type,
    CASE WHEN o_orderkey % 10 <> 0 OR analysis_type = 'session' THEN o_orderkey % 7 END AS session_message_count,
    CASE WHEN o_orderkey % 6 = 0 THEN 'v1' ELSE 'v2' END AS pipeline_revision, 'r' || (o_orderkey % 3) AS input_revision,
    {_sql_pick(("openai", "anthropic", "ollama", "gemini"), "o_orderkey")} AS provider, {_sql_pick(("gpt-4o", "claude-opus-4-6", "llama3.3", "gemini-1.5-pro"), "o_orderkey")} AS model,
    CASE WHEN o_orderkey % 2 = 0 THEN 'en-US' ELSE 'zh-CN' END AS language, (o_orderkey % 1000) * 37 AS input_tokens,
    (o_orderkey % 500) * 11 AS output_tokens, (o_orderkey % 300) * 5 AS cache_creation_tokens, (o_orderkey % 900) * 7 AS cache_read_tokens
  FROM orders, (VALUES ('session'), ('prompt_quality')) v(analysis_type) WHERE analysis_type = 'session' OR o_orderkey % 4 <> 3
)"""
