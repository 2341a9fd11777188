"""Registered queries over logs of what happened to sessions and campaign items: each line of an order is an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import lifecycles
from tallyspark.plans.adapters import pick, table
from tallyspark.plans.queries import Tables, query, when_text

_START, _UNTIL = "1995-01-01 00:00:00", "1995-01-08 00:24:00"
_QUEUE_KINDS = ("claim", "complete", "fail", "claim", "enqueue", "claim", "retry", "fail", "claim")
#: What happens to an item, line by line, in three ways.
_ITEM_KINDS = (("create", "claim", "stage", "claim", "publish", "retry", "release"), ("create", "claim", "fail", "claim", "release", "claim", "stage"), ("create", "claim", "release", "claim", "stage", "fail", "publish"))


def _listed(values: tuple) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _minutes(c: Column) -> Column:
    return F.lit(_START).cast("timestamp") + F.make_dt_interval(mins=c.cast("int"))


def queue_log(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    kind = F.when(n == 1, "enqueue").otherwise(pick(_QUEUE_KINDS, F.col("l_partkey") + n))
    rows = table(t.spark, t.sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").cast("string").alias("session_id"), _minutes(n * 6 + F.col("l_suppkey") % 6).alias("at"), (F.col("l_partkey") * 10 + n).cast("long").alias("seq"), kind.alias("kind"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("error"))


_RUN = "started + INTERVAL 10 MINUTE"
#: The columns of a row whose run failed at a time, where a condition holds.
_FAILED = """CASE WHEN {c} AND NOT rerun AND n + 1 >= 3 THEN 'failed' WHEN {c} THEN 'pending' ELSE status END AS status, CASE WHEN {c} AND rerun THEN {at} ELSE enq END AS enq,
    CASE WHEN {c} THEN NULL ELSE started END AS started, CASE WHEN {c} AND NOT rerun AND n + 1 < 3 THEN {at} + to_seconds([30, 60, 120][n + 1]) WHEN {c} THEN NULL ELSE retry END AS retry,
    CASE WHEN {c} AND rerun THEN 0 WHEN {c} THEN n + 1 ELSE n END AS n, CASE WHEN {c} AND rerun THEN NULL WHEN {c} THEN {error} ELSE err END AS err, CASE WHEN {c} THEN false ELSE rerun END AS rerun"""
_STALE = _FAILED.format(c=f"(status = 'processing' AND {_RUN} <= {{at}})", at=_RUN, error="'Worker stopped before analysis completed'")


@query("queue_history", "", f"""
WITH RECURSIVE log AS (
    SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 6 + l_suppkey % 6, l_partkey * 10 + l_linenumber) AS i, TIMESTAMP '{_START}' + to_minutes(CAST(l_linenumber * 6 + l_suppkey % 6 AS BIGINT)) AS tm, 'part ' || l_partkey AS error,
      CASE WHEN l_linenumber = 1 THEN 'enqueue' ELSE ({_listed(_QUEUE_KINDS)})[(l_partkey + l_linenumber) % {len(_QUEUE_KINDS)} + 1] END AS kind FROM lineitem),
  fold AS (
    SELECT k, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS TIMESTAMP) AS enq, CAST(NULL AS TIMESTAMP) AS started, CAST(NULL AS TIMESTAMP) AS retry, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS err, false AS rerun
    FROM (SELECT DISTINCT k FROM log)
    UNION ALL
    SELECT k, i, CASE WHEN fresh THEN 'pending' WHEN claim THEN 'processing' WHEN done THEN 'completed' WHEN again THEN 'pending' ELSE status END, CASE WHEN fresh THEN tm ELSE enq END, CASE WHEN fresh THEN NULL WHEN claim THEN tm ELSE started END,
      CASE WHEN fresh OR claim OR again THEN NULL ELSE retry END, CASE WHEN fresh OR again THEN 0 ELSE n END, CASE WHEN fresh OR done OR again THEN NULL ELSE err END, CASE WHEN fresh OR claim THEN false WHEN kind = 'enqueue' THEN true ELSE rerun END
    FROM (
      SELECT *, coalesce(kind = 'enqueue' AND (status IS NULL OR status <> 'processing') OR kind = 'complete' AND status = 'processing' AND rerun, false) AS fresh, coalesce(kind = 'claim' AND status = 'pending' AND (retry IS NULL OR retry <= tm), false) AS claim,
        coalesce(kind = 'complete' AND status = 'processing' AND NOT rerun, false) AS done, coalesce(kind = 'retry' AND status = 'failed', false) AS again
      FROM (
        SELECT k, i, kind, tm, {_FAILED.format(c="(kind = 'fail' AND status = 'processing')", at="tm", error="error")}
        FROM (SELECT f.k, l.i, l.kind, l.tm, l.error, {_STALE.format(at="l.tm")} FROM fold AS f JOIN log AS l ON l.k = f.k AND l.i = f.i + 1)))),
  latest AS (SELECT k, {_STALE.format(at=f"TIMESTAMP '{_UNTIL}'")} FROM (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1))
SELECT CAST(k AS VARCHAR) AS session_id, status, strftime(enq, '%Y-%m-%d %H:%M:%S') AS enqueued_at, strftime(retry, '%Y-%m-%d %H:%M:%S') AS retry_after, n AS attempt_count, err AS error_message
FROM latest WHERE status IS NOT NULL AND NOT (status IN ('completed', 'failed') AND enq + INTERVAL 7 DAY <= TIMESTAMP '{_UNTIL}')""")
def queue_history(t: Tables) -> DataFrame:
    found = lifecycles.queue_state(queue_log(t), F.lit(_UNTIL).cast("timestamp"))
    return found.select("session_id", "status", when_text("enqueued_at"), when_text("retry_after"), "attempt_count", "error_message")


def campaign_logs(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Events of 40 campaigns, and of their items."""
    rows, n = table(t.spark, t.sf_dir, "lineitem"), F.col("l_linenumber")
    campaign = F.col("l_orderkey") % 40
    kind = F.element_at(F.array(*[F.array(*map(F.lit, ks)) for ks in _ITEM_KINDS])[(F.col("l_orderkey") % 3).cast("int")], n.cast("int"))
    items = rows.select(
        campaign.cast("string").alias("campaign_id"), F.col("l_orderkey").cast("string").alias("session_id"), _minutes(n * 20 + F.col("l_suppkey") % 20).alias("at"), (F.col("l_partkey") * 10 + n).cast("long").alias("seq"), kind.alias("kind"),
        F.when(F.col("l_partkey") % 7 == 0, "other").otherwise("one").alias("input_revision"), (F.col("l_suppkey") % 2 == 0).alias("retry_failed"), F.lit("TIMEOUT").alias("error"))
    each = rows.select(campaign.alias("c")).distinct()
    said = F.array(
        F.struct(F.lit(0).alias("minute"), F.lit("create").alias("kind")), F.when(F.col("c") % 4 == 1, F.struct(F.lit(50).alias("minute"), F.lit("pause").alias("kind"))),
        F.when(F.col("c") % 8 == 1, F.struct(F.lit(90).alias("minute"), F.lit("resume").alias("kind"))), F.when(F.col("c") % 5 == 2, F.struct(F.lit(120).alias("minute"), F.lit("cancel").alias("kind"))),
        F.when(F.col("c") % 10 == 2, F.struct(F.lit(125).alias("minute"), F.lit("resume").alias("kind"))))
    campaigns = each.select(F.col("c").cast("string").alias("campaign_id"), F.explode(F.filter(said, lambda x: x.isNotNull())).alias("x")).select("campaign_id", _minutes(F.col("x.minute")).alias("at"), F.col("x.minute").cast("long").alias("seq"), "x.kind")
    return campaigns, items


_HELD = "claimed IS NOT NULL"


@query("campaign_history", "", f"""
WITH RECURSIVE log AS (
    SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 20 + l_suppkey % 20, l_partkey * 10 + l_linenumber) AS i, TIMESTAMP '{_START}' + to_minutes(CAST(l_linenumber * 20 + l_suppkey % 20 AS BIGINT)) AS tm, l_linenumber * 20 + l_suppkey % 20 AS m,
      ([{", ".join(map(_listed, _ITEM_KINDS))}])[l_orderkey % 3 + 1][l_linenumber] AS kind, CASE WHEN l_partkey % 7 = 0 THEN 'other' ELSE 'one' END AS rev, l_suppkey % 2 = 0 AS retry_failed FROM lineitem),
  told AS (SELECT *, CASE WHEN k % 40 % 5 = 2 AND m >= 120 THEN 'cancelled' WHEN k % 40 % 4 = 1 AND m >= 50 AND NOT (k % 40 % 8 = 1 AND m >= 90) THEN 'paused' ELSE 'active' END AS campaign FROM log),
  fold AS (
    SELECT k, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS status, CAST(0 AS BIGINT) AS n, CAST(NULL AS TIMESTAMP) AS claimed, CAST(NULL AS TIMESTAMP) AS staged, CAST(NULL AS VARCHAR) AS err, CAST(NULL AS VARCHAR) AS own FROM (SELECT DISTINCT k FROM log)
    UNION ALL
    SELECT k, i, CASE act WHEN 'create' THEN 'pending' WHEN 'stage' THEN 'session_staged' WHEN 'fail' THEN 'failed' WHEN 'publish' THEN 'succeeded' WHEN 'claim' THEN CASE WHEN status = 'failed' THEN back ELSE status END WHEN 'retry' THEN back ELSE status END,
      CASE act WHEN 'claim' THEN n + (status <> 'session_staged')::INT WHEN 'release' THEN n - (status = 'pending' AND n > 0)::INT WHEN 'retry' THEN 0 ELSE n END, CASE act WHEN 'claim' THEN tm WHEN 'none' THEN claimed ELSE NULL END,
      CASE act WHEN 'stage' THEN tm ELSE staged END, CASE WHEN act = 'fail' THEN 'TIMEOUT' WHEN act IN ('claim', 'stage', 'retry', 'publish') THEN NULL ELSE err END, CASE act WHEN 'create' THEN rev ELSE own END
    FROM (
      SELECT f.*EXCLUDE (i), l.i, l.tm, l.rev, CASE WHEN staged IS NULL THEN 'pending' ELSE 'session_staged' END AS back, CASE
          WHEN kind = 'create' AND status IS NULL THEN kind WHEN status IS NULL OR campaign = 'cancelled' THEN 'none'
          WHEN kind = 'claim' AND campaign = 'active' AND (claimed IS NULL OR claimed <= tm - INTERVAL 30 MINUTE) AND n < 3 AND (status IN ('pending', 'session_staged') OR status = 'failed' AND retry_failed) THEN kind
          WHEN kind = 'stage' AND status = 'pending' AND {_HELD} AND own = rev THEN kind WHEN kind = 'release' AND status IN ('pending', 'session_staged') AND {_HELD} AND own = rev THEN kind
          WHEN kind = 'fail' AND status <> 'succeeded' AND {_HELD} AND own = rev THEN kind WHEN kind = 'retry' AND status = 'failed' THEN kind
          WHEN kind = 'publish' AND status = 'session_staged' AND {_HELD} AND own = rev THEN kind ELSE 'none' END AS act
      FROM fold AS f JOIN told AS l ON l.k = f.k AND l.i = f.i + 1)),
  latest AS (SELECT *, k % 40 AS c FROM (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1) WHERE status IS NOT NULL),
  ended AS (SELECT c, CASE WHEN c % 5 = 2 THEN 'cancelled' WHEN bool_and(status = 'succeeded') THEN 'completed' WHEN c % 4 = 1 AND c % 8 <> 1 THEN 'paused' ELSE 'active' END AS campaign_status FROM latest GROUP BY c)
SELECT CAST(c AS VARCHAR) AS campaign_id, CAST(k AS VARCHAR) AS session_id, campaign_status, status, n AS attempts, strftime(CASE WHEN campaign_status <> 'cancelled' THEN claimed END, '%Y-%m-%d %H:%M:%S') AS claimed_at, staged IS NOT NULL AS staged, err AS error_code
FROM latest JOIN ended USING (c)""")
def campaign_history(t: Tables) -> DataFrame:
    found = lifecycles.campaign_state(*campaign_logs(t))
    return found.select("campaign_id", "session_id", "campaign_status", "status", "attempts", when_text("claimed_at"), F.col("staged_at").isNotNull().alias("staged"), "error_code")
