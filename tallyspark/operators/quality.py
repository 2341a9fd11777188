"""Checks of the stored data, candidates for analysis, and differences between snapshots."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions import costs, texts, times
from tallyspark.operators import state


def checks(sessions: DataFrame, queue: DataFrame, known_sources: tuple[str, ...], at: datetime, stuck_minutes: int = 10) -> DataFrame:
    """check and count: missing times, unknown tools, queue rows without a session, in work for too long, failed."""
    one = sessions.agg(F.count_if(F.col("started_at").isNull()).alias("missing_time"), F.count_if(~F.col("source_tool").isin(*known_sources)).alias("unknown_tool"))
    orphans = queue.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_anti").agg(F.count(F.lit(1)).alias("orphan_queue"))
    old = F.col("started_at") < times.moment(at) - F.make_dt_interval(mins=F.lit(stuck_minutes))
    two = queue.agg(F.count_if((F.col("status") == "processing") & old).alias("stuck_queue"), F.count_if(F.col("status") == "failed").alias("failed_queue"))
    # each side is one row
    wide = one.withColumn("_k", F.lit(1)).join(orphans.withColumn("_k", F.lit(1)), "_k").join(two.withColumn("_k", F.lit(1)), "_k")
    names = ("missing_time", "unknown_tool", "orphan_queue", "stuck_queue", "failed_queue")
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("count")) for n in names])).alias("x")).select("x.*")


def tier(message_count):
    return F.when(message_count <= 2, "trivial").when(message_count <= 10, "short").otherwise("full")


def unanalysed(sessions: DataFrame, analysed: DataFrame) -> DataFrame:
    """Live sessions without a fresh analysis, by tier of length."""
    rows = sessions.filter("deleted_at IS NULL").join(analysed.select(F.col("session_id").alias("id")), "id", "left_anti")
    return rows.groupBy(tier(F.col("message_count")).alias("tier")).agg(F.count(F.lit(1)).alias("sessions"))


def analysis_candidates(sessions: DataFrame, messages: DataFrame, usage: DataFrame) -> DataFrame:
    """Live sessions with messages that lack one of the two passes, newest first, with what they have."""
    have = usage.groupBy(F.col("session_id").alias("id")).agg(F.bool_or(F.col("analysis_type") == "session").alias("has_session"), F.bool_or(F.col("analysis_type") == "prompt_quality").alias("has_quality"))
    rows = sessions.filter("deleted_at IS NULL").join(messages.select(F.col("session_id").alias("id")), "id", "left_semi").join(have, "id", "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("has_session", "has_quality")]
    return rows.select("id", "started_at", *flags).filter("NOT (has_session AND has_quality)").orderBy(F.desc("started_at"), "id")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """id and change between two snapshots (id, status): new failures, recoveries, others that came or went."""
    both = old.select("id", F.col("status").alias("was")).join(new.select("id", F.col("status").alias("now")), "id", "full")
    change = (
        F.when((F.col("now") == "failed") & ~F.col("was").eqNullSafe(F.lit("failed")), "new_failure")
        .when((F.col("was") == "failed") & (F.col("now") == "completed"), "recovered")
        .when(F.col("was").isNull(), "added")
        .when(F.col("now").isNull(), "removed")
        .when(F.col("was") != F.col("now"), "changed")
    )
    return both.select("id", change.alias("change")).filter("change IS NOT NULL")


def error_histogram(queue: DataFrame) -> DataFrame:
    return queue.filter("error_message IS NOT NULL").groupBy(texts.failure_code(F.col("error_message")).alias("code")).agg(F.count(F.lit(1)).alias("count"))


def usage_totals(usage: DataFrame) -> DataFrame:
    """Tokens and cost of analyses by provider, and what the cache has saved."""
    cost = costs.analysis_cost(F.col("provider"), F.col("model"), F.col("input_tokens"), F.col("output_tokens"), F.col("cache_creation_tokens"), F.col("cache_read_tokens"))
    saved = F.when(F.col("provider") == "anthropic", F.col("cache_read_tokens") / 1_000_000 * costs.model_price(F.col("model"), 0) * (1 - costs.CACHE_READ_FACTOR)).otherwise(0.0)
    return usage.groupBy("provider").agg(F.count(F.lit(1)).alias("passes"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum(cost), 4).alias("cost"), F.round(F.sum(saved), 4).alias("saved"))


def batch_progress(queue: DataFrame, ids: DataFrame) -> DataFrame:
    """Progress of a batch (session_id): what is neither waiting, in work nor failed is done, rows that are gone too."""
    rows = ids.join(queue.select("session_id", "status"), "session_id", "left")
    n = {s: F.count_if(F.col("status") == s) for s in ("pending", "processing", "failed")}
    return rows.agg(F.count(F.lit(1)).alias("total"), *[c.alias(s) for s, c in n.items()], (F.count(F.lit(1)) - n["pending"] - n["processing"] - n["failed"]).alias("completed"))


def backfill_progress(ids: list[str], sessions: DataFrame, done: DataFrame, results: DataFrame, force: bool = False) -> DataFrame:
    """A batch of ids in order, each with what became of it (gone, skipped, done, failed) and the batch's counts so far.

    done: sessions (session_id) that need no work, skipped unless forced; results: session_id and success of those
    that were worked on. A session without a result is done. A batch has as many ids as one may be asked for.
    """
    if len(ids) > state.MAX_BATCH:
        raise ValueError(f"at most {state.MAX_BATCH} ids are worked on at once")
    asked = sessions.sparkSession.createDataFrame(list(enumerate(ids)), "position long, session_id string")
    there = sessions.select(F.col("id").alias("session_id"), F.lit(True).alias("there")).join(F.broadcast(asked.select("session_id").distinct()), "session_id", "left_semi")
    ready = done.select("session_id", F.lit(True).alias("ready")).join(F.broadcast(asked.select("session_id").distinct()), "session_id", "left_semi").distinct()
    told = results.select("session_id", "success").join(F.broadcast(asked.select("session_id").distinct()), "session_id", "left_semi")
    rows = asked.join(there, "session_id", "left").join(ready, "session_id", "left").join(told, "session_id", "left")
    skip = F.col("ready").isNotNull() & F.lit(not force)
    outcome = F.when(F.col("there").isNull(), "gone").when(skip, "skipped").when(F.col("success") == F.lit(False), "failed").otherwise("done")
    so_far = W.orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.select("position", "session_id", outcome.alias("outcome"))
    count = lambda *of: F.count_if(F.col("outcome").isin(*of)).over(so_far)
    return rows.select("session_id", "outcome", count("done", "skipped").alias("completed"), count("gone", "failed").alias("failed"), F.lit(len(ids)).cast("long").alias("total"))


def coverage(sessions: DataFrame, facets: DataFrame) -> DataFrame:
    """How many live sessions have facets, and whether that is under half."""
    marked = sessions.select("id").join(facets.select(F.col("session_id").alias("id"), F.lit(True).alias("has")).distinct(), "id", "left")
    return marked.agg(F.count(F.lit(1)).alias("sessions"), F.count_if("has").alias("analysed")).withColumn("warn", F.col("analysed") * 2 < F.col("sessions"))
