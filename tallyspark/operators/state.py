"""Changes of stored tables as transformations from old table and delta to new table.

Parquet has no updates, so each function returns the whole new table; versions.publish() writes it beside the
old one and moves a pointer.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions import texts, times

LEASE_MINUTES, MAX_BATCH, TRIVIAL = 10, 500, 2
#: What is said of a run whose lease ended.
STOPPED = "Worker stopped before analysis completed"
CONTENT, THINKING, RESULT = 10_000, 5_000, 2_000

# --- merging ------------------------------------------------------------------------------------------------


def merge(old: DataFrame, new: DataFrame, key: list[str], policy: dict[str, str] | None = None) -> DataFrame:
    """Upsert by key. Columns take the new value, or by policy: old (kept once set), max, coalesce (the new one if there is one), keep (never changed)."""
    policy = policy or {}
    a, b = old.withColumn("_a", F.lit(True)).alias("a"), new.withColumn("_b", F.lit(True)).alias("b")
    both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key], "full")

    def value(c: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c in key:
            return F.coalesce(x, y)
        how = policy.get(c, "new")
        if how == "old":
            return F.coalesce(x, y)
        if how == "max":
            return F.greatest(x, y)
        if how == "coalesce":
            return F.coalesce(y, x)
        if how == "keep":
            return F.when(F.col("_a"), x).otherwise(y)
        return F.when(F.col("_b"), y).otherwise(x)

    return both.select(*[value(c).alias(c) for c in old.columns])


SESSION_POLICY = {"generated_title": "old", "custom_title": "keep", "deleted_at": "keep"}
PROJECT_POLICY = {"last_activity": "max"}
USAGE_POLICY = {"session_message_count": "coalesce"}


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str, order: Column) -> DataFrame:
    """New rows whose key isn't there yet; of equal new keys the first in order."""
    first = new.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")
    return old.unionByName(first.join(old.select(key), key, "left_anti"))


def replace_keyed(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def replace_keyed_sessions(messages: DataFrame, new: DataFrame) -> DataFrame:
    """The messages of the sessions in new replaced, columns by name."""
    return messages.join(new.select("session_id").distinct(), "session_id", "left_anti").unionByName(new)


def replace_snapshot(messages: DataFrame, new: DataFrame) -> DataFrame:
    """The messages of the sessions in new replaced; an id that another session owns is an error when the result is read."""
    sessions = new.select("session_id").distinct()
    rest = messages.join(sessions, "session_id", "left_anti")
    taken = rest.select("id", F.lit(True).alias("_taken"))
    checked = new.join(taken, "id", "left").withColumn("id", F.when(F.col("_taken"), F.raise_error(F.concat(F.lit("message of another session: "), F.col("id"))).cast("string")).otherwise(F.col("id")))
    return rest.unionByName(checked.select(*messages.columns))


def snapshot_changed(messages: DataFrame, new: DataFrame) -> DataFrame:
    """session_id and changed for the sessions in new, by the hash of their ordered messages."""
    a, b = input_hash(messages), input_hash(new)
    return b.join(a.withColumnRenamed("hash", "old"), "session_id", "left").select("session_id", (~F.col("hash").eqNullSafe(F.col("old"))).alias("changed"))


def input_hash(messages: DataFrame) -> DataFrame:
    """session_id and hash, the SHA-256 of its messages' own hashes in order: what a pass has read."""
    each = F.sha2(F.to_json(F.struct("id", "type", "content"), {"ignoreNullFields": "false"}).cast("binary"), 256)
    rows = messages.select("session_id", F.struct("timestamp", "position", each.alias("h")).alias("m"))
    return rows.groupBy("session_id").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("m")), lambda x: x["h"]), ",").cast("binary"), 256).alias("hash"))


def truncate_messages(messages: DataFrame) -> DataFrame:
    """Fields at the sizes that are stored: content, and where there are such columns thinking and the outputs of tools."""
    out = messages.withColumn("content", texts.truncate_stored(F.col("content"), CONTENT))
    if "thinking" in messages.columns:
        out = out.withColumn("thinking", texts.truncate_stored(F.col("thinking"), THINKING))
    if "tool_results" in messages.columns:
        out = out.withColumn("tool_results", F.transform("tool_results", lambda r: F.struct(r["id"].alias("id"), texts.truncate_stored(r["output"], RESULT).alias("output"))))
    return out


def upsert_usage(usage: DataFrame, new: DataFrame) -> DataFrame:
    """Passes by session and kind: a message count that isn't given stays, all else is overwritten, with nulls too."""
    return merge(usage, new, ["session_id", "analysis_type"], USAGE_POLICY)


INSIGHT_TYPES = ("summary", "decision", "learning", "technique", "prompt_quality")


def create_insights(insights: DataFrame, new: DataFrame, sessions: DataFrame) -> DataFrame:
    """insights and those of new that are valid: a known type, a title and content, confidence of 0 to 1, a session that exists, an id that is free."""
    ok = F.col("type").isin(*INSIGHT_TYPES) & (F.trim("title") != "") & (F.trim("content") != "") & F.col("confidence").between(0, 1)
    valid = new.filter(F.coalesce(ok, F.lit(False))).join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi").join(insights.select("id"), "id", "left_anti")
    return insights.unionByName(valid.select(*insights.columns))


def delete_insights(insights: DataFrame, ids: DataFrame) -> DataFrame:
    return insights.join(ids.select("id").distinct(), "id", "left_anti")


def migrate(old: DataFrame, schema: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """The table in a newer schema: columns that are missing take a default or null, others go."""
    defaults = defaults or {}
    wanted = old.sparkSession.createDataFrame([], schema).schema
    return old.select(*[(F.col(f.name) if f.name in old.columns else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in wanted])


def soft_delete(sessions: DataFrame, ids: DataFrame, at: datetime) -> DataFrame:
    """Sessions in ids (id) deleted at a time, unless they already are."""
    gone = ids.select("id").distinct().withColumn("_gone", F.lit(True))
    return sessions.join(gone, "id", "left").withColumn("deleted_at", F.coalesce("deleted_at", F.when(F.col("_gone"), times.moment(at)))).select(*sessions.columns)


def restore(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    back = ids.select("id").distinct().withColumn("_back", F.lit(True))
    return sessions.join(back, "id", "left").withColumn("deleted_at", F.when(F.col("_back").isNull(), F.col("deleted_at"))).select(*sessions.columns)


def is_trivial() -> Column:
    return (F.col("message_count") <= TRIVIAL) & F.col("deleted_at").isNull()


def prune_trivial(sessions: DataFrame, at: datetime) -> DataFrame:
    return sessions.withColumn("deleted_at", F.when(is_trivial(), times.moment(at)).otherwise(F.col("deleted_at")))


def rename(sessions: DataFrame, session_id: str, title: str) -> DataFrame:
    """An empty title takes the custom title away."""
    return sessions.withColumn("custom_title", F.when(F.col("id") == session_id, F.nullif(F.trim(F.lit(title)), F.lit(""))).otherwise(F.col("custom_title")))


def replace_insights(insights: DataFrame, new: DataFrame, types: list[str]) -> DataFrame:
    """The analysed sessions' insights of the types become those in new."""
    analysed = new.select("session_id").distinct().withColumn("_analysed", F.lit(True))
    rest = insights.join(analysed, "session_id", "left").filter(F.col("_analysed").isNull() | ~F.col("type").isin(types))
    return rest.select(*insights.columns).join(new.select("id"), "id", "left_anti").unionByName(new)


def apply_titles(sessions: DataFrame, insights: DataFrame) -> DataFrame:
    """The first summary's title, 120 characters at most, for sessions without a generated one."""
    first = insights.filter("type = 'summary'").groupBy(F.col("session_id").alias("id")).agg(F.min_by("title", F.struct("timestamp", "id")).alias("_title"))
    return sessions.join(first, "id", "left").withColumn("generated_title", F.coalesce("generated_title", F.left("_title", F.lit(120)))).select(*sessions.columns)


def move_insights(insights: DataFrame, sessions: DataFrame) -> DataFrame:
    """Insights follow their sessions' projects."""
    home = sessions.select(F.col("id").alias("session_id"), F.col("project_id").alias("_home"))
    return insights.join(home, "session_id", "left").withColumn("project_id", F.coalesce("_home", "project_id")).select(*insights.columns)


def invalidate(usage: DataFrame, ids: DataFrame) -> DataFrame:
    """Both passes of the sessions in ids (session_id) lose the message count that says they are fresh."""
    stale = ids.select("session_id").distinct().withColumn("_stale", F.lit(True))
    count = F.when(F.col("_stale").isNull() | ~F.col("analysis_type").isin("session", "prompt_quality"), F.col("session_message_count"))
    return usage.join(stale, "session_id", "left").withColumn("session_message_count", count).select(*usage.columns)


# --- the queue ----------------------------------------------------------------------------------------------


def enqueue(queue: DataFrame, ids: list[str], at: datetime) -> DataFrame:
    """Ids wait from now; one in work is asked for again; others start afresh. All or nothing: 1 to 500 ids."""
    wanted = list(dict.fromkeys(ids))
    if not 1 <= len(wanted) <= MAX_BATCH or not all(wanted):
        raise ValueError(f"1 to {MAX_BATCH} ids are wanted")
    named = queue.sparkSession.createDataFrame([(k,) for k in wanted], "session_id string").withColumn("_wanted", F.lit(True))
    rows = queue.join(F.broadcast(named), "session_id", "full")  # at most 500 rows
    busy = F.col("_wanted") & (F.col("status") == "processing")
    fresh = F.col("_wanted") & ~F.coalesce(busy, F.lit(False))
    change = {"status": F.lit("pending"), "enqueued_at": times.moment(at), "started_at": F.lit(None).cast("timestamp"), "retry_after": F.lit(None).cast("timestamp"), "attempt_count": F.lit(0).cast("long"), "error_message": F.lit(None).cast("string"), "rerun_requested": F.lit(False), "max_attempts": F.coalesce("max_attempts", F.lit(3))}
    rows = rows.select(*[F.when(fresh, change[c]).otherwise(F.when(busy, F.lit(True)).otherwise(F.col(c)) if c == "rerun_requested" else F.col(c)).alias(c) if c in change else F.col(c) for c in queue.columns])
    return rows


def claimable(queue: DataFrame, at: datetime) -> DataFrame:
    return queue.filter((F.col("status") == "pending") & (F.col("retry_after").isNull() | (F.col("retry_after") <= times.moment(at))))


def next_claims(queue: DataFrame, at: datetime, n: int = 1) -> DataFrame:
    """The longest waiting rows, in order of arrival."""
    return claimable(queue, at).orderBy("enqueued_at", "seq").limit(n)


def _change(queue: DataFrame, on: Column, change: dict[str, Column]) -> DataFrame:
    on = F.coalesce(on, F.lit(False))
    return queue.select(*[F.when(on, change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in queue.columns])


def _waiting(at: datetime) -> dict[str, Column]:
    """A row that newer data asks for: it starts afresh."""
    none = F.lit(None)
    return {"status": F.lit("pending"), "enqueued_at": times.moment(at), "started_at": none.cast("timestamp"), "retry_after": none.cast("timestamp"), "attempt_count": F.lit(0).cast("long"), "error_message": none.cast("string"), "rerun_requested": F.lit(False)}


def _failed(at: datetime, error: str) -> dict[str, Column]:
    """A run that failed: afresh if newer data came meanwhile, else again after a delay, or for good after the last attempt."""
    attempts, again = F.col("attempt_count") + 1, F.col("rerun_requested")
    last = attempts >= F.col("max_attempts")
    later = times.moment(at) + F.make_dt_interval(secs=times.retry_delay(attempts).cast("decimal(18,6)"))
    change = {"status": F.when(last, "failed").otherwise("pending"), "attempt_count": attempts, "retry_after": F.when(~last, later), "error_message": texts.redact_error(F.lit(error))}
    return {c: F.when(again, v).otherwise(change.get(c, F.lit(None) if c == "started_at" else F.col(c))) for c, v in _waiting(at).items()}


def _in_work(queue: DataFrame, ids: DataFrame) -> tuple[DataFrame, Column]:
    hit = queue.join(ids.select("session_id").distinct().withColumn("_hit", F.lit(True)), "session_id", "left")
    return hit, F.col("_hit") & (F.col("status") == "processing")


def fail(queue: DataFrame, ids: DataFrame, error: str, at: datetime) -> DataFrame:
    """Processing rows in ids (session_id): another attempt after a delay, or failed for good after the last; afresh if newer data came meanwhile."""
    hit, on = _in_work(queue, ids)
    return _change(hit, on, _failed(at, error)).select(*queue.columns)


def complete(queue: DataFrame, ids: DataFrame, at: datetime) -> DataFrame:
    """Processing rows in ids (session_id) are done, or wait again from now if newer data came meanwhile."""
    hit, on = _in_work(queue, ids)
    done = {"status": F.lit("completed"), "error_message": F.lit(None).cast("string"), "retry_after": F.lit(None).cast("timestamp")}
    change = {c: F.when(F.col("rerun_requested"), v).otherwise(done.get(c, F.col(c))) for c, v in _waiting(at).items()}
    return _change(hit, on, change).select(*queue.columns)


def reset_stale(queue: DataFrame, at: datetime) -> DataFrame:
    """Rows in work for as long as the lease, or since nobody knows when, have failed that run."""
    stale = (F.col("status") == "processing") & (F.col("started_at").isNull() | (F.col("started_at") <= times.moment(at) - F.make_dt_interval(mins=F.lit(LEASE_MINUTES))))
    return _change(queue, stale, _failed(at, STOPPED))


def prune_finished(queue: DataFrame, at: datetime, days: int = 7) -> DataFrame:
    """The queue without completed and failed rows that were asked for longer ago."""
    old = F.col("status").isin("completed", "failed") & (F.col("enqueued_at") <= times.moment(at) - F.make_dt_interval(days=F.lit(days)))
    return queue.filter(~F.coalesce(old, F.lit(False)))


def retry_failed(queue: DataFrame) -> DataFrame:
    on = F.col("status") == "failed"
    change = {"status": F.lit("pending"), "attempt_count": F.lit(0).cast("long"), "error_message": F.lit(None).cast("string"), "retry_after": F.lit(None).cast("timestamp")}
    return queue.select(*[F.when(on, change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in queue.columns])


def queue_counts(queue: DataFrame) -> DataFrame:
    return queue.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "completed", "failed")], F.max("error_message").alias("last_error"))


def next_wake(queue: DataFrame) -> DataFrame:
    """When there is something to do next: a retry, or a lease that ends."""
    retry = queue.filter("status = 'pending'").select(F.coalesce("retry_after", "enqueued_at").alias("at"))
    lease = queue.filter("status = 'processing'").select((F.col("started_at") + F.make_dt_interval(mins=F.lit(LEASE_MINUTES))).alias("at"))
    return retry.unionAll(lease).agg(F.min("at").alias("wake_at"))


# --- campaigns ----------------------------------------------------------------------------------------------


def campaign_items(sessions: DataFrame, messages: DataFrame, date_from: str, date_to: str, zone: str = "UTC") -> DataFrame:
    """Live sessions with messages that start on the days of an inclusive range in a zone, numbered by time."""
    day = F.date_format("started_at", "yyyy-MM-dd")
    rows = sessions.filter(F.col("deleted_at").isNull() & times.on_days(F.col("started_at"), date.fromisoformat(date_from), date.fromisoformat(date_to), zone)).join(messages.select(F.col("session_id").alias("id")), "id", "left_semi")
    rows = rows.select("id", "started_at", day.alias("day"))
    # numbers within a day, and a row for each day to add those before it, so that no task orders all sessions
    before = F.coalesce(F.sum("n").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    days = rows.groupBy("day").agg(F.count(F.lit(1)).alias("n")).select("day", before.alias("before"))
    within = F.row_number().over(W.partitionBy("day").orderBy("started_at", "id")) - 1
    return rows.withColumn("within", within).join(days, "day").select("id", "started_at", (F.col("before") + F.col("within")).cast("long").alias("ordinal"))


def selection_fingerprint(items: DataFrame) -> DataFrame:
    """One hash of a campaign's items, whatever the order they come in: a sum of row hashes."""
    each = F.conv(F.substring(F.sha2(F.concat_ws(":", "ordinal", "id").cast("binary"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return items.agg(F.count(F.lit(1)).alias("items"), F.sum(each).cast("string").alias("fingerprint"))


def next_items(items: DataFrame, n: int = 1) -> DataFrame:
    """Waiting items in order, failed ones after all others."""
    open_ = items.filter(F.col("status").isin("pending", "failed") & (F.col("attempt_count") < F.col("max_attempts")))
    return open_.orderBy(F.when(F.col("status") == "failed", 1).otherwise(0), "ordinal").limit(n)


def fresh_sessions(usage: DataFrame, sessions: DataFrame, pipeline: str) -> DataFrame:
    """Sessions both of whose passes have the current pipeline, one input revision and the present message count."""
    same = usage.filter(F.col("pipeline_revision") == pipeline).join(sessions.select(F.col("id").alias("session_id"), "message_count"), "session_id").filter("session_message_count = message_count")
    by = same.groupBy("session_id", "input_revision", "language").agg(F.count_distinct("analysis_type").alias("passes"))
    return by.groupBy("session_id").agg(F.max("passes").alias("passes")).filter("passes = 2").select("session_id")
