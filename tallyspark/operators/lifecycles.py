"""Life cycles of queued sessions and of campaign items: logs of what happened, folded to what is.

A log is folded in order, one step an event. In batch, rows are dealt and sorted by key and time, and a task streams
over them with the state of one key in hand, however long its log is. As a stream, the same steps run under
transformWithState, keyed by session, with timers for leases that end and rows that are old enough to go.

Times are microseconds since 1970 inside. Between two events the lease of a row in work may have ended; that is an
event as well, at the moment it ends, and so are the ends of leases up to the time that a fold is asked for.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyspark.functions import times
from tallyspark.operators.state import STOPPED

# executors need no copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SECOND = 1_000_000
MINUTE, DAY = 60 * SECOND, 86_400 * SECOND
# Leases, attempts, delays of retries and the age at which finished rows go.
QUEUE_LEASE, CLAIM_LEASE, PRUNE_AFTER = 10 * MINUTE, 30 * MINUTE, 7 * DAY
ATTEMPTS = 3
DELAYS = tuple(s * SECOND for s in times.RETRY_SECONDS)
# End of fixed values.

Step = Callable[[dict | None, dict], dict | None]


# --- steps --------------------------------------------------------------------------------------------------

QUEUE = "status string, enqueued_at long, started_at long, retry_after long, attempt_count long, error_message string, rerun_requested boolean"


def _waiting(at: int) -> dict:
    return {"status": "pending", "enqueued_at": at, "started_at": None, "retry_after": None, "attempt_count": 0, "error_message": None, "rerun_requested": False}


def _failed(s: dict, at: int, error: str) -> dict:
    """A run that failed: afresh if newer data came meanwhile, else again after a delay, or for good after the last attempt."""
    if s["rerun_requested"]:
        return _waiting(at)
    n = s["attempt_count"] + 1
    last = n >= ATTEMPTS
    return {**s, "status": "failed" if last else "pending", "attempt_count": n, "started_at": None, "error_message": error, "retry_after": None if last else at + DELAYS[min(n, len(DELAYS)) - 1]}


def queue_due(s: dict | None) -> int | None:
    """When something happens to a row by itself: its lease ends, or it is old enough to go."""
    if s is None:
        return None
    if s["status"] == "processing":
        return s["started_at"] + QUEUE_LEASE
    return s["enqueued_at"] + PRUNE_AFTER if s["status"] in ("completed", "failed") else None


def queue_until(s: dict | None, at: int) -> dict | None:
    """The row after all that happens by itself up to a time."""
    while (due := queue_due(s)) is not None and due <= at:
        s = _failed(s, due, STOPPED) if s["status"] == "processing" else None
    return s


def queue_step(s: dict | None, e: dict) -> dict | None:
    """enqueue, claim, complete, fail (error) and retry; what doesn't fit the row's state changes nothing."""
    kind, at = e["kind"], e["at"]
    s = queue_until(s, at)
    if kind == "enqueue":
        return {**s, "rerun_requested": True} if s and s["status"] == "processing" else _waiting(at)
    if s is None:
        return None
    if kind == "claim" and s["status"] == "pending" and (s["retry_after"] is None or s["retry_after"] <= at):
        return {**s, "status": "processing", "started_at": at, "retry_after": None, "rerun_requested": False}
    if kind == "complete" and s["status"] == "processing":
        return _waiting(at) if s["rerun_requested"] else {**s, "status": "completed", "error_message": None}
    if kind == "fail" and s["status"] == "processing":
        return _failed(s, at, e["error"])
    if kind == "retry" and s["status"] == "failed":
        return {**s, "status": "pending", "attempt_count": 0, "error_message": None, "retry_after": None}
    return s


ITEM = "status string, attempts long, claimed_at long, staged_at long, error_code string, input_revision string"


def item_step(s: dict | None, e: dict) -> dict | None:
    """create, claim (retry_failed), stage, release, fail (error), retry and publish of an item, under its campaign's state; what doesn't fit, or is of another input revision, changes nothing."""
    kind, at, campaign = e["kind"], e["at"], e["campaign_status"]
    if kind == "create" and s is None:
        return {"status": "pending", "attempts": 0, "claimed_at": None, "staged_at": None, "error_code": None, "input_revision": e["input_revision"]}
    if s is None or campaign == "cancelled":
        return s
    held, same, status = s["claimed_at"] is not None, s["input_revision"] == e["input_revision"], s["status"]
    back = "pending" if s["staged_at"] is None else "session_staged"
    if kind == "claim":
        free = not held or s["claimed_at"] <= at - CLAIM_LEASE
        if campaign == "active" and free and s["attempts"] < ATTEMPTS and status in ("pending", "session_staged", *(["failed"] if e["retry_failed"] else [])):
            return {**s, "status": back if status == "failed" else status, "claimed_at": at, "attempts": s["attempts"] + (status != "session_staged"), "error_code": None}
    elif kind == "stage" and status == "pending" and held and same:
        return {**s, "status": "session_staged", "claimed_at": None, "staged_at": at, "error_code": None}
    elif kind == "release" and status in ("pending", "session_staged") and held and same:
        return {**s, "claimed_at": None, "attempts": s["attempts"] - (status == "pending" and s["attempts"] > 0)}
    elif kind == "fail" and status != "succeeded" and held and same:
        return {**s, "status": "failed", "claimed_at": None, "error_code": e["error"]}
    elif kind == "retry" and status == "failed":
        return {**s, "status": back, "attempts": 0, "claimed_at": None, "error_code": None}
    elif kind == "publish" and status == "session_staged" and held and same:
        return {**s, "status": "succeeded", "claimed_at": None, "error_code": None}
    return s


# --- in batch -----------------------------------------------------------------------------------------------


def folded(log: DataFrame, keys: list[str], step: Step, fields: str, until: Callable[[dict | None], dict | None] = lambda s: s) -> DataFrame:
    """keys and fields of what is left of each key, from a log (keys, at as long, seq and what step reads)."""
    types = ", ".join(f"{k} string" for k in keys)
    schema = log.sparkSession.createDataFrame([], f"{types}, {fields}").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([(f.name, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for f, t in zip(schema, kinds)])
        key, state, out = None, None, []
        for b in batches:
            for e in b.to_pylist():
                now = tuple(e[k] for k in keys)
                if now != key:
                    if key is not None and (state := until(state)) is not None:
                        out.append({**dict(zip(keys, key)), **state})
                    key, state = now, None
                state = step(state, e)
            if len(out) >= 5_000:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if key is not None and (state := until(state)) is not None:
            out.append({**dict(zip(keys, key)), **state})
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    kinds = ["string"] * len(keys) + [f.strip().split(" ")[1] for f in fields.split(",")]
    return log.repartition(*keys).sortWithinPartitions(*keys, "at", "seq").mapInArrow(run, schema)


def _timestamps(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.timestamp_micros(n) for n in names})


def queue_state(log: DataFrame, until: Column) -> DataFrame:
    """The queue at a time, from its log (session_id, at, seq, kind, error): finished rows of more than seven days have gone."""
    rows = log.filter(F.col("at") <= until).select("session_id", F.unix_micros("at").alias("at"), "seq", "kind", "error", F.unix_micros(until).alias("until"))
    end = log.sparkSession.range(1).select(F.unix_micros(until)).first()[0]
    found = folded(rows.drop("until"), ["session_id"], queue_step, QUEUE, lambda s: queue_until(s, end))
    return _timestamps(found, "enqueued_at", "started_at", "retry_after")


def campaign_spans(log: DataFrame) -> DataFrame:
    """campaign_id, since, before (null: for good) and campaign_status, from the events of campaigns (campaign_id, at, seq, kind): create, pause, resume, cancel.

    A campaign is paused only while active and resumed only while paused, and cancelled for good.
    """
    from pyspark.sql import Window as W

    order = W.partitionBy("campaign_id").orderBy("at", "seq")  # a campaign's own events are few, its items' are many
    first_cancel = F.min(F.when(F.col("kind") == "cancel", F.struct("at", "seq"))).over(W.partitionBy("campaign_id"))
    rows = log.filter(F.col("kind").isin("create", "pause", "resume", "cancel")).withColumn("cancel", first_cancel).filter(F.col("cancel").isNull() | (F.struct("at", "seq") <= F.col("cancel")))
    status = F.when(F.col("kind") == "cancel", "cancelled").when(F.col("kind") == "pause", "paused").otherwise("active")
    return rows.select("campaign_id", F.col("at").alias("since"), F.lead("at").over(order).alias("before"), status.alias("campaign_status"))


def campaign_state(campaigns: DataFrame, items: DataFrame) -> DataFrame:
    """campaign_id, session_id, campaign_status and the state of each item, from the events of campaigns (campaign_id, at, seq, kind) and of items (campaign_id, session_id, at, seq, kind, input_revision, retry_failed, error).

    A campaign whose items have all succeeded is completed, unless it was cancelled; an item of a cancelled one is held by nobody.
    """
    spans = campaign_spans(campaigns).select(F.col("campaign_id").alias("span_id"), "since", "before", "campaign_status")
    inside = (F.col("campaign_id") == F.col("span_id")) & (F.col("at") >= F.col("since")) & (F.col("before").isNull() | (F.col("at") < F.col("before")))
    log = items.join(spans, inside).withColumn("at", F.unix_micros("at")).select("campaign_id", "session_id", "at", "seq", "kind", "input_revision", "retry_failed", "error", "campaign_status")
    found = folded(log, ["campaign_id", "session_id"], item_step, ITEM)
    last = spans.filter("before IS NULL").select(F.col("span_id").alias("campaign_id"), "campaign_status")
    open_ = found.groupBy("campaign_id").agg(F.count_if(F.col("status") != "succeeded").alias("open"))
    ended = last.join(open_, "campaign_id").select("campaign_id", F.when((F.col("open") == 0) & (F.col("campaign_status") != "cancelled"), "completed").otherwise(F.col("campaign_status")).alias("campaign_status"))
    rows = found.join(ended, "campaign_id").withColumn("claimed_at", F.when(F.col("campaign_status") != "cancelled", F.col("claimed_at")))
    return _timestamps(rows, "claimed_at", "staged_at")


# --- as a stream --------------------------------------------------------------------------------------------

STREAMED = f"session_id string, at long, gone boolean, {QUEUE}"
_FIELDS = [f.strip().split(" ")[0] for f in QUEUE.split(",")]


class QueueProcessor(StatefulProcessor):
    """One row a session, by queue_step(); a timer stands at what the row is due for next."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("row", QUEUE)

    def _put(self, key, s: dict | None, at: int) -> pd.DataFrame:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if s is None:
            self.held.clear()
        else:
            self.held.update(tuple(s[f] for f in _FIELDS))
            if (due := queue_due(s)) is not None:
                self.handle.registerTimer(-(-due // 1000))
        row = {"session_id": key[0], "at": at, "gone": s is None, **(s or dict.fromkeys(_FIELDS))}
        return pd.DataFrame({k: pd.Series([v], dtype="Int64" if k in ("at", "enqueued_at", "started_at", "retry_after", "attempt_count") else "object") for k, v in row.items()})

    def _get(self) -> dict | None:
        return dict(zip(_FIELDS, self.held.get())) if self.held.exists() else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((e for part in rows for e in part[["at", "seq", "kind", "error"]].to_dict("records")), key=lambda e: (e["at"], e["seq"]))
        s = self._get()
        for e in events:
            s = queue_step(s, {**e, "at": int(e["at"]), "error": e["error"] if isinstance(e["error"], str) else None})
        yield self._put(key, s, int(events[-1]["at"]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all that is due by now, as a lease that ended may leave a row that is old enough to go
        at = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        yield self._put(key, queue_until(self._get(), at), at)

    def close(self) -> None:
        pass


def queue_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of queue events (session_id, at, seq, kind, error) as a stream of rows of the queue: the newest of a session counts, gone ones are pruned.

    Events may be late by the delay; leases end, and finished rows go, as the watermark passes. State is one row
    for each session that has not gone. Needs the RocksDB state store, as transformWithState does.
    """
    rows = events.withWatermark("at", delay).withColumn("event_time", F.col("at")).withColumn("at", F.unix_micros("at"))
    schema = T._parse_datatype_string(STREAMED)
    return rows.groupBy("session_id").transformWithStateInPandas(statefulProcessor=QueueProcessor(), outputStructType=schema, outputMode="Update", timeMode="EventTime")


def newest_rows(changes: DataFrame) -> DataFrame:
    """The queue that the rows of queue_stream(), as written, add up to."""
    columns = [c for c in changes.columns if c != "session_id"]
    last = changes.groupBy("session_id").agg(F.max_by(F.struct(*columns), F.struct("at", "batch")).alias("x")).select("session_id", "x.*").filter("NOT gone")
    return _timestamps(last.drop("gone", "at", "batch"), "enqueued_at", "started_at", "retry_after")


# --- replays ------------------------------------------------------------------------------------------------


def once(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of events (path, session_id, at, kind, text) in which a replay, the same kind, time and text in a session and file, counts once.

    State holds what the watermark has not passed; later repeats are late and dropped with it.
    """
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["path", "session_id", "kind", "at", "text"])
