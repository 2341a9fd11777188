"""Life cycles of queued sessions and campaign items: steps, folds in batch, the same as a stream, and replays."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import lifecycles, state

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
LOG = "session_id string, at timestamp, seq long, kind string, error string"


def at(minutes: float) -> datetime:
    return T0 + timedelta(minutes=minutes)


def events(seed: int = 3, sessions: int = 12, n: int = 160) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(f"s{rng.randrange(sessions)}", at(k * 1.5 + rng.random()), k, rng.choice(["enqueue", "claim", "claim", "claim", "complete", "fail", "fail", "retry"]), f"error {k}") for k in range(n)]
    return [(f"s{k}", at(0), -1, "enqueue", None) for k in range(sessions)] + rows


def plain(rows: list[tuple], until: datetime) -> dict:
    us = lambda t: round((t - T0).total_seconds() * 1e6)
    held: dict = {}
    for s, t, seq, kind, error in sorted(rows, key=lambda r: (r[1], r[2])):
        held[s] = lifecycles.queue_step(held.get(s), {"kind": kind, "at": us(t), "error": error})
    ends = {s: lifecycles.queue_until(x, us(until)) for s, x in held.items()}
    return {s: x for s, x in ends.items() if x is not None}


def seen(frame) -> dict:
    us = lambda t: None if t is None else round((t.replace(tzinfo=timezone.utc) - T0).total_seconds() * 1e6)
    return {r["session_id"]: {"status": r["status"], "enqueued_at": us(r["enqueued_at"]), "started_at": us(r["started_at"]), "retry_after": us(r["retry_after"]), "attempt_count": r["attempt_count"], "error_message": r["error_message"], "rerun_requested": r["rerun_requested"]} for r in frame.collect()}


def test_steps_of_a_queued_session():
    m = lifecycles.MINUTE
    fold = lambda *es: __import__("functools").reduce(lambda s, e: lifecycles.queue_step(s, {"kind": e[0], "at": e[1] * m, "error": "boom"}), es, None)
    assert fold(("claim", 1)) is None
    assert fold(("enqueue", 0), ("claim", 1), ("enqueue", 2), ("complete", 3)) == lifecycles._waiting(3 * m)  # newer data came meanwhile
    failed = fold(("enqueue", 0), ("claim", 1), ("fail", 2))
    assert (failed["status"], failed["attempt_count"], failed["retry_after"]) == ("pending", 1, 2 * m + 30 * lifecycles.SECOND)
    assert fold(("enqueue", 0), ("claim", 1), ("fail", 2), ("claim", 2))["status"] == "pending"  # not yet
    stale = fold(("enqueue", 0), ("claim", 1), ("claim", 11))
    assert (stale["status"], stale["attempt_count"], stale["error_message"], stale["retry_after"]) == ("pending", 1, lifecycles.STOPPED, 11 * m + 30 * lifecycles.SECOND)
    gone = fold(("enqueue", 0), ("claim", 1), ("fail", 2), ("claim", 4), ("fail", 5), ("claim", 9), ("fail", 10))
    assert gone["status"] == "failed" and lifecycles.queue_until(gone, 7 * 1440 * m - 1) == gone and lifecycles.queue_until(gone, 7 * 1440 * m) is None
    assert fold(("enqueue", 0), ("claim", 1), ("complete", 2), ("retry", 3))["status"] == "completed"


def test_batch_functions_take_the_same_steps(spark):
    """state.fail(), complete(), reset_stale() and prune_finished() change a table as the log's steps change its rows."""
    rows = [("a", 1, "processing", at(0), at(1), None, 0, 3, None, False), ("b", 2, "processing", at(0), at(1), None, 1, 3, "x", True), ("c", 3, "processing", at(0), at(8), None, 2, 3, None, False), ("d", 4, "pending", at(0), None, at(9), 1, 3, "x", False), ("e", 5, "completed", at(-20_000), at(-19_999), None, 0, 3, None, False)]
    queue = spark.createDataFrame(rows, "session_id string, seq long, status string, enqueued_at timestamp, started_at timestamp, retry_after timestamp, attempt_count long, max_attempts long, error_message string, rerun_requested boolean")
    now, ids = datetime(2026, 1, 1, 0, 11), queue.select("session_id")
    us = lambda t: None if t is None else round((t - T0).total_seconds() * 1e6)
    held = {r[0]: {"status": r[2], "enqueued_at": us(r[3]), "started_at": us(r[4]), "retry_after": us(r[5]), "attempt_count": r[6], "error_message": r[8], "rerun_requested": r[9]} for r in rows}
    for done, kind in ((state.complete(queue, ids, now), "complete"), (state.fail(queue, ids, "boom", now), "fail")):
        # leases are not looked at in these functions, so the steps are taken before any ends
        want = {k: lifecycles.queue_step({**s, "started_at": s["started_at"] if s["started_at"] is None else 10 * lifecycles.MINUTE}, {"kind": kind, "at": 11 * lifecycles.MINUTE, "error": "boom"}) for k, s in held.items() if k != "e"}
        got = {k: v for k, v in seen(done).items() if k != "e"}
        for k in want:
            assert {x: v for x, v in got[k].items() if x != "started_at"} == {x: v for x, v in want[k].items() if x != "started_at"}, (kind, k)
    want = {k: lifecycles.queue_until(s, 11 * lifecycles.MINUTE) for k, s in held.items()}
    got = seen(state.prune_finished(state.reset_stale(queue, now), now))
    assert got.keys() == {k for k, v in want.items() if v}
    for k, v in got.items():
        # a lease that ended is noticed now, in a table, and at its end, in a log
        assert {x: v[x] for x in ("status", "attempt_count", "error_message", "rerun_requested")} == {x: want[k][x] for x in ("status", "attempt_count", "error_message", "rerun_requested")}


def test_a_log_in_batch(spark):
    rows = events()
    log = spark.createDataFrame(rows, LOG).repartition(5)
    for minutes in (30, 200, 12_000):
        got = seen(lifecycles.queue_state(log, F.lit(at(minutes))))
        assert got == plain([r for r in rows if r[1] <= at(minutes)], at(minutes))
    assert lifecycles.queue_state(log.limit(0), F.lit(at(1))).collect() == []


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_the_log_as_a_stream(spark, rocks, tmp_path):
    """Events in several batches, leases that end and rows that go between them: the rows of the batch fold."""
    rows, source = events(), tmp_path / "in"
    source.mkdir()
    until = 11_000  # minutes: seven days and some, so finished rows have gone
    rows += [("last", at(until + 10), 1000, "enqueue", None)]  # moves the watermark to the end
    ordered = sorted(rows, key=lambda r: (r[1], r[2]))
    out = (tmp_path / "out").as_uri()
    for k in range(0, len(ordered), 60):
        (source / f"{k:04d}.json").write_text("\n".join(json.dumps({"session_id": s, "at": t.isoformat(), "seq": q, "kind": kind, "error": e}) for s, t, q, kind, e in ordered[k : k + 60]))

        def keep(df, batch):
            df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(out)

        stream = lifecycles.queue_stream(spark.readStream.schema(LOG).json(str(source)))
        stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    got = seen(lifecycles.newest_rows(spark.read.parquet(out)))
    assert got.pop("last")["status"] == "pending"
    assert got == plain(rows[:-1], at(until))


def test_replays_in_a_stream(spark, tmp_path):
    source, out = tmp_path / "in", (tmp_path / "out").as_uri()
    source.mkdir()
    line = lambda s, minutes, text, kind="user": json.dumps({"path": f"{s}.jsonl", "session_id": s, "at": at(minutes).isoformat(), "kind": kind, "text": text})
    batches = [[line("a", 0, "x"), line("a", 0, "x"), line("b", 0, "x"), line("a", 0, "x", "tool")], [line("a", 0, "x"), line("a", 1, "x"), line("a", 300, "late")], [line("a", 1, "x"), line("a", 301, "y"), line("a", 301, "y")]]
    left = []
    for k, lines in enumerate(batches):
        (source / f"{k}.json").write_text("\n".join(lines))
        stream = lifecycles.once(spark.readStream.schema("path string, session_id string, at timestamp, kind string, text string").json(str(source)))
        query = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
        left.append(sum(p["numRowsTotal"] for p in query.lastProgress["stateOperators"]))
    got = sorted((r["session_id"], r["kind"], r["text"], r["at"].minute, r["at"].hour) for r in spark.read.parquet(out).collect())
    assert got == [("a", "tool", "x", 0, 0), ("a", "user", "late", 0, 5), ("a", "user", "x", 0, 0), ("a", "user", "x", 1, 0), ("a", "user", "y", 1, 5), ("b", "user", "x", 0, 0)]
    assert left[-1] <= 2  # what the watermark has passed is forgotten


def test_campaigns(spark):
    """Claims only while active, leases of 30 minutes, other revisions refused, cancelled campaigns held by nobody, completed ones when all have succeeded."""
    camp = lambda c, *es: [(c, at(m), k, e) for k, (m, e) in enumerate(es)]
    item = lambda c, s, *es: [(c, s, at(m), k, e, rev, again, "E") for k, (m, e, rev, again) in enumerate((*x, "r", False)[:4] if len(x) == 2 else (*x, False)[:4] for x in es)]
    campaigns = camp("ok", (0, "create")) + camp("held", (0, "create"), (5, "pause"), (20, "resume")) + camp("no", (0, "create"), (10, "cancel"), (11, "resume"))
    items = (
        item("ok", "1", (0, "create"), (1, "claim"), (2, "stage"), (3, "claim"), (4, "publish"), (5, "fail"))
        + item("held", "2", (0, "create"), (6, "claim"), (21, "claim"), (22, "claim"), (23, "stage", "other"), (24, "release"))
        + item("held", "3", (0, "create"), (1, "claim"), (2, "fail"), (3, "claim"), (21, "claim", "r", True), (51, "claim"), (52, "fail"), (53, "retry"))
        + item("no", "4", (0, "create"), (1, "claim"), (12, "stage"))
    )
    got = lifecycles.campaign_state(spark.createDataFrame(campaigns, "campaign_id string, at timestamp, seq long, kind string"), spark.createDataFrame(items, "campaign_id string, session_id string, at timestamp, seq long, kind string, input_revision string, retry_failed boolean, error string"))
    assert sorted((r["session_id"], r["campaign_status"], r["status"], r["attempts"], r["claimed_at"] is not None, r["error_code"]) for r in got.collect()) == [
        ("1", "completed", "succeeded", 1, False, None), ("2", "active", "pending", 0, False, None), ("3", "active", "pending", 0, False, None), ("4", "cancelled", "pending", 1, False, None),
    ]
