"""Readers on small files, ingestion in steps, answers of a model, and functions against plain Python."""

from __future__ import annotations

import json
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import categories, costs, formats, texts, times
from tallyspark.operators import activity, analysis, graph, scope, state
from tallyspark.sources import discovery, transcripts
from tallyspark.streaming import ingest


def write(folder, name, *rows, raw=()):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([*[json.dumps(r) for r in rows], *raw]) + "\n")


def claude(kind, content, second, **more):
    message = {"content": content, **more.pop("message", {})}
    return {"type": kind, "uuid": f"m{second}", "timestamp": f"2026-01-02T03:04:{second:02d}Z", "message": message, **more}


def test_jsonl_transcripts(spark, tmp_path):
    usage = {"input_tokens": 1000, "output_tokens": 100, "cache_read_input_tokens": 10}
    write(
        tmp_path, "projects/-home-me-app/abc-1.jsonl",
        {"type": "summary", "summary": "first"},
        claude("user", "fix it?", 1, cwd="/home/me/app", gitBranch="main", version="2"),
        claude("assistant", [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "a"}, {"type": "text", "text": "b"}, {"type": "tool_use", "id": "t1", "name": "Edit", "input": {"file_path": "x.py"}}], 2, message={"model": "claude-haiku-4-5", "usage": usage}),
        claude("user", [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "ok"}]}], 3),
        claude("user", "<command-name>/review</command-name>", 4), claude("user", "/compact", 5), claude("user", "/unknown thing", 6), claude("user", "meta", 7, isMeta=True), claude("assistant", [], 8),
        {"type": "summary", "summary": "last"}, raw=["{broken"],
    )
    write(tmp_path, "projects/-home-me-app/not a session.jsonl", claude("user", "x", 1))
    entries = transcripts.jsonl_entries(spark, str(tmp_path))
    messages = transcripts.jsonl_messages(entries)
    got = {r["id"]: r for r in messages.collect()}
    assert sorted(got) == ["m1", "m2", "m3", "m4", "m5", "m6"]
    assert got["m2"]["content"] == "a\nb" and got["m2"]["thinking"] == "hm" and got["m2"]["tool_calls"][0]["path"] == "x.py" and got["m3"]["tool_results"][0]["output"] == "ok"
    s = transcripts.fold_sessions(messages).first()
    assert (s["user_message_count"], s["assistant_message_count"], s["tool_call_count"], s["compact_count"]) == (3, 1, 1, 1)
    assert s["slash_commands"] == ["/review", "/compact", "/unknown"] and s["primary_model"] == "claude-haiku-4-5" and s["input_tokens"] == 1000
    assert s["estimated_cost_usd"] == pytest.approx(0.0015)
    head = transcripts.jsonl_heads(entries).first()
    assert (head["project_path"], head["project_name"], head["git_branch"], head["summary"]) == ("/home/me/app", "app", "main", "last")


def test_discovery(spark, tmp_path, monkeypatch):
    """Hidden and temporary folders are not listed, filters prune folders and files, a file's rest is read only if its head says so."""
    for folder in ("-home-me-app", "-home-me-other", ".hidden", "-tmp", "-private-var-folders-x"):
        write(tmp_path / "projects", f"{folder}/aa.jsonl", {"cwd": f"/{folder}"}, claude("user", "x", 1))
    write(tmp_path / "projects", "-home-me-app/subagents/agent-1.jsonl", {"type": "x"})
    write(tmp_path / "projects", "-home-me-app/notes.txt", {"type": "x"})
    for k in (".hidden", "-tmp"):
        (tmp_path / "projects" / k).chmod(0o000)
    root = str(tmp_path / "projects")
    found = discovery.discover(spark, root, "claude-code")
    names = lambda df: sorted((r["project"], r["kind"], r["name"]) for r in df.select("project", "kind", "name").collect())
    assert names(found) == [("-home-me-app", "session", "aa.jsonl"), ("-home-me-app", "subagent", "agent-1.jsonl"), ("-home-me-other", "session", "aa.jsonl")]
    assert names(found.filter("kind = 'session' AND project LIKE '%app%'")) == [("-home-me-app", "session", "aa.jsonl")]
    assert names(discovery.discover(spark, root, "claude-code", "OTHER")) == [("-home-me-other", "session", "aa.jsonl")]
    row = found.filter("cwd = '/-home-me-other'").first()
    assert row["raw"].count("\n") == 2 and row["size"] == len(row["raw"]) and row["path"].endswith("/projects/-home-me-other/aa.jsonl")
    # what is pushed is not listed
    reader = discovery.TranscriptReader(root, "claude-code", "")
    listed = []
    monkeypatch.setattr(discovery, "_matches", lambda value, wanted, plain=discovery._matches: listed.append(value) or plain(value, wanted))
    left = list(reader.pushFilters([discovery.EqualTo(("project",), "-home-me-app"), discovery.EqualTo(("kind",), "session"), discovery.EqualTo(("size",), 3)]))
    assert [f.attribute for f in left] == [("size",)] and [f[1] for p in reader.partitions() for f in p.files] == ["aa.jsonl"]
    assert ".hidden" not in listed and "-tmp" not in listed
    for k, text in enumerate([json.dumps({"payload": {"cwd": "/work/Shop"}}), json.dumps({"session": {"cwd": "/work/else"}}), "{broken"]):
        write(tmp_path / "sessions", f"2026/01/0{k}/rollout-{k}.jsonl", raw=[text, "x" * 5_000])
    shop = discovery.discover(spark, (tmp_path / "sessions").as_uri(), "codex-cli", "shop")
    assert sorted((r["name"], r["cwd"], len(r["raw"])) for r in shop.collect()) == [("rollout-0.jsonl", "/work/Shop", 5_036), ("rollout-2.jsonl", None, 5_009)]
    assert [r["name"] for r in shop.filter("cwd LIKE '%work%'").collect()] == ["rollout-0.jsonl"]
    assert discovery.discover(spark, str(tmp_path / "none"), "codex-cli").collect() == []


def test_pages_are_written_by_tasks(spark, tmp_path):
    sessions = spark.createDataFrame([(str(k), f"title {k}", "p", None) for k in range(3)], "id string, title string, project_name string, started_at timestamp").withColumn("started_at", F.lit("2026-01-02").cast("timestamp"))
    rows = [("0", "1", t, f"{t} {k}", "text", None) for k, t in enumerate(["prompt_quality", "learning", "odd_type", "summary", "decision", "summary"])] + [("1", "2", "technique", "only", "x", None)]
    insights = spark.createDataFrame([(s, f"{i}{k}", t, title, c, n) for k, (s, i, t, title, c, n) in enumerate(rows)], "session_id string, id string, type string, title string, content string, timestamp timestamp")
    folder = str(tmp_path / "pages")
    analysis.write_pages(analysis.markdown(sessions, insights), folder)
    texts_ = {r["page"]: r["value"] for r in spark.read.text(folder, wholetext=True).selectExpr("value", "CAST(page AS STRING) AS page").collect()}
    head = "# title 0\n\nProject: p\nDate: 2026-01-02\n\n"
    assert texts_["0"] == head + "\n\n".join(["## Summary\n\n### summary 3\n\ntext\n\n### summary 5\n\ntext", "## Decision\n\n### decision 4\n\ntext", "## Learning\n\n### learning 1\n\ntext", "## Prompt Quality\n\n### prompt_quality 0\n\ntext", "## Odd Type\n\n### odd_type 2\n\ntext"]) + "\n"
    assert set(texts_) == {"0", "1"}


def test_rollouts(spark, tmp_path):
    t = lambda s: f"2026-01-02T03:04:{s:02d}Z"
    ask = {"type": "event_msg", "timestamp": t(1), "payload": {"type": "user_message", "message": "do it"}}
    write(
        tmp_path, "rollout-1.jsonl", {"type": "session_meta", "timestamp": t(0), "payload": {"id": "s1", "timestamp": t(0)}}, ask,
        {"type": "response_item", "timestamp": t(2), "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "done"}]}},
        {"type": "response_item", "timestamp": t(3), "payload": {"type": "function_call", "name": "run", "call_id": "c1", "arguments": "{\"path\":\"p\"}"}},
        {"type": "response_item", "timestamp": t(3), "payload": {"type": "function_call_output", "call_id": "c1", "output": "out"}}, ask,
        {"type": "event_msg", "timestamp": t(4), "payload": {"type": "task_complete", "usage": {"input_tokens": 5, "output_tokens": 2}, "model": "m"}},
        {"type": "event_msg", "timestamp": t(5), "payload": {"type": "user_message", "message": "<environment_context> x"}}, raw=['{"type": "cut'],
    )
    got = sorted(transcripts.rollout_messages(spark, str(tmp_path)).collect(), key=lambda r: r["position"])
    assert [(r["type"], r["content"]) for r in got] == [("user", "do it"), ("assistant", "done")]
    s = transcripts.rollout_sessions(transcripts.rollout_messages(spark, str(tmp_path))).first()
    assert (s["user_message_count"], s["assistant_message_count"], s["input_tokens"], s["estimated_cost_usd"], s["primary_model"]) == (1, 1, 5, 0.0, "m")
    assert got[1]["tool_calls"][0]["name"] == "run" and got[1]["tool_results"][0]["output"] == "out" and got[1]["usage"]["input"] == 5 and got[1]["model"] == "m"


def test_event_logs(spark, tmp_path):
    write(
        tmp_path, "s9/events.jsonl", {"type": "user.message", "timestamp": "2026-01-02T03:04:05Z", "data": {"content": "hi", "id": "u1"}}, {"type": "assistant.message_delta", "data": {"delta": "he"}}, {"type": "assistant.message_delta", "data": {"delta": "llo"}},
        {"type": "assistant.message", "data": {"content": "", "toolRequests": [{"toolCallId": "k", "name": "view", "arguments": {"path": "f"}}]}}, {"type": "tool.execution_start", "data": {"toolCallId": "k", "toolName": "view"}},
        {"type": "tool.execution_complete", "data": {"toolCallId": "k", "result": {"content": "seen"}}}, {"type": "session.idle", "data": {}}, {"type": "assistant.message", "data": {"content": "bye"}},
    )
    got = sorted(transcripts.cli_event_messages(spark, str(tmp_path)).collect(), key=lambda r: r["position"])
    assert [(r["type"], r["content"]) for r in got] == [("user", "hi"), ("assistant", "hello"), ("assistant", "bye")]
    assert [c["name"] for c in got[1]["tool_calls"]] == ["view"] and got[1]["tool_results"][0]["output"] == "seen"
    write(tmp_path, "bad/events.jsonl", raw=["{no"])
    with pytest.raises(Exception, match="malformed event"):
        transcripts.cli_event_messages(spark, str(tmp_path)).collect()


def test_editor_chats(spark, tmp_path):
    chat = {"sessionId": "e", "requests": [{"requestId": "r1", "timestamp": 1767323045000, "message": {"text": " q "}, "modelId": "gpt-4o", "response": [{"value": "an"}, {"kind": "thinking", "value": "t"}, {"value": "swer"}, {"kind": "toolInvocationSerialized", "toolId": "edit", "toolCallId": "a"}], "result": {"metadata": {"toolCallRounds": [{"toolCalls": [{"id": "a", "name": "edit"}, {"id": "b", "name": "grep", "arguments": "{}"}]}]}}}, {"requestId": "r2", "isCanceled": True, "message": {"text": "no"}, "response": []}]}
    write(tmp_path, "c.json", chat)
    got = sorted(transcripts.editor_chat_messages(spark, str(tmp_path)).collect(), key=lambda r: r["position"])
    assert [(r["id"], r["content"]) for r in got] == [("r1-user", "q"), ("r1-assistant", "answer")]
    assert [c["name"] for c in got[1]["tool_calls"]] == ["edit", "grep"] and got[1]["thinking"] == "t" and got[1]["model"] == "gpt-4o"


def test_rollout_documents_and_workspaces(spark, tmp_path):
    content = lambda t: [{"type": "input_text", "text": t}]
    doc = {
        "session": {"id": "d1", "timestamp": "2025-01-02T03:04:05Z", "model": "gpt-4o"},
        "items": [
            {"type": "message", "role": "user", "content": content("do it")}, {"type": "reasoning", "summary": [{"type": "summary_text", "text": "hm"}]},
            {"type": "function_call", "name": "shell", "call_id": "c1", "arguments": "{\"path\": \"p\"}"}, {"type": "function_call_output", "call_id": "c1", "output": "{\"output\": \"fine\"}"},
            {"type": "message", "role": "user", "content": content("and then?")}, {"type": "reasoning", "summary": [{"type": "summary_text", "text": "only thought"}]}, {"role": "user"},
        ],
    }
    (tmp_path / "rollout-1.json").write_text(json.dumps(doc))
    (tmp_path / "workspace.yaml").write_text("cwd: /home/me\nbranch:main\nempty:\ncwd: /home/you\nno colon\n")
    got = transcripts.READERS["codex-cli-documents"](spark, str(tmp_path)).orderBy("position").collect()
    assert [(r["type"], r["content"], r["thinking"]) for r in got] == [("user", "do it", None), ("assistant", "", "hm\n"), ("user", "and then?", None), ("assistant", "", "only thought\n")]
    assert got[1]["tool_calls"][0]["name"] == "shell" and got[1]["tool_results"][0]["output"] == "fine" and got[1]["session_id"] == "codex:d1"
    assert {r["key"]: r["value"] for r in transcripts.workspace_values(spark, str(tmp_path)).collect()} == {"cwd": "/home/you", "branch": "main"}
    (tmp_path / "rollout-2.json").write_text("{}")
    with pytest.raises(Exception, match="invalid document"):
        transcripts.rollout_document_messages(spark, str(tmp_path)).collect()


def test_key_value_stores(spark):
    tree = json.dumps({"root": {"children": [{"type": "paragraph", "children": [{"text": "rich"}]}, {"type": "linebreak"}, {"text": "end"}]}})
    one, two = {"bubbleId": "1", "type": 1, "richText": tree}, {"bubbleId": "2", "type": 2, "text": "reply", "codeBlocks": [{"uri": {"path": "/f"}}], "createdAt": "2026-01-02T03:04:05Z"}
    store = [("composerData:A", json.dumps({"conversation": [one, two, one]})), ("composerData:B", json.dumps({"fullConversationHeadersOnly": [{"bubbleId": "2"}]})), ("bubbleId:B:2", json.dumps(two)), ("other", "x")]
    got = sorted(transcripts.kv_messages(spark.createDataFrame(store, "key string, value string")).collect(), key=lambda r: (r["session_id"], r["position"]))
    assert [(r["session_id"], r["type"], r["content"]) for r in got] == [("cursor:A", "user", "rich\n\nend"), ("cursor:A", "assistant", "reply"), ("cursor:B", "assistant", "reply")]
    assert got[1]["tool_calls"][0]["path"] == "/f"
    with pytest.raises(Exception, match="missing bubble"):
        transcripts.kv_messages(spark.createDataFrame(store[1:2], "key string, value string")).collect()


def test_workspace_stores_and_the_shared_one(spark):
    """A workspace's own values win; conversations it knows by id only, and bubbles it lacks, come from the shared store; roots from absolute minus relative paths."""
    say = lambda i, text, **more: json.dumps({"bubbleId": i, "type": 1, "text": text, **more})
    heads = lambda *ids: json.dumps({"fullConversationHeadersOnly": [{"bubbleId": i} for i in ids]})
    blocks = {"codeBlocks": [{"uri": {"path": "rel/x"}}, {"uri": {"path": "/home/me/app/src/a.py"}}], "relevantFiles": ["b.py", "src/a.py"]}
    store = [
        ("w1", "composer.composerData", json.dumps({"allComposers": [{"composerId": "A", "name": "n"}, {"composerId": "B"}, {"composerId": "gone"}]})),
        ("w1", "composerData:B", heads("1", "2")), ("w1", "bubbleId:B:1", say("1", "own", **blocks)),
        ("w2", "composerData:B", json.dumps({"conversation": [json.loads(say("9", "of another workspace"))]})),
    ]
    shared = [("composerData:A", heads("5")), ("bubbleId:A:5", say("5", "shared")), ("bubbleId:B:1", say("1", "not this")), ("bubbleId:B:2", say("2", "filled in")), ("composerData:Z", heads("7"))]
    bubbles = transcripts.kv_bubbles(spark.createDataFrame(store, "path string, key string, value string"), spark.createDataFrame(shared, "key string, value string"))
    got = transcripts.kv_messages(spark.createDataFrame(store, "path string, key string, value string"), spark.createDataFrame(shared, "key string, value string"))
    assert sorted((r["path"], r["session_id"], r["position"], r["content"]) for r in got.collect()) == [("w1", "cursor:A", 0, "shared"), ("w1", "cursor:B", 0, "own"), ("w1", "cursor:B", 1, "filled in"), ("w2", "cursor:B", 0, "of another workspace")]
    assert [tuple(r) for r in transcripts.kv_roots(bubbles).collect()] == [("w1", "cursor:B", "/home/me/app")]


def contents(spark, table):
    rows = ingest.messages(spark, table)
    return [] if rows is None else sorted(r["content"] for r in rows.collect())


def test_sync_in_steps(spark, tmp_path):
    table, source = (tmp_path / "tables" / "messages").as_uri(), tmp_path / "in"
    read = transcripts.READERS["claude-code"]
    write(source, "projects/p/aa.jsonl", claude("user", "one", 1))
    assert ingest.sync(spark, str(source), "*.jsonl", read, table) == 1
    assert ingest.sync(spark, str(source), "*.jsonl", read, table) == 0
    write(source, "projects/p/aa.jsonl", claude("user", "one", 1), claude("assistant", "two", 2))
    write(source, "projects/p/bb.jsonl", claude("user", "three", 3))
    assert ingest.sync(spark, str(source), "*.jsonl", read, table) == 2
    assert contents(spark, table) == ["one", "three", "two"]
    before = ingest.newest(spark, table)
    assert before.number == 2
    write(source, "projects/p/bb.jsonl", claude("user", "four", 4))
    assert ingest.sync(spark, str(source), "*.jsonl", read, table) == 1
    now = ingest.newest(spark, table)
    assert now.identity == before.identity and sum(before.held[b] != now.held.get(b) for b in before.held) <= 1  # only the touched bucket is written
    (source / "projects/p/aa.jsonl").unlink()
    assert ingest.sync(spark, str(source), "*.jsonl", read, table) == 0
    assert contents(spark, table) == ["four", "one", "two"]  # what was read stays
    write(source, "projects/p/aa.jsonl", claude("user", "back", 1))
    assert ingest.sync(spark, str(source), "*.jsonl", read, table) == 1
    assert ingest.sync_file(spark, str(source / "projects/p/bb.jsonl"), read, table) == 1
    assert contents(spark, table) == ["back", "four"]
    # a table that was thrown away is read anew, whatever the manifest of the old one says
    ingest.remove(spark, table)
    assert ingest.sync(spark, str(source), "*.jsonl", read, table) == 2 and contents(spark, table) == ["back", "four"]
    last = ingest.newest(spark, table)
    ingest.reset(spark, table)
    assert contents(spark, table) == [] and ingest.sync(spark, str(source), "*.jsonl", read, table) == 2
    assert ingest.newest(spark, table).identity not in ("", last.identity)


def rollout(session, *texts, ids=True):
    t = lambda k: f"2026-01-02T03:04:{k:02d}Z"
    return [{"type": "session_meta", "timestamp": t(0), "payload": {"id": session}}, *[{"type": "event_msg", "timestamp": t(k), "payload": {"type": "user_message", "message": x, **({"id": f"{session}-{x}"} if ids else {})}} for k, x in enumerate(texts, 1)]]


def test_a_session_in_several_files(spark, tmp_path, monkeypatch):
    """One file grows, files come in several batches, all is read once more: nothing is lost or doubled, with ids and without."""
    table, source = (tmp_path / "t").as_uri(), tmp_path / "in"
    read = lambda spark, paths: transcripts.rollout_messages(spark, paths).withColumn("id", F.when(F.col("content").startswith("no id"), None).otherwise(F.col("id")))
    monkeypatch.setattr(ingest, "MAX_FILES", 2)
    write(source, "rollout-1.jsonl", *rollout("s", "a one", "a two"))
    write(source, "rollout-2.jsonl", *rollout("s", "b one", "no id", "a two"))  # tells one event of the first file again
    write(source, "rollout-3.jsonl", *rollout("s", "no id"))
    write(source, "rollout-4.jsonl", *rollout("other", "x"))
    write(source, "rollout-5 of +%.jsonl", *rollout("other", "y"))
    assert ingest.sync(spark, str(source), "rollout-*.jsonl", read, table) == 5
    want = ["a one", "a two", "b one", "no id", "no id", "x", "y"]
    assert contents(spark, table) == want
    rows = ingest.messages(spark, table).filter("session_id = 'codex:s'").orderBy("position").collect()
    assert [r["position"] for r in rows] == [0, 1, 2, 3, 4] and [r["content"] for r in rows] == ["a one", "b one", "no id", "a two", "no id"]
    write(source, "rollout-2.jsonl", *rollout("s", "b one", "no id", "a two", "b three"))
    assert ingest.sync(spark, str(source), "rollout-*.jsonl", read, table) == 1
    assert contents(spark, table) == sorted([*want, "b three"])
    assert ingest.sync(spark, str(source), "rollout-*.jsonl", read, table, force=True) == 5
    ingest.sync_file(spark, str(source / "rollout-3.jsonl"), read, table)
    assert contents(spark, table) == sorted([*want, "b three"])


def test_fragments_of_a_store(spark, tmp_path):
    """Of a store that changed, only the conversations that changed are parsed and written."""
    table, source = (tmp_path / "t").as_uri(), tmp_path / "in"
    asked = []

    def read(spark, paths, wanted):
        asked.append(sorted(r["fragment"] for r in wanted.collect()))
        return transcripts.READERS["cursor"](spark, paths, wanted)

    def save(**conversations):
        rows = [(f"composerData:{k}", json.dumps({"fullConversationHeadersOnly": [{"bubbleId": str(n)} for n in range(len(v))]})) for k, v in conversations.items()]
        rows += [(f"bubbleId:{k}:{n}", json.dumps({"bubbleId": str(n), "type": 1, "text": x})) for k, v in conversations.items() for n, x in enumerate(v)]
        folder = tmp_path / "made"
        spark.createDataFrame([*rows, ("history", "x")], "key string, value string").coalesce(1).write.mode("overwrite").parquet(str(folder))
        source.mkdir(exist_ok=True)
        (source / "store.parquet").write_bytes(next(folder.glob("*.parquet")).read_bytes())

    once = lambda force=False: ingest.sync(spark, str(source), "*.parquet", read, table, force, lambda spark, paths: transcripts.kv_fingerprints(transcripts.kv_store(spark, paths)))
    save(A=["a1", "a2"], B=["b1"], C=["c1"])
    assert once() == 1 and once() == 0 and contents(spark, table) == ["a1", "a2", "b1", "c1"]
    save(A=["a1", "a2"], B=["b1", "b2"], D=["d1"])
    assert once() == 1 and asked == [["A", "B", "C"], ["B", "D"]]
    assert contents(spark, table) == ["a1", "a2", "b1", "b2", "d1"]  # C is no longer in the store
    assert once(force=True) == 1 and contents(spark, table) == ["a1", "a2", "b1", "b2", "d1"]


def test_versions_and_writers(spark, tmp_path, monkeypatch):
    """Buckets double as a table grows, old versions go, and a writer that started from an older version is refused."""
    monkeypatch.setattr(ingest, "BUCKET_ROWS", 4)
    table = (tmp_path / "t").as_uri()
    frame = lambda lo, hi: ingest.staged(spark.range(lo, hi).select(F.concat(F.lit("f"), F.col("id")).alias("path"), F.col("id").alias("n")), table)
    none = spark.createDataFrame([], "path string")
    first = ingest.replace(spark, table, frame(0, 10), none)
    assert (first.number, first.buckets) == (1, ingest.BUCKETS)
    grown = ingest.replace(spark, table, frame(10, 100), none)
    assert grown.buckets == 32 and ingest.current(spark, table).count() == 100 and sum(n for _, n in grown.held.values()) == 100
    with pytest.raises(ingest.StaleWriter):
        ingest.replace(spark, table, frame(500, 600), none, first)
    last = ingest.replace(spark, table, frame(200, 201), spark.createDataFrame([("f3",), ("f4",)], "path string"), grown)
    assert sorted(r["n"] for r in ingest.current(spark, table).collect()) == sorted([*({*range(100)} - {3, 4}), 200])
    assert {p.rpartition("number=")[2] for p in ingest.children(spark, f"{table}/pointer")} == {"2", "3"}
    assert {v.rpartition("/")[2] for v in ingest.children(spark, f"{table}/versions")} >= {v.rpartition("/")[2] for v, _ in last.held.values()}
    assert len(ingest.children(spark, f"{table}/versions")) <= 2
    again = ingest.rebuild(spark, table, lambda df: df.select("path", (F.col("n") * 2).cast("string").alias("twice")))
    assert again.number == 4 and sorted(int(r["twice"]) for r in ingest.current(spark, table).collect()) == sorted([*(2 * k for k in range(100) if k not in (3, 4)), 400])
    gone = ingest.replace(spark, table, frame(0, 0), ingest.current(spark, table).select("path"))
    assert gone.held == {} and ingest.current(spark, table) is None and ingest.newest(spark, table).identity == first.identity


def test_a_file_that_changes_while_it_is_read(spark, tmp_path):
    table, source = (tmp_path / "tables" / "messages").as_uri(), tmp_path / "in"
    plain = transcripts.READERS["claude-code"]
    write(source, "aa.jsonl", claude("user", "one", 1))
    seen = []

    def read(spark, paths):
        seen.append(len(paths))
        if len(seen) <= 2:  # somebody writes during both attempts
            write(source, "aa.jsonl", *[claude("user", f"n{k}", k) for k in range(1, len(seen) + 2)])
        return plain(spark, paths)

    assert ingest.sync(spark, str(source), "*.jsonl", read, table) == 0
    assert ingest.current(spark, table) is None
    assert ingest.sync(spark, str(source), "*.jsonl", read, table) == 1
    assert ingest.current(spark, table).count() == 3


def test_stream_of_new_files(spark, tmp_path):
    """Sessions in several files and batches; a file that comes again by another name tells its events again."""
    table, source = (tmp_path / "t").as_uri(), tmp_path / "in"
    for k, rows in enumerate([rollout("s", "one"), rollout("s", "two", "one"), rollout("r", "three")], 1):
        write(source, f"rollout-{k}.jsonl", *rows)
        ingest.stream_files(spark, str(source), "*.jsonl", transcripts.rollout_messages, table, str(tmp_path / "checkpoint")).awaitTermination()
    assert contents(spark, table) == ["one", "three", "two"]
    # all once more, as after the loss of a checkpoint
    ingest.stream_files(spark, str(source), "*.jsonl", transcripts.rollout_messages, table, str(tmp_path / "other"), files_a_batch=2).awaitTermination()
    assert contents(spark, table) == ["one", "three", "two"] and ingest.current(spark, table).count() == 4


def test_answers_of_a_model(spark):
    answer = {"summary": {"title": "T", "content": "C", "bullets": ["b"]}, "decisions": [{"title": "d", "situation": "s", "choice": "c", "confidence": 90, "alternatives": [{"option": "o"}]}, {"title": "weak", "confidence": 60}], "learnings": [{"title": "l", "takeaway": "k"}]}
    rows = [("1", f"Here: <json>{json.dumps(answer)}</json>"), ("2", "so " + json.dumps(answer)[:-1]), ("3", "nothing"), ("4", None)]
    got = analysis.insight_rows(spark.createDataFrame(rows, "session_id string, answer string")).collect()
    assert sorted((r["session_id"], r["type"], r["content"]) for r in got) == sorted((s, *x) for s in ("1", "2") for x in (("summary", "C"), ("decision", "s → c"), ("learning", "k")))
    assert next(r for r in got if r["type"] == "decision")["bullets"] == ["o: no reason given"]
    assert analysis.repaired_json('{"a": [1, 2,], "b": "x') == '{"a": [1, 2], "b": "x"}' and analysis.repaired_json("nope") is None
    refs = spark.createDataFrame([("1", "decision", ["User # 1", "User#9", "Assistant#0:note"]), ("1", "learning", ["User#7"]), ("1", "summary", [])], "session_id string, type string, evidence array<string>")
    bounds = spark.createDataFrame([("1", 2, 1)], "session_id string, users int, assistants int")
    assert sorted((r["type"], r["evidence"]) for r in analysis.checked_evidence(refs, bounds).collect()) == [("decision", ["User#1", "Assistant#0:note"]), ("summary", [])]


def test_chunks_and_pages(spark):
    text = "\n\n".join(f"### User#{k}:\n{'w' * 30}" for k in range(10)) + "\n\n### User#10:\n" + "x" * 250
    got = [r["text"] for r in analysis.chunks(spark.createDataFrame([("1", text)], "session_id string, text string"), 100).orderBy("chunk").collect()]
    assert all(len(c) <= 100 for c in got) and "".join(got).replace("\n", "") == text.replace("\n", "")


def test_weeks_against_the_calendar(spark):
    days = [date(2019, 12, 20) + timedelta(days=k) for k in range(0, 1200, 3)]
    rows = spark.createDataFrame([(d,) for d in days], "d date").select("d", times.iso_week(F.col("d")).alias("w"), times.iso_monday(F.col("d")).alias("m")).collect()
    for r in rows:
        year, week, _ = r["d"].isocalendar()
        assert r["w"] == f"{year}-W{week:02d}" and r["m"] == r["d"] - timedelta(days=r["d"].weekday())
        assert times.week_bounds(r["w"])[0].date() == r["m"]
    assert times.week_bounds("2026-W54") is None and times.week_bounds("30d") is None


def test_functions_on_odd_values(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(categories.normalize_category(F.lit("Scope-Crep"), categories.FRICTION)) == "scope-creep"
    assert one(categories.normalize_category(F.lit("Brand-New"), categories.FRICTION)) == "Brand-New"
    assert one(texts.snippet(F.lit("x" * 100 + "NEEDLE" + "y" * 100), "needle")) == "..." + ("x" * 60 + "NEEDLE" + "y" * 54) + "..."
    assert one(texts.guard_credentials(F.lit("password = hunter22 and Bearer abcdefghijklmnop1234"))) == "[REDACTED:assignment] and [REDACTED:authorization]"
    assert one(texts.normal_git_url(F.lit("git@h.org:a/b.git"))) == "h.org/a/b" and one(texts.git_branch(F.lit("On branch dev\nclean"))) == "dev"
    assert one(texts.failure_code(F.lit("HTTP 401 unauthorized"))) == "AUTHENTICATION" and one(costs.score_label(F.lit(45))) == "Needs Improvement"
    assert scope.safe_int(" 12x", 5) == 12 and scope.safe_int(None, 5) == 5 and formats.request_budget(100, 90, 20) == 1
    assert formats.date_bounds("7d", date(2026, 1, 10)) == ("2026-01-03", None) and formats.date_bounds("all", date(2026, 1, 10)) == (None, None)
    file, fragment = transcripts.split_virtual(F.lit("a.db#c1"))
    assert (one(file), one(fragment)) == ("a.db", "c1") and one(transcripts.split_virtual(F.lit("a.db"))[1]) is None
    # fixed values, written out once more
    prices = [one(costs.model_price(F.lit(m), side)) for m in ("claude-opus-4-6", "claude-haiku-4-5") for side in (0, 1)]
    assert prices == [5.0, 25.0, 1.0, 5.0]
    assert [one(categories.normalize_category(F.lit(c), categories.FRICTION)) for c in ("config-drift", "api-rate-limit", "race-condition")] == ["stale-assumptions", "rate-limit-hit", "wrong-approach"]
    assert [one(categories.normalize_category(F.lit(c), categories.PATTERN)) for c in ("tdd", "task-decomposition", "backtracking")] == ["verification-workflow", "structured-planning", "self-correction"]
    assert one(times.is_calendar_date(F.lit("2026-02-30"))) is False and one(texts.title_score(F.lit("fix the login page of our app"))) == 80


def test_session_characters(spark):
    rows = [("s", "user", "there is an error", []), *[("s", "assistant", "fixed", [("Edit", f"f{k % 2}")]) for k in range(3)]]
    messages = spark.createDataFrame(rows, "session_id string, type string, content string, tool_calls array<struct<name:string,path:string>>")
    found = activity.character_features(messages)
    assert found.select(activity.session_character(found).alias("c")).first()["c"] == "bug_hunt"


def test_selection_and_groups(spark):
    items = spark.createDataFrame([(0, "a"), (1, "b")], "ordinal long, id string")
    assert state.selection_fingerprint(items).first() == state.selection_fingerprint(items.orderBy(F.desc("id"))).first()
    links = spark.createDataFrame([("1", '["x"]'), ("2", '["x","y"]'), ("3", '["y"]'), ("4", '["z"]'), ("5", None), ("6", "bad")], "id string, linked_insight_ids string")
    assert {r["id"]: r["group"] for r in graph.groups(links).collect()} == {"1": "1", "2": "1", "3": "1", "4": "4"}


def test_components_of_any_shape(spark):
    """Chains, a star of many, rings and random edges: every node's smallest reachable one."""
    import random

    rng = random.Random(8)
    edges = [(k, k - 1) for k in range(1, 40)] + [(k, 100) for k in range(101, 400)] + [(500, 501), (501, 502), (502, 500)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    frame = spark.createDataFrame([(max(e), min(e)) for e in edges if e[0] != e[1]], "high long, low long")
    assert {r["high"]: r["low"] for r in graph.stars(frame).collect()} == {x: find(x) for x in root if find(x) != x}
    assert graph.stars(frame.limit(0)).collect() == []
