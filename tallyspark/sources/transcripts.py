"""Readers of session transcripts. Every format becomes one table of messages, and messages fold to sessions.

A file is read as one row and split into numbered lines, since order within a file matters and Spark keeps no
other trace of it; a transcript is one conversation, so a row stays moderate. All parsing is columns over parsed
JSON; the only Python function flattens rich text, which is a tree of any depth.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions import costs, texts

MESSAGE = "path string, session_id string, position long, id string, type string, content string, thinking string, tool_calls array<struct<id:string,name:string,path:string>>, tool_results array<struct<id:string,output:string>>, model string, usage struct<input:long,output:long,cache_write:long,cache_read:long>, timestamp timestamp"
CALLS, RESULTS = "array<struct<id:string,name:string,path:string>>", "array<struct<id:string,output:string>>"
USAGE = "struct<input:bigint,output:bigint,cache_write:bigint,cache_read:bigint>"

# Keys and openings that the formats use.
MESSAGE_ARRAY_KEYS = ("conversation", "messages", "bubbles", "turns", "history", "richConversation", "thread")
SYSTEM_OPENINGS = ("<permissions", "<environment_context", "<collaboration_mode", "# AGENTS.md", "## Apps", "## Tools", "<system", "## Shell", "## Current working directory")
BLOCK_NODES = ("paragraph", "heading", "list-item", "quote")
# End of fixed values.


# --- helpers ------------------------------------------------------------------------------------------------


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def text_of(v: Column, path: str) -> Column:
    """A JSON string at the path; null for anything else."""
    return F.when(F.schema_of_variant(get(v, path, "variant")) == "STRING", get(v, path))


def items(v: Column, path: str) -> Column:
    return F.coalesce(get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def nonempty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def joined(parts: Column, sep: str) -> Column:
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), sep)


def stripped(c: Column) -> Column:
    """Without white space, line breaks too, at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def plain_path(uri: Column) -> Column:
    """A file's path as listings write it, of the encoded form in which rows carry it."""
    return F.regexp_replace(F.try_url_decode(F.regexp_replace(uri, r"\+", "%2B")), "^([a-z]+):///", "$1:/")


def files(spark: SparkSession, path: str | list[str], glob: str) -> DataFrame:
    """path, name and raw, a row for each file of that name below a folder, or in a list of files."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    return rows.select(plain_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("raw"))


def lines(found: DataFrame) -> DataFrame:
    """path, name, position, n_lines, line and v (null where a line isn't JSON) of the nonblank lines of files()."""
    rows = found.select("path", "name", F.filter(F.split("raw", "\r?\n"), lambda x: F.trim(x) != "").alias("ls"))
    return rows.select("path", "name", F.size("ls").alias("n_lines"), F.posexplode("ls").alias("position", "line")).withColumn("v", F.try_parse_json("line"))


def project_of(path: Column) -> Column:
    """The project that a folder below `projects` encodes."""
    coded = F.regexp_extract(path, r"/projects/([^/]+)/", 1)
    return F.when(coded != "", F.regexp_replace(F.regexp_replace(coded, "^-", "/"), "-", "/")).otherwise(path)


def base_name(path: Column) -> Column:
    return F.coalesce(nonempty(F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)), F.lit("unknown"))


def split_virtual(path: Column) -> tuple[Column, Column]:
    """File and fragment of `file#fragment`; without one the fragment is null."""
    has = F.instr(path, "#") > 0
    return F.when(has, F.substring_index(path, "#", 1)).otherwise(path), F.when(has, F.substring_index(path, "#", -1))


# --- transcripts of JSON lines ------------------------------------------------------------------------------


def jsonl_entries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """session_id, path, position and v of all well-formed lines; files whose name is no session id are left out."""
    rows = lines(files(spark, path, "*.jsonl")).filter("v IS NOT NULL")
    session = F.regexp_extract("name", r"^([a-f0-9-]+|agent-[a-f0-9]+)\.jsonl$", 1)
    return rows.select(session.alias("session_id"), "path", F.col("position").cast("long").alias("position"), "v").filter("session_id <> ''")


def jsonl_messages(entries: DataFrame) -> DataFrame:
    """Messages that have text, thinking, tool calls or tool results; meta entries are left out."""
    v = F.col("v")
    parts = items(v, "$.message.content")
    of = lambda kind, field: F.transform(F.filter(parts, lambda p: get(p, "$.type") == kind), lambda p: text_of(p, field))
    output = lambda p: F.coalesce(text_of(p, "$.content"), joined(F.transform(F.filter(items(p, "$.content"), lambda s: get(s, "$.type") == "text"), lambda s: text_of(s, "$.text")), "\n"), F.lit(""))
    calls = F.transform(F.filter(parts, lambda p: (get(p, "$.type") == "tool_use") & text_of(p, "$.name").isNotNull()), lambda p: F.struct(F.coalesce(get(p, "$.id"), F.lit("")).alias("id"), get(p, "$.name").alias("name"), F.coalesce(get(p, "$.input.file_path"), get(p, "$.input.path")).alias("path")))
    results = F.transform(F.filter(parts, lambda p: (get(p, "$.type") == "tool_result") & text_of(p, "$.tool_use_id").isNotNull()), lambda p: F.struct(get(p, "$.tool_use_id").alias("id"), output(p).alias("output")))
    tokens = F.struct(*[F.coalesce(get(v, f"$.message.usage.{field}", "long"), F.lit(0)).alias(name) for name, field in (("input", "input_tokens"), ("output", "output_tokens"), ("cache_write", "cache_creation_input_tokens"), ("cache_read", "cache_read_input_tokens"))])
    has_usage = get(v, "$.message.usage", "variant").isNotNull() & get(v, "$.message.model").isNotNull()
    rows = entries.filter(get(v, "$.type").isin("user", "assistant", "system") & ~F.coalesce(get(v, "$.isMeta", "boolean"), F.lit(False)))
    rows = rows.select(
        "path", "session_id", "position", get(v, "$.uuid").alias("id"), get(v, "$.type").alias("type"),
        F.coalesce(text_of(v, "$.message.content"), joined(of("text", "$.text"), "\n")).alias("content"), nonempty(joined(of("thinking", "$.thinking"), "\n")).alias("thinking"),
        calls.cast(CALLS).alias("tool_calls"), results.cast(RESULTS).alias("tool_results"), F.when(has_usage, get(v, "$.message.model")).alias("model"), F.when(has_usage, tokens).cast(USAGE).alias("usage"), F.to_timestamp(get(v, "$.timestamp")).alias("timestamp"),
    )
    return rows.filter((F.col("content") != "") | F.col("thinking").isNotNull() | (F.size("tool_calls") > 0) | (F.size("tool_results") > 0))


def jsonl_heads(entries: DataFrame) -> DataFrame:
    """session_id, project_path, git_branch, version of the first message, and the last summary."""
    v = F.col("v")
    message = get(v, "$.type").isin("user", "assistant", "system")
    first = lambda c: F.min_by(c, F.when(message, F.col("position")))
    return entries.groupBy("session_id").agg(
        first(F.struct(F.coalesce(nonempty(get(v, "$.cwd")), project_of(F.col("path"))).alias("project_path"), nonempty(get(v, "$.gitBranch")).alias("git_branch"), nonempty(get(v, "$.version")).alias("version"))).alias("h"),
        F.max_by(get(v, "$.summary"), F.when(get(v, "$.type") == "summary", F.col("position"))).alias("summary"),
    ).select("session_id", "h.*", base_name(F.col("h.project_path")).alias("project_name"), "summary")


def fold_sessions(messages: DataFrame, classify: bool = True, priced: bool = True) -> DataFrame:
    """One row a session: times, counts by class, tools, commands, tokens, models in order of appearance, the primary one and cost.

    classify: user texts count by their class, and results of tools don't count; else every user message counts.
    priced: tokens have a price; those of rollouts have none that is public, so they cost nothing.
    """
    user, text = F.col("type") == "user", F.col("content")
    kind = F.when(F.size("tool_results") > 0, "tool-result").otherwise(texts.message_class(text)) if classify else F.lit("human")
    rows = messages.withColumn("class", F.when(user, kind)).withColumn("command", F.when(F.col("class") == "user-compact", "/compact").when(F.col("class") == "slash-command", texts.slash_command(text)))
    counted = F.col("class").isin("human", "user-compact") | ((F.col("class") == "slash-command") & F.col("command").isin(*texts.WORKFLOW_COMMANDS))
    tokens = {n: F.sum(f"usage.{n}") for n in ("input", "output", "cache_write", "cache_read")}
    cost = costs.token_cost(F.col("model"), *[F.col(f"usage.{n}") for n in tokens])
    commands = F.sort_array(F.collect_list(F.when(F.col("command").isNotNull(), F.struct("position", "command"))))
    base = rows.groupBy("session_id").agg(
        F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at"), F.count_if(F.coalesce(counted, F.lit(False))).alias("user_message_count"), F.count_if(F.col("type") == "assistant").alias("assistant_message_count"),
        F.sum(F.size("tool_calls")).alias("tool_call_count"), F.count_if(F.col("class") == "user-compact").alias("compact_count"), F.count_if(F.col("class") == "auto-compact").alias("auto_compact_count"), F.transform(commands, lambda x: x["command"]).alias("slash_commands"),
        *[c.alias(f"{n}_tokens") for n, c in tokens.items()], costs.half_up(F.sum(F.when(F.col("usage").isNotNull(), cost if priced else F.lit(0.0))), 4).alias("estimated_cost_usd"),
    ).withColumn("message_count", F.col("user_message_count") + F.col("assistant_message_count"))
    turns = rows.filter("usage IS NOT NULL").groupBy("session_id", "model").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first"))
    models = turns.groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "model"))), lambda x: x["model"]).alias("models_used"), F.min_by("model", F.struct(-F.col("n"), F.col("first"))).alias("primary_model"))
    return base.join(models, "session_id", "left")


def rollout_sessions(messages: DataFrame) -> DataFrame:
    """Sessions of rollouts: every user message counts, tokens cost nothing, and usage without input is none."""
    used = F.when(F.col("usage.input") > 0, F.col("usage"))
    return fold_sessions(messages.withColumn("usage", used), classify=False, priced=False)


# --- event logs ---------------------------------------------------------------------------------------------


def turns(events: DataFrame, thinking_counts: bool = False) -> DataFrame:
    """Messages from events (path, session_id, position, kind, id, text, tool, result, usage, model, timestamp), each file by itself.

    kind is user, text, thinking, tool, result, boundary or other. A user event is a message by itself; what lies between user events and boundaries is
    one message of the assistant, if it has text or tools, or (thinking_counts) thinking. A tool id counts once in a message.
    """
    so_far = W.partitionBy("path", "session_id").orderBy("position")
    user, edge = F.col("kind") == "user", F.col("kind") == "boundary"
    turn = F.sum(user.cast("int")).over(so_far.rowsBetween(W.unboundedPreceding, W.currentRow)) + F.coalesce(F.sum(edge.cast("int")).over(so_far.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = events.withColumn("turn", turn)
    own = rows.filter(user & (F.col("text") != "")).select("path", "session_id", "position", F.coalesce("id", F.concat_ws(":", "session_id", F.lit("user"), "position")).alias("id"), F.lit("user").alias("type"), F.left("text", F.lit(10_000)).alias("content"),
        F.lit(None).cast("string").alias("thinking"), F.array().cast(CALLS).alias("tool_calls"), F.array().cast(RESULTS).alias("tool_results"), F.lit(None).cast("string").alias("model"), F.lit(None).cast(USAGE).alias("usage"), "timestamp")
    ordered = lambda kind, c: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("position", F.col(c).alias("x"))))), lambda p: p["x"])
    said = rows.filter(~user).groupBy("path", "session_id", "turn").agg(
        F.max("position").alias("position"), F.min_by("id", F.when(F.col("id").isNotNull() & (F.col("kind") == "text"), F.col("position"))).alias("id"),
        stripped(F.array_join(ordered("text", "text"), "")).alias("content"), nonempty(F.array_join(ordered("thinking", "text"), "")).alias("thinking"), ordered("tool", "tool").alias("calls"), ordered("result", "result").alias("tool_results"),
        F.max_by("model", F.when(F.col("model").isNotNull(), F.col("position"))).alias("model"), F.max_by("usage", F.when(F.col("usage").isNotNull(), F.col("position"))).alias("usage"), F.max("timestamp").alias("timestamp"),
    )
    once = F.aggregate("calls", F.array().cast(CALLS), lambda a, x: F.when(F.exists(a, lambda y: y["id"] == x["id"]), a).otherwise(F.array_append(a, x)))
    said = said.withColumn("tool_calls", once).filter((F.col("content") != "") | (F.size("tool_calls") > 0) | (F.lit(thinking_counts) & F.col("thinking").isNotNull()))
    said = said.select("path", "session_id", "position", F.coalesce("id", F.concat_ws(":", "session_id", F.lit("assistant"), "position")).alias("id"), F.lit("assistant").alias("type"), F.left("content", F.lit(10_000)).alias("content"), "thinking", "tool_calls", "tool_results", "model", "usage", "timestamp")
    return own.unionByName(said)


def _tool(id_: Column, name: Column, path: Column) -> Column:
    return F.struct(id_.alias("id"), F.coalesce(name, F.lit("unknown")).alias("name"), path.alias("path"))


def _result(id_: Column, output: Column) -> Column:
    return F.struct(id_.alias("id"), F.left(output, F.lit(1000)).alias("output"))


def cli_event_messages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Messages of `<session>/events.jsonl` logs. A line that isn't JSON fails the read: such a file is a whole snapshot."""
    rows = lines(files(spark, path, "events.jsonl"))
    rows = rows.withColumn("v", F.when(F.col("v").isNull(), F.raise_error(F.concat(F.lit("malformed event in "), "path")).cast("variant")).otherwise(F.col("v")))
    v = F.col("v")
    data = F.coalesce(get(v, "$.data", "variant"), v)
    session = F.concat(F.lit("copilot:"), F.element_at(F.split("path", "/"), -2))
    rows = rows.select("path", session.alias("session_id"), (F.col("position") * 1000).cast("long").alias("position"), get(v, "$.type").alias("event"), data.alias("d"), F.to_timestamp(F.coalesce(*[get(x, f"$.{k}") for x in (data, v) for k in ("timestamp", "createdAt", "time")])).alias("timestamp"))
    d, event = F.col("d"), F.col("event")
    text = F.coalesce(text_of(d, "$.content"), text_of(d, "$.text"), text_of(d, "$.message"), F.lit(""))
    call = F.coalesce(get(d, "$.toolCallId"), get(d, "$.id"))
    output = F.coalesce(text_of(d, "$.result"), get(d, "$.result.content"), F.to_json(get(d, "$.result", "variant")), get(d, "$.output"))
    is_agent = event.startswith("subagent")
    kind = F.when(event == "user.message", "user").when(event.isin("assistant.message", "assistant.message_delta"), "text").when(event.isin("tool.execution_start", "subagent.started"), "tool").when(event.isin("tool.execution_complete", "subagent.completed") & (output != ""), "result").when(event == "session.idle", "boundary").otherwise("other")
    name = F.when(is_agent, F.concat(F.lit("subagent:"), F.coalesce(get(d, "$.name"), get(d, "$.agentName"), F.lit("subagent")))).otherwise(F.coalesce(get(d, "$.toolName"), get(d, "$.name"), F.lit("unknown_tool")))
    said = F.when(event == "user.message", text).when(event == "assistant.message", F.when(text != "", F.concat(text, F.lit("\n"))).otherwise("")).when(event == "assistant.message_delta", F.coalesce(get(d, "$.delta"), get(d, "$.text"), F.lit("")))
    args = F.coalesce(get(d, "$.parameters.path"), get(d, "$.arguments.path"))
    flat = rows.select("path", "session_id", "position", kind.alias("kind"), get(d, "$.id").alias("id"), said.alias("text"), _tool(call, name, args).cast("struct<id:string,name:string,path:string>").alias("tool"), _result(call, output).alias("result"), F.lit(None).cast(USAGE).alias("usage"), get(d, "$.model").alias("model"), "timestamp")
    asked = rows.filter(event == "assistant.message").select("path", "session_id", "position", F.posexplode(items(d, "$.toolRequests")).alias("k", "r"), "timestamp")
    asked = asked.select("path", "session_id", (F.col("position") + 1 + F.col("k")).alias("position"), F.lit("tool").alias("kind"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("text"), _tool(get(F.col("r"), "$.toolCallId"), get(F.col("r"), "$.name"), get(F.col("r"), "$.arguments.path")).alias("tool"), F.lit(None).cast("struct<id:string,output:string>").alias("result"), F.lit(None).cast(USAGE).alias("usage"), F.lit(None).cast("string").alias("model"), "timestamp")
    return turns(flat.unionByName(asked))


def rollout_messages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Messages of `rollout-*.jsonl` logs: a truncated last line is passed over, any other broken line fails; replays of a user event count once."""
    rows = lines(files(spark, path, "rollout-*.jsonl"))
    tail = (F.col("position") == F.col("n_lines") - 1) & (F.col("position") > 0) & ~F.col("line").rlike(r"[}\]]\s*$")
    rows = rows.withColumn("v", F.when(F.col("v").isNull() & ~tail, F.raise_error(F.concat(F.lit("invalid event in "), "path")).cast("variant")).otherwise(F.col("v"))).filter("v IS NOT NULL")
    v = F.col("v")
    meta = F.when(F.col("position") == 0, F.coalesce(get(v, "$.payload.id"), get(v, "$.id")))
    rows = rows.withColumn("session_id", F.concat(F.lit("codex:"), F.max(meta).over(W.partitionBy("path")))).filter("position > 0")
    rows = rows.select("path", "session_id", F.col("position").cast("long").alias("position"), F.coalesce(get(v, "$.payload", "variant"), v).alias("p"), get(v, "$.type").alias("outer"), get(v, "$.timestamp").alias("raw_time"))
    p = F.col("p")
    event = F.coalesce(get(p, "$.type"), F.col("outer"))
    asked = F.coalesce(text_of(p, "$.message"), F.lit(""))
    system = F.lit(False)
    for opening in SYSTEM_OPENINGS:
        system = system | F.ltrim(asked).startswith(opening)
    is_user, is_say = event.isin("user_message", "userMessage"), (event == "message") & (get(p, "$.role") == "assistant")
    said = joined(F.transform(items(p, "$.content"), lambda x: text_of(x, "$.text")), "\n")
    thought = F.coalesce(nonempty(joined(F.transform(F.filter(items(p, "$.summary"), lambda x: get(x, "$.type") == "summary_text"), lambda x: text_of(x, "$.text")), "\n")), nonempty(text_of(p, "$.text")))
    thinks, calls, outputs, ends = event.isin("reasoning", "agent_reasoning") & thought.isNotNull(), event.isin("function_call", "custom_tool_call"), event.isin("function_call_output", "custom_tool_call_output"), event.isin("task_complete", "turn.completed")
    kind = F.when(is_user, "user").when(is_say & (said != ""), "text").when(thinks, "thinking").when(calls, "tool").when(outputs & get(p, "$.call_id").isNotNull(), "result").when(ends, "boundary").otherwise("other")
    text = F.when(is_user, F.when(system, "").otherwise(asked)).when(is_say, F.concat(said, F.lit("\n"))).when(thinks, F.concat(thought, F.lit("\n")))
    output = F.coalesce(text_of(F.try_parse_json(get(p, "$.output")), "$.output"), get(p, "$.output"), F.lit(""))
    spent = F.struct(*[F.coalesce(get(p, f"$.usage.{f}", "long"), F.lit(0)).alias(n) for n, f in (("input", "input_tokens"), ("output", "output_tokens"), ("cache_write", "none"), ("cache_read", "cached_input_tokens"))])
    call_path = F.coalesce(get(F.try_parse_json(get(p, "$.arguments")), "$.path"), F.regexp_extract(get(p, "$.input"), r"(?m)^\*\*\* (?:Add|Update|Delete) File: (.+)$", 1))
    flat = rows.select("path", "session_id", "position", kind.alias("kind"), F.when(is_user, get(p, "$.id")).alias("id"), text.alias("text"), _tool(F.coalesce(get(p, "$.call_id"), F.concat(F.lit("call-"), F.col("position"))), get(p, "$.name"), nonempty(call_path)).alias("tool"), _result(get(p, "$.call_id"), output).alias("result"),
        F.when(ends & (get(p, "$.usage.input_tokens", "long") > 0), spent).cast(USAGE).alias("usage"), F.when(ends, get(p, "$.model")).alias("model"), F.to_timestamp("raw_time").alias("timestamp"), "raw_time", asked.alias("asked"))
    first = F.row_number().over(W.partitionBy("path", "session_id", "kind", "raw_time", "asked").orderBy("position"))
    replay = (F.col("kind") == "user") & (F.col("text") != "") & F.col("raw_time").isNotNull() & (first > 1)
    flat = flat.withColumn("replay", replay).filter("NOT replay").drop("replay", "raw_time", "asked")
    # events without a time have that of the last one before them
    latest = F.last("timestamp", ignorenulls=True).over(W.partitionBy("path", "session_id").orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow))
    return turns(flat.withColumn("timestamp", latest))


def rollout_document_messages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Messages of `rollout-*.json` documents, an older form: a session and its items, all of them at the session's time. A document without either fails."""
    rows = files(spark, path, "rollout-*.json").withColumn("v", F.try_parse_json("raw"))
    v, x = F.col("v"), F.col("x")
    whole = get(v, "$.session.id").isNotNull() & F.try_variant_get(v, "$.items", "array<variant>").isNotNull()
    rows = rows.withColumn("v", F.when(F.coalesce(whole, F.lit(False)), v).otherwise(F.raise_error(F.concat(F.lit("invalid document: "), "path")).cast("variant")))
    rows = rows.select("path", F.concat(F.lit("codex:"), get(v, "$.session.id")).alias("session_id"), get(v, "$.session.model").alias("model"), F.to_timestamp(get(v, "$.session.timestamp")).alias("timestamp"), F.posexplode(items(v, "$.items")).alias("position", "x"))
    event = get(x, "$.type")
    told = F.array_join(F.transform(F.filter(items(x, "$.content"), lambda c: text_of(c, "$.text").isNotNull()), lambda c: text_of(c, "$.text")), "\n")
    system = F.lit(False)
    for opening in SYSTEM_OPENINGS:
        system = system | F.ltrim(told).startswith(opening)
    thought = nonempty(F.array_join(F.transform(F.filter(items(x, "$.summary"), lambda c: get(c, "$.type") == "summary_text"), lambda c: text_of(c, "$.text")), "\n"))
    is_user = (event == "message") & (get(x, "$.role") == "user")
    thinks = (event == "reasoning") & thought.isNotNull()
    output = F.coalesce(text_of(F.try_parse_json(get(x, "$.output")), "$.output"), get(x, "$.output"), F.lit(""))
    kind = F.when(is_user, "user").when(thinks, "thinking").when(event == "function_call", "tool").when((event == "function_call_output") & get(x, "$.call_id").isNotNull(), "result").otherwise("other")
    call = _tool(F.coalesce(get(x, "$.call_id"), get(x, "$.id"), F.concat(F.lit("codex-tool-"), F.col("position"))), get(x, "$.name"), nonempty(get(F.try_parse_json(get(x, "$.arguments")), "$.path")))
    flat = rows.select("path", "session_id", F.col("position").cast("long").alias("position"), kind.alias("kind"), F.lit(None).cast("string").alias("id"), F.when(is_user, F.when(system, "").otherwise(told)).when(thinks, F.concat(thought, F.lit("\n"))).alias("text"), call.alias("tool"), _result(get(x, "$.call_id"), output).alias("result"),
        F.lit(None).cast(USAGE).alias("usage"), "model", "timestamp")
    return turns(flat.filter("kind <> 'other'"), thinking_counts=True)


def workspace_values(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, key and value of the `key: value` lines of workspace.yaml files; of equal keys the last counts."""
    rows = files(spark, path, "workspace.yaml").select("path", F.posexplode(F.split("raw", "\n")).alias("position", "line")).filter(F.instr("line", ":") > 0)
    at = F.instr("line", ":")
    pairs = rows.select("path", "position", stripped(F.col("line").substr(F.lit(1), at - 1)).alias("key"), stripped(F.col("line").substr(at + 1, F.length("line"))).alias("value"))
    return pairs.filter("key <> '' AND value <> ''").groupBy("path", "key").agg(F.max_by("value", "position").alias("value"))


# --- documents ----------------------------------------------------------------------------------------------


def editor_chat_messages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Messages of `*.json` chats with a list of requests; cancelled requests are left out, as are files without requests."""
    rows = files(spark, path, "*.json").withColumn("v", F.try_parse_json("raw"))
    v, r = F.col("v"), F.col("r")
    rows = rows.select("path", F.concat(F.lit("copilot-vscode:"), get(v, "$.sessionId")).alias("session_id"), get(v, "$.inputState.selectedModel.metadata.name").alias("chosen"), F.posexplode(items(v, "$.requests")).alias("k", "r")).filter(~F.coalesce(get(r, "$.isCanceled", "boolean"), F.lit(False)))
    answer = items(r, "$.response")
    is_a = lambda x, kind: F.coalesce(get(x, "$.kind"), F.lit("text-value")) == kind
    said = stripped(F.array_join(F.transform(F.filter(answer, lambda x: is_a(x, "text-value")), lambda x: text_of(x, "$.value")), ""))
    thought = nonempty(stripped(F.array_join(F.transform(F.filter(answer, lambda x: is_a(x, "thinking")), lambda x: text_of(x, "$.value")), "\n")))
    used = F.transform(F.filter(answer, lambda x: is_a(x, "toolInvocationSerialized") & get(x, "$.toolId").isNotNull()), lambda x: _tool(get(x, "$.toolCallId"), get(x, "$.toolId"), F.lit(None).cast("string")))
    rounds = F.flatten(F.transform(items(r, "$.result.metadata.toolCallRounds"), lambda x: F.transform(items(x, "$.toolCalls"), lambda c: _tool(get(c, "$.id"), get(c, "$.name"), get(F.try_parse_json(get(c, "$.arguments")), "$.filePath")))))
    calls = F.concat(used.cast(CALLS), F.filter(rounds.cast(CALLS), lambda c: ~F.exists(used.cast(CALLS), lambda u: u["id"] == c["id"])))
    time = F.timestamp_millis(get(r, "$.timestamp", "long"))
    both = F.array(*[F.struct(F.lit(k).alias("k2"), F.concat_ws("-", get(r, "$.requestId"), F.lit(kind)).alias("id"), F.lit(kind).alias("type"), F.left(content, F.lit(10_000)).alias("content"), thinking.alias("thinking"), tools.cast(CALLS).alias("tool_calls")) for k, kind, content, thinking, tools in ((0, "user", stripped(F.coalesce(get(r, "$.message.text"), F.lit(""))), F.lit(None).cast("string"), F.array().cast(CALLS)), (1, "assistant", said, thought, calls))])
    out = rows.select("path", "session_id", "k", time.alias("timestamp"), F.coalesce("chosen", get(r, "$.modelId")).alias("model"), F.explode(both).alias("m"))
    out = out.select("path", "session_id", (F.col("k") * 2 + F.col("m.k2")).cast("long").alias("position"), "m.id", "m.type", "m.content", "m.thinking", "m.tool_calls", F.array().cast(RESULTS).alias("tool_results"), "model", F.lit(None).cast(USAGE).alias("usage"), "timestamp")
    return out.filter((F.col("content") != "") | (F.size("tool_calls") > 0))


# --- key-value stores ---------------------------------------------------------------------------------------


def _flatten(nodes: list) -> str:
    out = []
    for node in nodes:
        if isinstance(node.get("text"), str):
            out.append(node["text"])
        if node.get("type") == "linebreak":
            out.append("\n")
        if isinstance(node.get("children"), list):
            inner = _flatten(node["children"])
            out.append(inner + "\n" if inner and node.get("type") in BLOCK_NODES else inner)
    return "".join(out)


def rich_text(source: str | None) -> str | None:
    """The text of a rich-text tree as JSON; null if it is none."""
    try:
        text = _flatten(json.loads(source or "")["root"]["children"]).strip()
    except (ValueError, KeyError, TypeError, AttributeError):
        return None
    return text or None


@F.pandas_udf(T.StringType())
def _rich_text(column: pd.Series) -> pd.Series:
    return column.map(rich_text)


def kv_store(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, key and value of exported stores."""
    rows = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return rows.select(plain_path(F.col("_metadata.file_path")).alias("path"), "key", "value")


def kv_fingerprints(store: DataFrame) -> DataFrame:
    """path, fragment and fingerprint of each conversation of a store (path, key, value): of all values under its id, unparsed."""
    rows = store.filter(F.col("key").rlike("^(composerData|bubbleId):")).withColumn("fragment", F.get(F.split("key", ":"), F.lit(1)))
    each = F.xxhash64("key", "value").cast("decimal(38,0)")
    return rows.groupBy("path", "fragment").agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(each).cast("string")).alias("fingerprint"))


def kv_bubbles(store: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """path, composer, position, bubble (its id) and v of the bubbles of a key-value store (path, key, value).

    Conversations stand under `composerData:<id>`, whose bubbles stand inside, or apart under `bubbleId:<id>:<bubble>`
    in the order of headers, or in the list under `composer.composerData`. A store's own values win; what it
    lacks, a conversation's bubbles or all of it but its id, comes from the shared store. A bubble that is in neither
    is an error, as are two different bubbles of one id; equal ones count once.
    """
    if "path" not in store.columns:
        store = store.withColumn("path", F.lit(""))
    shared = store.select("key", "value").limit(0) if shared is None else shared.select("key", "value")
    c = F.col("c")
    listed = store.filter("key = 'composer.composerData'").withColumn("v", F.try_parse_json("value"))
    listed = listed.select("path", F.explode(F.concat(items(F.col("v"), "$.allComposers"), items(F.col("v"), "$.composers"))).alias("c")).select("path", get(c, "$.composerId").alias("composer"), c.alias("v"), F.lit(1).alias("place")).filter("composer IS NOT NULL")
    own = store.filter(F.col("key").startswith("composerData:")).select("path", F.substring_index("key", ":", -1).alias("composer"), F.try_parse_json("value").alias("v"), F.lit(0).alias("place"))
    first = F.row_number().over(W.partitionBy("path", "composer").orderBy("place"))
    rows = own.union(listed).withColumn("first", first).filter("first = 1").select("path", "composer", "v")

    def arrays(v: Column) -> tuple[Column, Column]:
        inline = F.coalesce(*[F.nullif(F.transform(items(v, f"$.{k}"), lambda b: F.to_json(b)), F.array().cast("array<string>")) for k in MESSAGE_ARRAY_KEYS])
        return inline, F.transform(items(v, "$.fullConversationHeadersOnly"), lambda h: get(h, "$.bubbleId"))

    whole = shared.filter(F.col("key").startswith("composerData:")).select(F.substring_index("key", ":", -1).alias("composer"), F.try_parse_json("value").alias("whole"))
    inline, headers = arrays(F.col("v"))
    rows = rows.select("path", "composer", inline.alias("inline"), headers.alias("headers"))
    inline, headers = arrays(F.col("whole"))
    filled = rows.filter(F.col("inline").isNull() & (F.size("headers") == 0)).select("path", "composer").join(whole, "composer").select("path", "composer", inline.alias("inline"), headers.alias("headers"))
    rows = rows.filter(F.col("inline").isNotNull() | (F.size("headers") > 0)).unionByName(filled)
    own = rows.select("path", "composer", F.posexplode("inline").alias("position", "value"))
    wanted = rows.filter("inline IS NULL").select("path", "composer", F.posexplode("headers").alias("position", "bubble")).select("path", "composer", "position", F.concat_ws(":", F.lit("bubbleId"), "composer", "bubble").alias("key"))
    found = wanted.join(store.select("path", "key", "value"), ["path", "key"], "left").join(shared.withColumnRenamed("value", "shared_value"), "key", "left")
    found = found.select("path", "composer", "position", F.coalesce("value", "shared_value", F.raise_error(F.concat(F.lit("missing bubble: "), "key")).cast("string")).alias("value"))
    bubbles = own.union(found).withColumn("v", F.try_parse_json("value")).withColumn("bubble", nonempty(get(F.col("v"), "$.bubbleId")))
    same = W.partitionBy("path", "composer", F.coalesce("bubble", F.concat(F.lit("#"), F.col("position"))))
    clash = F.min(F.to_json("v")).over(same) != F.max(F.to_json("v")).over(same)
    bubbles = bubbles.withColumn("again", F.row_number().over(same.orderBy("position"))).withColumn("bubble", F.when(clash, F.raise_error(F.concat(F.lit("conflicting bubble: "), "bubble")).cast("string")).otherwise(F.col("bubble")))
    return bubbles.filter("again = 1").select("path", "composer", "position", "bubble", "v")


def _block_paths(bubble: Column) -> Column:
    return F.filter(F.transform(items(bubble, "$.codeBlocks"), lambda c: F.coalesce(get(c, "$.uri.fsPath"), get(c, "$.uri.path"), get(c, "$.filePath"))), lambda x: x.isNotNull())


def root_of(absolute: Column, relative: Column) -> Column:
    """The folder that is left of the first absolute path that ends in one of the relative paths; null if none does."""
    slashes = lambda x: F.translate(x, "\\", "/")
    left = F.flatten(F.transform(absolute, lambda a: F.transform(relative, lambda r: F.when((a.startswith("/") | a.rlike("^[A-Za-z]:[/\\\\]")) & slashes(a).endswith(F.concat(F.lit("/"), slashes(r))), F.left(slashes(a), F.length(a) - F.length(r) - 1)))))
    return F.get(F.filter(left, lambda x: x.isNotNull()), F.lit(0))


def kv_roots(bubbles: DataFrame) -> DataFrame:
    """path, session_id and project_path of the conversations of kv_bubbles() whose bubbles tell a root, by the first that does."""
    root = root_of(_block_paths(F.col("v")), F.filter(F.transform(items(F.col("v"), "$.relevantFiles"), lambda r: F.when(F.schema_of_variant(r) == "STRING", r.cast("string"))), lambda x: x.isNotNull()))
    rows = bubbles.select("path", F.concat(F.lit("cursor:"), "composer").alias("session_id"), "position", root.alias("root")).filter("root IS NOT NULL")
    return rows.groupBy("path", "session_id").agg(F.min_by("root", "position").alias("project_path"))


def kv_messages(store: DataFrame, shared: DataFrame | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Messages of the conversations of a key-value store, see kv_bubbles(); of wanted (path, fragment) only, if given."""
    if wanted is not None:
        store = store.withColumn("fragment", F.get(F.split("key", ":"), F.lit(1))).join(wanted, ["path", "fragment"], "left_semi").drop("fragment")
    bubbles = kv_bubbles(store, shared)
    b = F.col("v")
    kind = F.when((get(b, "$.type") == "1") | (get(b, "$.role") == "user"), "user").when((get(b, "$.type") == "2") | (get(b, "$.role") == "assistant"), "assistant").otherwise("system")
    text, rich = nonempty(text_of(b, "$.text")), F.coalesce(text_of(b, "$.richText"), F.to_json(get(b, "$.richText", "variant")))
    tree = F.when(text.startswith('{"root"'), text).when(text.isNull(), rich)
    content = F.coalesce(_rich_text(tree), text, text_of(b, "$.richText"), text_of(b, "$.content"), F.lit(""))
    tool = F.coalesce(F.try_parse_json(text_of(b, "$.toolFormerData")), get(b, "$.toolFormerData", "variant"))
    name = F.coalesce(get(tool, "$.name"), get(tool, "$.toolName"))
    edits = _block_paths(b)
    calls = F.concat(F.when(name.isNotNull(), F.array(_tool(F.col("bubble"), name, F.lit(None).cast("string"))).cast(CALLS)).otherwise(F.array().cast(CALLS)), F.transform(edits, lambda x, k: F.struct(F.concat_ws("-", F.lit("codeblock"), F.col("position").cast("string"), k.cast("string")).alias("id"), F.lit("Edit").alias("name"), x.alias("path"))).cast(CALLS))
    sent = get(b, "$.timingInfo.clientRpcSendTime", "double")
    time = F.coalesce(F.try_to_timestamp(text_of(b, "$.createdAt")), F.when(sent > 1e12, F.timestamp_millis(sent.cast("long"))))
    session = F.concat(F.lit("cursor:"), "composer")
    rows = bubbles.select("path", F.col("composer").alias("fragment"), session.alias("session_id"), F.col("position").cast("long").alias("position"), F.coalesce("bubble", F.concat_ws("-", session, F.col("position").cast("string"))).alias("id"), kind.alias("type"), F.left(content, F.lit(10_000)).alias("content"), F.lit(None).cast("string").alias("thinking"), calls.alias("tool_calls"), F.array().cast(RESULTS).alias("tool_results"), F.lit(None).cast("string").alias("model"), F.lit(None).cast(USAGE).alias("usage"), time.alias("timestamp"))
    return rows.filter((F.col("content") != "") | (F.col("type") == "system"))


#: Readers by tool; each takes (spark, folder).
READERS = {
    "claude-code": lambda spark, path: jsonl_messages(jsonl_entries(spark, path)),
    "codex-cli": rollout_messages,
    "codex-cli-documents": rollout_document_messages,
    "copilot-cli": cli_event_messages,
    "copilot": editor_chat_messages,
    "cursor": lambda spark, path, wanted=None: kv_messages(kv_store(spark, path), wanted=wanted),
}
