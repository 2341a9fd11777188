"""What happens to the answers of a model: finding their JSON, checking it, turning it into rows.

The call of the model itself is the caller's. The two Python functions here are small and per value: a balanced
scan of brackets and the repair of what a cut answer lacks.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions import nested
from tallyspark.operators import state
from tallyspark.sources.transcripts import get, items, nonempty, text_of

LEAST_CONFIDENCE, SUMMARY_CHARS, CHUNK_CHARS = 70, 200, 80_000 * 4


def balanced_json(text: str | None) -> str | None:
    """The tagged JSON of an answer, else its first balanced object or array that parses, else the first that stands there."""
    if not text:
        return None
    tagged = re.search(r"<json>\s*(.*?)\s*</json>", text, re.S | re.I)
    if tagged:
        return tagged[1].strip() or None
    first, at = None, 0
    while m := re.compile(r"[\[{]").search(text, at):
        depth, end = 0, None
        for part in re.compile(r'"(?:\\.|[^"\\])*"?|[\[{]|[\]}]', re.S).finditer(text, m.start()):
            depth += {"[": 1, "{": 1, "]": -1, "}": -1}.get(part[0], 0)
            if not depth:
                end = part.end()
                break
        found = text[m.start() : end].strip()
        first = found if first is None else first
        if end is None:  # cut off: the rest is for repair
            return first
        try:
            json.loads(found)
            return found
        except ValueError:
            at = end
    return first


def repaired_json(text: str | None) -> str | None:
    """JSON without trailing commas, with its open strings and brackets closed; null if that is no JSON either."""
    if not text:
        return None
    out, stack, quoted, escaped = [], [], False, False
    for c in text.strip():
        if quoted:
            quoted, escaped = escaped or c != '"', not escaped and c == "\\"
        elif c == '"':
            quoted = True
        elif c in "[{":
            stack.append("]" if c == "[" else "}")
        elif c in "]}":
            while out and (out[-1].isspace() or out[-1] == ","):
                out.pop()
            if stack:
                stack.pop()
        out.append(c)
        if not stack and c in "]}" and not quoted:
            break
    tail = ('"' if quoted else "") + "".join(reversed(stack))
    for closed in ("".join(out) + tail, re.sub(r"[,:]\s*$", "", "".join(out)) + tail):
        try:
            return json.dumps(json.loads(closed), ensure_ascii=False)
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def json_payload(answers: pd.Series) -> pd.Series:
    return answers.map(lambda a: repaired_json(balanced_json(a)))


def insight_rows(answers: DataFrame) -> DataFrame:
    """session_id, type, title, content, summary, confidence, bullets of answers (session_id, answer): a summary, and decisions and learnings of enough confidence."""
    v = F.col("v")
    parsed = answers.select("session_id", nested.variant(json_payload("answer")).alias("v")).filter(text_of(v, "$.summary.title").isNotNull())
    strings = lambda x, path: F.coalesce(get(x, path, "array<string>"), F.array().cast("array<string>"))
    row = lambda kind, title, content, short, confidence, bullets: F.struct(F.lit(kind).alias("type"), title.alias("title"), content.alias("content"), F.left(short, F.lit(SUMMARY_CHARS)).alias("summary"), confidence.alias("confidence"), bullets.alias("bullets"))

    def sure(x: Column, default: int) -> Column:
        return F.coalesce(nested.number_field(x, "$.confidence"), F.lit(float(default)))

    def decision(x: Column) -> Column:
        situation, choice = nonempty(text_of(x, "$.situation")), nonempty(text_of(x, "$.choice"))
        content = F.coalesce(F.concat(situation, F.lit(" → "), choice), choice, situation, text_of(x, "$.title"))
        others = F.transform(F.filter(items(x, "$.alternatives"), lambda a: nonempty(text_of(a, "$.option")).isNotNull()), lambda a: F.concat(text_of(a, "$.option"), F.lit(": "), F.coalesce(nonempty(text_of(a, "$.rejected_because")), F.lit("no reason given"))))
        return row("decision", text_of(x, "$.title"), content, F.coalesce(choice, content), sure(x, 85) / 100, others)

    def learning(x: Column) -> Column:
        content = F.coalesce(nonempty(text_of(x, "$.takeaway")), text_of(x, "$.title"))
        return row("learning", text_of(x, "$.title"), content, content, sure(x, 80) / 100, F.array().cast("array<string>"))

    enough = lambda path, default: F.filter(items(v, path), lambda x: sure(x, default) >= LEAST_CONFIDENCE)
    told = text_of(v, "$.summary.content")
    # a summary is never cut
    head = F.struct(F.lit("summary").alias("type"), text_of(v, "$.summary.title").alias("title"), told.alias("content"), told.alias("summary"), F.lit(0.9).alias("confidence"), strings(v, "$.summary.bullets").alias("bullets"))
    every = F.concat(F.array(head), F.transform(enough("$.decisions", 85), decision), F.transform(enough("$.learnings", 80), learning))
    return parsed.select("session_id", F.explode(every).alias("x")).select("session_id", "x.*")


def evidence(value: Column, users: Column, assistants: Column) -> Column:
    """`User#3` or `Assistant#0:note` in normal form, if the session has that many turns; else null."""
    form = r"^\s*(User|Assistant)\s*#\s*(\d+)(:[\s\S]*?)?\s*$"
    role, number = F.regexp_extract(value, form, 1), F.regexp_extract(value, form, 2)
    index = F.try_to_number(nonempty(number), F.lit("9999999999")).cast("long")
    return F.when((role != "") & (index < F.when(role == "User", users).otherwise(assistants)), F.concat(role, F.lit("#"), index.cast("string"), F.regexp_extract(value, form, 3)))


def checked_evidence(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """rows (session_id, type, evidence array) with references that exist (bounds: session_id, users, assistants); decisions and learnings without any go."""
    kept = F.filter(F.transform("evidence", lambda e: evidence(e, F.col("users"), F.col("assistants"))), lambda e: e.isNotNull())
    joined = rows.join(bounds, "session_id").withColumn("evidence", kept)
    return joined.filter(~F.col("type").isin("decision", "learning") | (F.size("evidence") > 0)).select(*rows.columns)


def chunks(transcripts: DataFrame, most_chars: int = CHUNK_CHARS) -> DataFrame:
    """session_id, chunk, text of transcripts (session_id, text): messages, which blank lines and marks separate, are dealt in order to chunks of bounded size; a longer message is cut."""
    parts = F.split("text", r"\n\n(?=### )")
    pieces = F.flatten(F.transform(parts, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(p), F.lit(1)) - 1) / most_chars).cast("int")), lambda k: F.substring(p, k * most_chars + 1, F.lit(most_chars)))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    step = lambda a, p: F.when(F.length(a["open"]) + F.length(p) + 2 <= most_chars, F.struct(a["done"].alias("done"), F.when(a["open"] == "", p).otherwise(F.concat(a["open"], F.lit("\n\n"), p)).alias("open"))).otherwise(F.struct(F.when(a["open"] == "", a["done"]).otherwise(F.array_append(a["done"], a["open"])).alias("done"), p.alias("open")))
    dealt = F.aggregate(pieces, start, step, lambda a: F.array_append(a["done"], a["open"]))
    return transcripts.select("session_id", F.posexplode(dealt).alias("chunk", "text"))


def type_rank(kind: Column) -> Column:
    """Where a type of insight stands on a page; unknown types come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in state.INSIGHT_TYPES]), kind), F.lit(0)), F.lit(len(state.INSIGHT_TYPES) + 1))


def write_pages(pages: DataFrame, folder: str, name: str = "id") -> None:
    """Pages (name, text) as text files, one below a folder of its own for each name: written by the tasks that hold them, nothing passes the driver."""
    pages.select(F.col(name).alias("page"), F.regexp_replace("text", "\n$", "").alias("value")).repartition("page").sortWithinPartitions("page").write.partitionBy("page").text(folder)


def markdown(sessions: DataFrame, insights: DataFrame) -> DataFrame:
    """id and text: a session's page for a knowledge base, its insights by type and time. An exported session's insights meet in one row, as its page does."""
    line = F.concat(F.lit("### "), "title", F.lit("\n\n"), "content")
    grouped = insights.groupBy(F.col("session_id").alias("id"), "type").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("timestamp", F.col("id").alias("k"), line.alias("t")))), lambda x: x["t"]), "\n\n").alias("part"))
    parts = grouped.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(type_rank(F.col("type")).alias("rank"), "type", "part"))), lambda x: F.concat(F.lit("## "), F.initcap(F.translate(x["type"], "_", " ")), F.lit("\n\n"), x["part"])), "\n\n").alias("body"))
    head = F.concat(F.lit("# "), "title", F.lit("\n\n"), F.lit("Project: "), "project_name", F.lit("\nDate: "), F.date_format("started_at", "yyyy-MM-dd"))
    return sessions.join(parts, "id").select("id", F.concat(head, F.lit("\n\n"), "body", F.lit("\n")).alias("text"))
