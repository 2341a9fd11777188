"""Protocol frames, tags and blocks of texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions import nested, texts

# Tags, attributes and words that results depend on.
STRIPPED_TAGS = ("command-message", "command-args")
COMMAND_TAG, OUTPUT_TAG = "command-name", "local-command-stdout"
TASK_TAGS = ("task_id", "status", "summary", "result")
USAGE_FIELDS = ("total_tokens", "duration", "tool_uses")
TEAMMATE_ATTRIBUTES = ("teammate_id", "color")
TEAMMATE_FIELDS = ("from", "type", "summary", "content")
CREDENTIAL_KEYS = "apikey|authorization|token|secret|password|credential|auth"
SAFE_KEYS = "^(?:input|output|cachecreation|cacheread)tokens$"
CREDENTIAL_VALUES = (
    r"(?i)\bBearer\s+[^\s,;]+",
    r"\bsk-[A-Za-z0-9._-]{6,}",
    r"(?i)\b(?:x[-_]?api[-_]?key|api[-_]?key|authorization|access[-_]?token|refresh[-_]?token)\s*[:=]\s*[^\s,;]+",
)
#: What posts call the types of insights.
TYPE_LABELS = {"learning": "Learning", "decision": "Decision", "technique": "Technique", "summary": "Summary", "prompt_quality": "Observation"}
# End of fixed values.


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def tag(text: Column, name: str) -> Column:
    """What stands in the first tag of this name; null without one."""
    return F.when(text.rlike(rf"(?s)<{name}>.*?</{name}>"), stripped(F.regexp_extract(text, rf"(?s)<{name}>(.*?)</{name}>", 1)))


def found(text: Column, pattern: str) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def task_notification(text: Column) -> Column:
    """A struct of the fields of a task's notification."""
    usage = tag(text, "usage")
    after = F.when(F.instr(text, "</task-notification>") > 0, F.split(text, "</task-notification>")[1])
    return F.struct(*[tag(text, t).alias(t) for t in TASK_TAGS], *[found(usage, rf"{f}:\s*(\S+)").alias(f) for f in USAGE_FIELDS], found(after, r"(?m)^\s*(/\S+)").alias("transcript_path"))


def teammate_message(text: Column) -> Column:
    """A struct of a message between agents: attributes, fields of its JSON, and the raw content."""
    opening = F.regexp_extract(text, "<teammate-message([^>]*)>", 1)
    inner = F.coalesce(found(text, r"(?s)<teammate-message[^>]*>(.*?)</teammate-message>"), text)
    raw = stripped(inner)
    v = nested.variant(raw)
    return F.struct(*[found(opening, rf'{a}="([^"]*)"').alias(a) for a in TEAMMATE_ATTRIBUTES], *[nested.text_field(v, f"$.{f}").alias(f) for f in TEAMMATE_FIELDS], raw.alias("raw"))


def shown_user_text(text: Column) -> Column:
    """A user text as the page shows it: commands in code marks, frames gone, outputs as blocks."""
    out = text
    for name in STRIPPED_TAGS:
        out = F.regexp_replace(out, rf"(?s)<{name}>.*?</{name}>", "")
    out = F.regexp_replace(out, rf"<{COMMAND_TAG}>(/[^<]*)</{COMMAND_TAG}>", "`$1`")
    out = F.regexp_replace(out, rf"(?s)<{OUTPUT_TAG}>\s*</{OUTPUT_TAG}>", "")
    out = F.regexp_replace(out, rf"(?s)<{OUTPUT_TAG}>\s*(.*?)\s*</{OUTPUT_TAG}>", "\n```\n$1\n```")
    return stripped(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def meta_line(compacts: Column, auto_compacts: Column, commands: Column) -> Column:
    """What a prompt says of a session's compactions and commands; empty without any."""
    total = F.coalesce(compacts, F.lit(0)) + F.coalesce(auto_compacts, F.lit(0))
    kinds = F.concat_ws(", ", F.when(auto_compacts > 0, F.concat(auto_compacts.cast("string"), F.lit(" auto"))), F.when(compacts > 0, F.concat(compacts.cast("string"), F.lit(" manual"))))
    first = F.when(total > 0, F.concat(total.cast("string"), F.lit(" context compaction"), F.when(total > 1, "s").otherwise(""), F.lit(" ("), kinds, F.lit(") — session exceeded context window")))
    second = F.when(F.size(commands) > 0, F.concat(F.lit("slash commands used: "), F.array_join(commands, ", ")))
    return F.when(first.isNull() & second.isNull(), "").otherwise(F.concat(F.lit("Context signals: "), F.concat_ws("; ", first, second), F.lit("\n")))


def has_credential(json_text: Column) -> Column:
    """Does a JSON text have a key that is called like a credential, at any depth, or a value that looks like one?"""
    keys = F.transform(F.regexp_extract_all(json_text, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1)), lambda k: F.lower(F.regexp_replace(k, "[-_]", "")))
    named = F.exists(keys, lambda k: k.rlike(CREDENTIAL_KEYS) & ~k.rlike(SAFE_KEYS))
    value = F.lit(False)
    for pattern in CREDENTIAL_VALUES:
        value = value | json_text.rlike(pattern)
    return F.coalesce(named | value, F.lit(False))


def insight_block(number: Column, kind: Column, summary: Column, content: Column, bullets: Column) -> Column:
    """An insight in the context of a post; bullets only under 40 words."""
    short = (F.size(F.split(content, " ")) < 40) & (F.size(bullets) > 0)
    lines = F.when(short, F.concat(F.lit("\n"), F.array_join(F.transform(bullets, lambda b: F.concat(F.lit("- "), b)), "\n"))).otherwise("")
    label = F.upper(F.translate(kind, "_", " "))
    for name, shown in TYPE_LABELS.items():
        label = F.when(kind == name, shown.upper()).otherwise(label)
    return F.concat(F.lit("["), label, F.lit(" "), number.cast("string"), F.lit("]\nSummary: "), summary, F.lit("\n"), content, lines)


def background_block(title: Column, character: Column, summary: Column) -> Column:
    """A session that insights come from, in the context of a post; null without a summary."""
    kind = F.when(character != "", F.concat(F.lit(" ("), F.translate(character, "_", " "), F.lit(")"))).otherwise("")
    head = F.lit("---\n\nSESSION BACKGROUND (1 session contributed these insights):\n\n[Session: \"")
    return F.concat(head, title, F.lit("\""), F.coalesce(kind, F.lit("")), F.lit("]\n"), summary, F.lit("\n\n"))


def frontmatter(post: Column, key: str) -> Column:
    """A value of the head between `---` lines of a post; null without one."""
    head = F.regexp_extract(post, r"(?s)\A---\s*\n(.*?)\n---", 1)
    return found(head, rf'(?m)^{key}:\s*"?([^"\n]*?)"?\s*$')


POST = "struct<ok:boolean,error:string,degraded:boolean,title:string,tldr:string,tags:array<string>,body:string,markdown:string,cut_off:boolean,prohibited:array<string>>"
# Words that posts are asked not to use, and the shapes of a post: head and body, a line of the head, its tags, hashtags at the end, a heading.
PROHIBITED = ("leveraged", "utilized", "seamlessly", "delve")
WHOLE_POST = r"(?s)\A\s*---\n(.*?)\n---\n(.*)\z"
HEAD_LINE = r'(?m)^{0}:\s*"?(.+?)"?\s*$'
HEAD_TAGS = r"(?m)^tags:\s*\[(.+?)\]"
LAST_TAGS = r"(?:^|\n)((?:#[a-zA-Z]\w*(?:\s+|\z))+)\z"
HEADING = r"(?m)^#+\s+(.+)$"
# End of fixed values.


def parsed_post(raw: Column, form: str = "blog") -> Column:
    """A post as a model wrote it, read: head (title, and of a blog tldr and tags, of linkedin the last line's hashtags) and body; ok is false, with an error, for posts that have no such head."""
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    head, body = F.regexp_extract(raw, WHOLE_POST, 1), trim(F.regexp_extract(raw, WHOLE_POST, 2))
    value = lambda key: found(head, HEAD_LINE.format(key))
    lower = F.lower(body)
    words = F.filter(F.array(*[F.lit(w) for w in PROHIBITED]), lambda w: F.contains(lower, w))
    null = F.lit(None).cast("string")
    title, tldr = (F.replace(value(k), F.lit('\\"'), F.lit('"')) for k in ("title", "tldr"))
    if form == "linkedin":
        last = F.regexp_extract(body, LAST_TAGS, 1)
        tags = F.when(last != "", F.transform(F.split(trim(last), r"\s+"), lambda t: F.regexp_replace(t, "^#", ""))).otherwise(F.array().cast("array<string>"))
        title, tldr, markdown, bad = value("title"), F.lit(""), body, value("title").isNull()
    else:
        listed = found(head, HEAD_TAGS)
        tags = F.when(listed.isNotNull(), F.transform(F.split(listed, ","), lambda t: F.regexp_replace(trim(t), "^['\"]|['\"]$", ""))).otherwise(F.array().cast("array<string>"))
        quoted = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        markdown = F.concat(F.lit('---\ntitle: "'), quoted(title), F.lit('"\ntags: ['), F.array_join(tags, ", "), F.lit(']\ntldr: "'), quoted(tldr), F.lit('"\n---\n\n'), body)
        bad = value("title").isNull() | value("tldr").isNull()
    cut = (body != "") & ~body.rlike(r"[.!?]\z")
    fields = ("ok", "error", "degraded", "title", "tldr", "tags", "body", "markdown", "cut_off", "prohibited")
    make = lambda *values: F.struct(*[v.alias(n) for n, v in zip(fields, values)]).cast(POST)
    none = F.lit(None).cast("array<string>")
    refused = lambda error: make(F.lit(False), F.lit(error), F.lit(False), null, null, none, null, null, F.lit(None).cast("boolean"), none)
    read = make(F.lit(True), null, F.lit(False), title, tldr, tags, body, markdown, cut, words)
    return F.when(~F.coalesce(raw.rlike(WHOLE_POST), F.lit(False)), refused("missing-frontmatter")).when(bad, refused("malformed-frontmatter")).otherwise(read)


def degraded_post(raw: Column) -> Column:
    """What is made of a post that can't be read: all of it, under its first heading."""
    title = F.coalesce(found(raw, HEADING), F.lit("Untitled"))
    none = F.array().cast("array<string>")
    values = {"ok": F.lit(True), "error": F.lit(None).cast("string"), "degraded": F.lit(True), "title": title, "tldr": F.lit(""), "tags": none, "body": raw, "markdown": raw, "cut_off": F.lit(False), "prohibited": none}
    return F.struct(*[v.alias(n) for n, v in values.items()]).cast(POST)


def read_post(raw: Column, form: str = "blog") -> Column:
    """parsed_post(), or degraded_post() of what it refuses."""
    return F.transform(F.array(parsed_post(raw, form)), lambda p: F.when(p["ok"], p).otherwise(degraded_post(raw)))[0]


def hashtags(post: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(post, F.lit(r"(?<![\w&])#(\w+)"), F.lit(1)))


def without_preamble(post: Column) -> Column:
    """From the head or the first heading on, if a model says something before it."""
    return F.when(post.rlike(r"(?m)^(?:---\s*$|# )"), F.regexp_replace(post, r"(?s)\A.*?(?=(?m:^(?:---\s*$|# )))", "")).otherwise(post)
