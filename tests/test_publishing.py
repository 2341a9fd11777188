"""Publication of prepared analyses, and posts that a model wrote."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import markup
from tallyspark.streaming import ingest, publishing

STAGES = "session_id string, analysis_type string, input_revision string, session_message_count long, language string, pipeline_revision string"
PIPELINES = {"en": "v2", "de": "v3"}


def stages(spark, *sessions):
    rows = []
    for s, changes in sessions:
        for kind in publishing.PASSES:
            row = {"session_id": s, "analysis_type": kind, "input_revision": "r1", "session_message_count": 5, "language": "en", "pipeline_revision": "v2"}
            rows.append({**row, **changes.get(kind, {}), **changes.get("both", {})} if changes.get(kind, {}) is not None else None)
    return spark.createDataFrame([tuple(r.values()) for r in rows if r], STAGES)


def test_verdicts(spark):
    found = stages(
        spark, ("ok", {}), ("other language", {"both": {"language": "de", "pipeline_revision": "v3"}}), ("one pass", {"prompt_quality": None}), ("old", {"session": {"pipeline_revision": "v1"}}), ("no language", {"both": {"language": None}}),
        ("languages", {"session": {"language": "de", "pipeline_revision": "v3"}}), ("passes", {"session": {"input_revision": "r0"}}), ("gone", {}), ("changed", {"both": {"input_revision": "r0"}}), ("grown", {}),
    )
    now = [(s, "r1", 5) for s in ("ok", "other language", "one pass", "old", "no language", "languages", "passes", "changed")] + [("grown", "r1", 6)]
    got = {r["session_id"]: r["verdict"] for r in publishing.judged(found, spark.createDataFrame(now, "session_id string, input_revision string, message_count long"), PIPELINES).collect()}
    assert got == {"ok": "published", "other language": "published", "one pass": "incomplete", "old": "policy", "no language": "policy", "languages": "language", "passes": "passes", "gone": "gone", "changed": "changed", "grown": "changed"}


def test_what_is_refused_changes_nothing(spark, tmp_path):
    table = (tmp_path / "insights").as_uri()
    made = lambda *rows: spark.createDataFrame(rows, "session_id string, id string, title string")
    now = lambda *rows: spark.createDataFrame(rows, "session_id string, input_revision string, message_count long")
    held = lambda: sorted((r["session_id"], r["title"]) for r in ingest.current(spark, table).collect())
    first = publishing.publish(spark, table, stages(spark, ("a", {}), ("b", {})), now(("a", "r1", 5), ("b", "r1", 5)), PIPELINES, made(("a", "1", "x"), ("a", "2", "y"), ("b", "3", "z")), ingest.State())
    assert {r["verdict"] for r in first.collect()} == {"published"} and held() == [("a", "x"), ("a", "y"), ("b", "z")]
    prepared = ingest.newest(spark, table)
    # b's input has changed meanwhile: its old rows stay, a's are all replaced
    second = publishing.publish(spark, table, stages(spark, ("a", {}), ("b", {})), now(("a", "r1", 5), ("b", "r2", 5)), PIPELINES, made(("a", "4", "new"), ("b", "5", "never")), prepared)
    assert {r["session_id"]: r["verdict"] for r in second.collect()} == {"a": "published", "b": "changed"} and held() == [("a", "new"), ("b", "z")]
    # a writer that started before that is refused, and its rows are nowhere
    with pytest.raises(ingest.StaleWriter):
        publishing.publish(spark, table, stages(spark, ("b", {})), now(("b", "r1", 5)), PIPELINES, made(("b", "6", "late")), prepared)
    assert held() == [("a", "new"), ("b", "z")]


def test_posts(spark):
    def read(text, form="blog", how=markup.parsed_post):
        return spark.createDataFrame([(text,)], "t string").select(how(F.col("t"), form).alias("x")).first()["x"]

    whole = '\n---\ntitle: Say "hi": now\ntldr: "short"\ntags: [a, \'b c\',"d"]\n---\n\n body delve text \n'
    got = read(whole)
    assert (got["ok"], got["title"], got["tldr"], got["tags"], got["body"], got["cut_off"], got["prohibited"]) == (True, 'Say "hi": now', "short", ["a", "b c", "d"], "body delve text", True, ["delve"])
    assert got["markdown"] == '---\ntitle: "Say \\"hi\\": now"\ntags: [a, b c, d]\ntldr: "short"\n---\n\nbody delve text'
    assert read("no head")["error"] == "missing-frontmatter" and read("---\ntitle: x\n---\nb.")["error"] == "malformed-frontmatter" and read(None)["error"] == "missing-frontmatter"
    post = read("---\ntitle: x\n---\nFirst #not a tag\n\n#one #two_2 ", "linkedin")
    assert (post["ok"], post["title"], post["tags"], post["tldr"], post["markdown"]) == (True, "x", ["one", "two_2"], "", "First #not a tag\n\n#one #two_2")
    assert read("---\ntitle: x\n---\nno tags.", "linkedin")["tags"] == [] and read("---\nname: x\n---\nb", "linkedin")["error"] == "malformed-frontmatter"
    poor = read("intro\n## Some heading\nrest", how=markup.read_post)
    assert (poor["ok"], poor["degraded"], poor["title"], poor["body"], poor["tags"]) == (True, True, "Some heading", "intro\n## Some heading\nrest", [])
    assert read("", how=markup.read_post)["title"] == "Untitled" and read(whole, how=markup.read_post)["degraded"] is False
