"""More registered queries: titles, formats, views, reports and writes of facets. They join those of queries.py."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import categories, costs, formats, markup, nested, texts, times
from tallyspark.operators import activity, facets, quality, reflect, scope, state, stats, titles, views
from tallyspark.plans import adapters
from tallyspark.streaming import publishing
from tallyspark.plans.queries import _STRENGTHS, EVENTS_NOW, ORACLES, ORDERS_NOW, SQL_SCORE, SQL_TITLE, Tables, query, sql_category, sql_text, sql_time, when_text

TODAY = date(2024, 3, 1)

# --- titles and formats -------------------------------------------------------------------------------------

@query("title_candidates", "messages", rf"""+
asked AS (SELECT session_id, id, trim(content) AS c, row_number() OVER (PARTITION BY session_id ORDER BY messages.timestamp, position) AS r FROM messages WHERE type = 'user' QUALIFY r <= 3),
cut AS (SELECT session_id, r, c, len(regexp_split_to_array(c, '\s+')) AS words, CASE WHEN len(regexp_split_to_array(c, '\s+')) > 50 THEN CASE WHEN length(regexp_split_to_array(c, '[.!?]')[1]) > 10 THEN regexp_split_to_array(c, '[.!?]')[1]
  ELSE array_to_string(regexp_split_to_array(c, '\s+')[1:20], ' ') END ELSE c END AS t FROM asked),
scored AS (SELECT session_id, r, t, words, c, {SQL_SCORE.format("t")} AS score FROM (SELECT *, len(regexp_split_to_array(t, '\s+')) AS n FROM cut)),
best AS (SELECT session_id, arg_min(t, r) AS t, arg_min(score, r) AS score FROM scored WHERE score > 0 AND words >= 3
  AND NOT regexp_matches(c, '(?i)^(yes|no|ok|okay|sure|thanks|thank you|continue|go ahead|sounds good|looks good|perfect|great|nice|cool|done|got it)\.?$') AND NOT starts_with(c, '```') GROUP BY session_id)
SELECT s.session_id, t AS text, CAST(score AS BIGINT) AS score FROM (SELECT DISTINCT session_id FROM messages WHERE type = 'user') s LEFT JOIN best USING (session_id)""")
def title_candidates(t: Tables) -> DataFrame:
    return titles.user_candidates(t.messages).select("session_id", "best.text", F.col("best.score").cast("long").alias("score"))


@query("primary_files", "messages", """
SELECT session_id, CASE conv_id % 6 WHEN 3 THEN 'one' WHEN 5 THEN 'f0' ELSE 'f' || min(turn) END AS file FROM messages
WHERE conv_id % 6 IN (1, 4) OR (conv_id % 6 = 3 AND turn < 2) OR (conv_id % 6 = 5 AND turn = 0) GROUP BY session_id, conv_id""")
def primary_files(t: Tables) -> DataFrame:
    return titles.primary_files(t.messages)


def _first_named(pattern: str, text: str = "lower(content)") -> str:
    """Of a session's user texts what the first that has a pattern names by it."""
    return f"arg_min(trim(regexp_extract({text}, {sql_text(pattern)}, 1)), (messages.timestamp, position)) FILTER (regexp_matches({text}, {sql_text(pattern)}))"


@query("title_sources", "messages", f"""+
named AS (SELECT session_id, {_first_named(titles.TOPICS[0])} AS t0, {_first_named(titles.TOPICS[1])} AS t1, {_first_named(titles.BUG, "content")} AS bug FROM messages WHERE type = 'user' GROUP BY 1),
chars AS ({ORACLES["session_characters"]}), files AS ({ORACLES["primary_files"]}), cands AS ({ORACLES["title_candidates"]}),
told AS (
  SELECT c.session_id, message_count, character, text, score, coalesce(file, 'files') AS file, coalesce(nullif(coalesce(t0, t1), ''), 'project') AS topic, nullif(bug, '') AS bug, CASE WHEN CAST(c.session_id AS BIGINT) % 5 = 0 THEN 'please look at ' || c.session_id END AS summary
  FROM chars c LEFT JOIN named USING (session_id) LEFT JOIN files USING (session_id) LEFT JOIN cands USING (session_id)),
judged AS (SELECT *, CASE WHEN summary IS NOT NULL THEN 'claude' WHEN score >= 40 THEN 'user_message' WHEN character IS NOT NULL THEN 'character' WHEN text IS NOT NULL THEN 'user_message' ELSE 'fallback' END AS source FROM told)
SELECT session_id, source, CASE WHEN source = 'character' THEN character END AS character, CASE source WHEN 'claude' THEN {SQL_TITLE.format("summary")} WHEN 'user_message' THEN {SQL_TITLE.format("text")}
  WHEN 'character' THEN CASE character WHEN 'deep_focus' THEN 'Deep work: ' || file WHEN 'bug_hunt' THEN 'Fixed: ' || coalesce(bug, file) WHEN 'feature_build' THEN 'Built: ' || topic WHEN 'exploration' THEN 'Explored: ' || topic
    WHEN 'refactor' THEN 'Refactored: ' || file WHEN 'learning' THEN 'Learned: ' || topic ELSE 'Updated: ' || file END
  ELSE 'project session (' || message_count || ' messages)' END AS title FROM judged""")
def title_sources(t: Tables) -> DataFrame:
    """Every session's title and where it comes from; sessions of every fifth conversation have a summary."""
    k = F.col("session_id").cast("long")
    sessions = t.messages.select("session_id").distinct().select("session_id", F.lit("project").alias("project_name"), F.when(k % 5 == 0, F.concat(F.lit("please look at "), "session_id")).alias("summary"))
    return titles.generated_titles(sessions, t.messages)


_FIXED = "format('{{:,.{1}f}}', CASE WHEN ({0}) * {2} % 2 = 1 THEN ({0}) + {3} ELSE ({0})::DOUBLE END)"


def _sql_fixed(x: str, digits: int) -> str:
    return _FIXED.format(x, digits, 2 ** (digits + 1), 10.0 ** -(digits + 2))


@query("formatted_numbers", "sessions", f"""
SELECT id, '$' || {_sql_fixed('estimated_cost_usd', 2)} AS money, CASE WHEN k >= 1000000 THEN {_sql_fixed('k / 1000000', 1)} || 'M' WHEN k >= 1000 THEN CAST(CAST(floor(k / 1000 + 0.5) AS BIGINT) AS VARCHAR) || 'K' ELSE format('{{:,}}', CAST(k AS BIGINT)) END AS tokens,
  CASE WHEN k >= 1000000 THEN {_sql_fixed('k / 1000000', 1)} || 'M' WHEN k >= 1000 THEN {_sql_fixed('k / 1000', 1)} || 'K' ELSE format('{{:,}}', CAST(k AS BIGINT)) END AS token_count,
  CASE WHEN p >= 10 THEN CAST(CAST(floor(p + 0.5) AS BIGINT) AS VARCHAR) ELSE {_sql_fixed('p', 1)} END || '%' AS percent,
  CASE WHEN c = 0 THEN '$0.00' WHEN c >= 0.1 THEN '$' || {_sql_fixed('c', 2)} ELSE '$' || {_sql_fixed('c', 3)} END AS small
FROM (SELECT *, total_input_tokens::DOUBLE AS k, (message_count * 100.0::DOUBLE) / 32 AS p, (message_count / 16.0::DOUBLE) AS c FROM sessions)""")
def formatted_numbers(t: Tables) -> DataFrame:
    n = F.col("message_count")
    return t.sessions.select("id", formats.money(F.col("estimated_cost_usd")).alias("money"), formats.tokens(F.col("total_input_tokens")).alias("tokens"), formats.token_count(F.col("total_input_tokens")).alias("token_count"), formats.percent(n * 100.0 / 32).alias("percent"), formats.small_cost(n / 16.0).alias("small"))


@query("estimated_token_labels", "sessions", """
SELECT id, CASE WHEN e = 0 THEN '' WHEN e >= 1000 THEN '~' || CAST(floor(e / 1000 + 0.5) AS BIGINT) || 'K tokens' ELSE '~' || CAST(floor(e + 0.5) AS BIGINT) || ' tokens' END AS label
FROM (SELECT id, CASE WHEN least(coalesce(total_input_tokens, 0) * 0.03::DOUBLE, 80000) = 0 AND message_count > 0 THEN least(message_count * 500.0::DOUBLE, 80000) ELSE least(coalesce(total_input_tokens, 0) * 0.03::DOUBLE, 80000) END AS e FROM sessions)""")
def estimated_token_labels(t: Tables) -> DataFrame:
    return t.sessions.select("id", formats.estimated_tokens(F.col("total_input_tokens"), F.col("message_count")).alias("label"))


@query("relative_dates", "sessions", """
SELECT id, CASE WHEN m < 60 THEN greatest(1, CAST(floor(m + 0.5) AS BIGINT)) || 'm ago' WHEN m < 1440 THEN CAST(floor(m / 60 + 0.5) AS BIGINT) || 'h ago' WHEN m < 2880 THEN 'yesterday' WHEN m < 10080 THEN CAST(floor(m / 1440 + 0.5) AS BIGINT) || 'd ago'
  ELSE strftime(started_at::TIMESTAMP, '%b %-d') END AS label FROM (SELECT *, (epoch_us(TIMESTAMP '2001-08-02') - epoch_us(started_at::TIMESTAMP)) / 60000000.0::DOUBLE AS m FROM sessions)""")
def relative_dates(t: Tables) -> DataFrame:
    return t.sessions.select("id", formats.relative_date(F.col("started_at"), ORDERS_NOW).alias("label"))


# --- views --------------------------------------------------------------------------------------------------


@query("session_type_counts", "insights", "SELECT session_id, type, count(*) AS count FROM insights GROUP BY 1, 2")
def session_type_counts(t: Tables) -> DataFrame:
    return views.session_type_counts(t.insights)


_DAY = "CASE WHEN d = DATE '2024-03-01' THEN 'Today' WHEN d = DATE '2024-02-29' THEN 'Yesterday' WHEN year(d) = 2024 THEN strftime(d, '%A, %b %-d') ELSE strftime(d, '%A, %b %-d, %Y') END"
for _view, _key in (("timeline", f"(SELECT {_DAY} FROM (SELECT insights.timestamp::DATE AS d))"), ("type", "type"), ("project", "project_id"), ("session", "session_id")):
    query(f"insight_groups_{_view}", "insights", f"SELECT {_key} AS key, count(*) AS count, {sql_time('max(insights.timestamp)', 'latest')} FROM insights GROUP BY 1")(
        lambda t, view=_view: views.grouped(t.insights, view, TODAY).select("key", "count", when_text("latest"))
    )


@query("session_outcomes", "facets", "SELECT session_id, arg_max(outcome_satisfaction, extracted_at) AS outcome FROM facets GROUP BY 1")
def session_outcomes(t: Tables) -> DataFrame:
    return views.last_outcomes(t.facets)


@query("session_scores", "pq", "SELECT session_id, CAST(arg_max(doc_id % 101, doc_id) AS DOUBLE) AS score FROM pq WHERE kind IN ('full', 'legacy') GROUP BY 1")
def session_scores(t: Tables) -> DataFrame:
    return views.last_scores(t.pq, facets.quality_score(F.col("metadata")))


@query("filtered_sessions", "sessions live facets insights", """
SELECT live.id FROM live LEFT JOIN facets ON session_id = live.id WHERE session_character = 'building' AND live.id IN (SELECT session_id FROM insights)
  AND contains(lower(CASE WHEN coalesce(custom_title, '') <> '' THEN custom_title WHEN coalesce(generated_title, '') <> '' THEN generated_title WHEN coalesce(summary, '') <> '' THEN summary ELSE 'Untitled Session' END || chr(10) || project_name), '0')
  AND started_at >= TIMESTAMP '1996-01-01' AND (outcome_satisfaction IS NULL OR outcome_satisfaction = 'high')""")
def filtered_sessions(t: Tables) -> DataFrame:
    return views.filter_sessions(t.live, views.last_outcomes(t.facets), t.insights, "building", "analyzed", "0", "high", ("1996-01-01", None)).select("id")


@query("filtered_insights", "sessions insights", """
SELECT id FROM insights WHERE type IN ('decision', 'learning') AND (contains(lower(title), 'th') OR contains(lower(content), 'th')) AND session_id IN (SELECT id FROM sessions WHERE source_tool = 'ASIA')""")
def filtered_insights(t: Tables) -> DataFrame:
    return views.filter_insights(t.insights, t.sessions, ("decision", "learning"), "th", "ASIA").select("id")


@query("latest_session", "sessions live", f"SELECT id, {sql_time('started_at')} FROM live ORDER BY live.started_at DESC, id LIMIT 1")
def latest_session(t: Tables) -> DataFrame:
    return views.latest_session(t.live).select("id", when_text("started_at"))


@query("primary_session", "sessions live insights", "SELECT live.id, n AS insights FROM live JOIN (SELECT session_id, count(*) AS n FROM insights GROUP BY 1 HAVING count(*) >= 2) ON session_id = live.id ORDER BY started_at DESC, live.id LIMIT 1")
def primary_session(t: Tables) -> DataFrame:
    return views.primary_session(t.insights, t.live).select("id", "insights")


@query("matching_messages", "messages", "SELECT id FROM messages WHERE contains(lower(content), 'test')")
def matching_messages(t: Tables) -> DataFrame:
    return views.matching_messages(t.messages, "TEST")


@query("prompt_messages", "sessions live messages", "SELECT m.id AS message_id FROM live JOIN messages m ON m.session_id = live.id WHERE type = 'user' ORDER BY started_at DESC, m.timestamp, m.id LIMIT 500")
def prompt_messages(t: Tables) -> DataFrame:
    return views.prompt_messages(t.live, t.messages).select("message_id")


@query("tool_outputs", "messages", """
SELECT session_id, 'c' || turn AS id, 'Edit' AS name, CASE WHEN turn % 3 <> 0 THEN 'out ' || turn END AS output FROM messages""")
def tool_outputs(t: Tables) -> DataFrame:
    """Each message calls a tool; the answers of two thirds stand in the same message."""
    n = F.col("position")
    call = F.array(F.struct(F.concat(F.lit("c"), n).alias("id"), F.lit("Edit").alias("name")))
    results = F.when(n % 3 != 0, F.array(F.struct(F.concat(F.lit("c"), n).alias("id"), F.concat(F.lit("out "), n).alias("output")))).otherwise(F.array().cast("array<struct<id:string,output:string>>"))
    return views.tool_outputs(t.messages.withColumn("tool_calls", call).withColumn("tool_results", results))


@query("session_backgrounds", "sessions live insights", """
SELECT live.id, coalesce(custom_title, generated_title, 'Untitled') AS title, n AS insights FROM live JOIN (SELECT session_id, count(*) AS n FROM insights GROUP BY 1) ON session_id = live.id
WHERE summary IS NOT NULL AND summary <> '' ORDER BY n DESC, live.id LIMIT 4""")
def session_backgrounds(t: Tables) -> DataFrame:
    return views.session_backgrounds(t.insights, t.live).select("id", "title", "insights")


@query("exported_insights", "sessions live insights", "SELECT id, session_id FROM insights WHERE session_id IN (SELECT id FROM live ORDER BY started_at DESC, id LIMIT 100)")
def exported_insights(t: Tables) -> DataFrame:
    return views.exported(t.sessions, t.insights).select("id", "session_id")


@query("session_pages", "sessions live insights", """+
parts AS (SELECT session_id, type, '## ' || upper(left(replace(type, '_', ' '), 1)) || substring(replace(type, '_', ' '), 2) AS head, string_agg('### ' || title || chr(10) || chr(10) || coalesce(content, ''), chr(10) || chr(10) ORDER BY insights.timestamp, id) AS part
  FROM insights WHERE title IS NOT NULL AND content IS NOT NULL GROUP BY 1, 2)
SELECT live.id, '# ' || project_name || chr(10) || chr(10) || 'Project: ' || project_name || chr(10) || 'Date: ' || strftime(live.started_at, '%Y-%m-%d') || chr(10) || chr(10)
  || string_agg(CASE type WHEN 'prompt_quality' THEN '## Prompt Quality' ELSE head END || chr(10) || chr(10) || part, chr(10) || chr(10) ORDER BY list_position(['summary', 'decision', 'learning', 'technique', 'prompt_quality'], type)) || chr(10) AS text
FROM live JOIN parts ON session_id = live.id GROUP BY live.id, project_name, live.started_at""")
def session_pages(t: Tables) -> DataFrame:
    from tallyspark.operators import analysis

    named = t.live.withColumn("title", F.col("project_name"))
    return analysis.markdown(named, t.insights).select("id", "text")


@query("dispatch_prefill", "sessions live facets", """+
learned AS (SELECT session_id, '## What you learned' || chr(10) || string_agg('- ' || description, chr(10) ORDER BY i) AS a FROM patterns WHERE i <= 3 GROUP BY 1),
hard AS (SELECT session_id, '## What was hard' || chr(10) || string_agg('- ' || description, chr(10) ORDER BY i) AS b FROM (SELECT * FROM friction WHERE attribution = 'user-actionable' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY i) <= 3) GROUP BY 1)
SELECT live.id, coalesce(custom_title, generated_title, 'Untitled Session') AS title, concat_ws(chr(10) || chr(10), a, b) AS context FROM live JOIN facets f ON f.session_id = live.id LEFT JOIN learned ON learned.session_id = live.id LEFT JOIN hard ON hard.session_id = live.id""")
def dispatch_prefill(t: Tables) -> DataFrame:
    return views.dispatch_prefill(t.live, t.facets)


@query("dispatch_context", "sessions live insights", """+
blocks AS (SELECT session_id, count(*) AS n, string_agg('[' || CASE type WHEN 'learning' THEN 'LEARNING' WHEN 'decision' THEN 'DECISION' WHEN 'technique' THEN 'TECHNIQUE' WHEN 'summary' THEN 'SUMMARY' WHEN 'prompt_quality' THEN 'OBSERVATION' ELSE upper(replace(type, '_', ' ')) END || ' ' || r || ']' || chr(10) || 'Summary: ' || title || chr(10) || content || CASE WHEN len(string_split(content, ' ')) < 40 THEN chr(10) || '- one' || chr(10) || '- two' ELSE '' END, chr(10) || chr(10) ORDER BY r) AS text
FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY insights.timestamp, id) AS r FROM insights WHERE content IS NOT NULL) GROUP BY 1)
SELECT session_id, 'Context from the author:' || chr(10) || 'for friends' || chr(10) || chr(10) || CASE WHEN id IS NOT NULL THEN '---' || chr(10) || chr(10) || 'SESSION BACKGROUND (1 session contributed these insights):' || chr(10) || chr(10)
  || '[Session: "' || coalesce(custom_title, generated_title, 'Untitled') || '" (' || session_character || ')]' || chr(10) || summary || chr(10) || chr(10) ELSE '' END || '---' || chr(10) || chr(10) || 'INSIGHTS (' || n || ' selected by author):' || chr(10) || chr(10) || text AS text
FROM blocks LEFT JOIN (SELECT * FROM live WHERE summary <> '') ON id = session_id""")
def dispatch_context(t: Tables) -> DataFrame:
    rows = t.insights.filter("content IS NOT NULL").withColumn("summary", F.col("title")).withColumn("bullets", F.array(F.lit("one"), F.lit("two")))
    told = t.live.filter("summary <> ''").withColumn("title", F.coalesce("custom_title", "generated_title", F.lit("Untitled")))
    return views.dispatch_context(rows, "for friends", told)


@query("backfill_ids", "sessions live insights facets", """
SELECT DISTINCT id FROM live WHERE id IN (SELECT session_id FROM insights) AND id NOT IN (SELECT session_id FROM facets)
UNION SELECT session_id FROM patterns WHERE driver IS NULL UNION SELECT session_id FROM friction WHERE attribution IS NULL""")
def backfill_ids(t: Tables) -> DataFrame:
    missing = facets.missing_facets(t.live, t.insights, t.facets).select("id")
    return missing.union(facets.outdated_facets(t.facets).select(F.col("session_id").alias("id"))).distinct()


@query("merged_ids", "insights", "SELECT id, session_id || ',' || id || CASE WHEN id <> '7' AND session_id <> '7' THEN ',7' ELSE '' END AS ids FROM insights WHERE id <> session_id UNION ALL SELECT id, id || CASE WHEN id <> '7' THEN ',7' ELSE '' END FROM insights WHERE id = session_id")
def merged_ids(t: Tables) -> DataFrame:
    return t.insights.select("id", F.array_join(views.merged_ids(F.array("session_id", "id"), F.array(F.lit("7"), F.col("id"))), ",").alias("ids"))


@query("outcome_shares", "facets", "SELECT outcome_satisfaction AS value, count(*) AS count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS percent FROM facets GROUP BY 1")
def outcome_shares(t: Tables) -> DataFrame:
    return views.shares(t.facets, "outcome_satisfaction")


@query("top_characters", "sessions live", "SELECT session_character, count(*) AS sessions FROM live GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def top_characters(t: Tables) -> DataFrame:
    return views.top_characters(t.live)


@query("cost_means", "sessions live", "SELECT round(sum(estimated_cost_usd), 4) AS cost, round(sum(estimated_cost_usd) / count(DISTINCT started_at::DATE), 6) AS per_day, round(avg(estimated_cost_usd), 6) AS per_session FROM live")
def cost_means(t: Tables) -> DataFrame:
    return views.cost_means(t.live)


# --- texts --------------------------------------------------------------------------------------------------


@query("shown_user_texts", "messages", """
SELECT id, trim(CASE WHEN starts_with(content, '<command-name>/review') THEN '`/review` now' ELSE regexp_replace(content, '\n{3,}', chr(10) || chr(10), 'g') END, chr(32) || chr(10) || chr(9) || chr(13)) AS text FROM messages WHERE type = 'user'""")
def shown_user_texts(t: Tables) -> DataFrame:
    return t.messages.filter("type = 'user'").select("id", markup.shown_user_text(F.col("content")).alias("text"))


@query("task_notifications", "messages", """
SELECT id, 't' || position AS task_id, 'done' AS status, '12' AS total_tokens, '/tmp/' || session_id AS transcript_path FROM messages""")
def task_notifications(t: Tables) -> DataFrame:
    text = F.concat(F.lit("<task-notification><task_id> t"), F.col("position"), F.lit(" </task_id><status>done</status><usage>total_tokens: 12\nduration: 3s</usage></task-notification>\n /tmp/"), "session_id", F.lit(" end"))
    return t.messages.select("id", markup.task_notification(text).alias("x")).select("id", "x.task_id", "x.status", "x.total_tokens", "x.transcript_path")


@query("teammate_messages", "messages", """
SELECT id, 'agent-' || position AS teammate_id, CASE WHEN position % 2 = 0 THEN 'lead' END AS "from", CASE WHEN position % 2 = 0 THEN '{"from":"lead"}' ELSE 'plain words' END AS raw FROM messages""")
def teammate_messages(t: Tables) -> DataFrame:
    body = F.when(F.col("position") % 2 == 0, F.lit('{"from":"lead"}')).otherwise(F.lit("plain words"))
    text = F.concat(F.lit('<teammate-message teammate_id="agent-'), F.col("position"), F.lit('" color="red">\n'), body, F.lit("\n</teammate-message>"))
    return t.messages.select("id", markup.teammate_message(text).alias("x")).select("id", "x.teammate_id", "x.from", "x.raw")


@query("meta_lines", "sessions", """
SELECT id, CASE WHEN a + m = 0 AND c = 0 THEN '' ELSE 'Context signals: ' || concat_ws('; ', CASE WHEN a + m > 0 THEN (a + m) || ' context compaction' || CASE WHEN a + m > 1 THEN 's' ELSE '' END || ' (' || concat_ws(', ', CASE WHEN a > 0 THEN a || ' auto' END, CASE WHEN m > 0 THEN m || ' manual' END) || ') — session exceeded context window' END,
  CASE WHEN c > 0 THEN 'slash commands used: /a, /b' END) || chr(10) END AS line
FROM (SELECT id, CAST(id AS BIGINT) % 3 AS a, CAST(id AS BIGINT) % 2 AS m, CAST(id AS BIGINT) % 5 AS c FROM sessions)""")
def meta_lines(t: Tables) -> DataFrame:
    k = F.col("id").cast("long")
    commands = F.when(k % 5 > 0, F.array(F.lit("/a"), F.lit("/b"))).otherwise(F.array().cast("array<string>"))
    return t.sessions.select("id", markup.meta_line(k % 2, k % 3, commands).alias("line"))


@query("credential_metadata", "", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey % 4 IN (1, 2) AS has_credential FROM orders")
def credential_metadata(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.lit('{"input_tokens": 5, "a": {"b": ["x"]}}')).when(k % 4 == 1, F.lit('{"a": [{"api-key": 1}]}')).when(k % 4 == 2, F.lit('{"note": "use Bearer abc123"}')).otherwise(F.lit("[1, 2]"))
    return adapters.table(t.spark, t.sf_dir, "orders").select(k.cast("string").alias("id"), markup.has_credential(text).alias("has_credential"))


@query("request_tokens", "messages", "SELECT session_id, CAST(10 + sum(4 + ceil(length(content) / 4.0)) AS BIGINT) AS tokens FROM messages GROUP BY 1")
def request_tokens(t: Tables) -> DataFrame:
    return t.messages.groupBy("session_id").agg(formats.request_tokens(F.col("content"), 10, 4).alias("tokens"))


@query("friendly_models", "sessions", """
SELECT DISTINCT primary_model, CASE WHEN primary_model LIKE 'claude-opus-4%' THEN 'Opus 4.x' WHEN primary_model LIKE 'claude-sonnet-4%' THEN 'Sonnet 4.x' WHEN primary_model LIKE 'claude-haiku%' THEN 'Haiku'
  WHEN primary_model LIKE 'gpt-4o%' THEN 'GPT-4o' WHEN primary_model LIKE 'claude-3-opus%' THEN 'Opus 3' END AS name FROM sessions WHERE primary_model IS NOT NULL""")
def friendly_models(t: Tables) -> DataFrame:
    return t.sessions.filter("primary_model IS NOT NULL").select("primary_model", texts.friendly_model(F.col("primary_model")).alias("name")).distinct()


@query("bounded_scores", "pq", "SELECT id, CAST(greatest(0, least(100, doc_id % 240 - 60)) AS BIGINT) AS score FROM pq")
def bounded_scores(t: Tables) -> DataFrame:
    return t.pq.select("id", costs.bounded_score(F.pmod(F.col("id").cast("long"), F.lit(240)) - 60).cast("long").alias("score"))


@query("post_parts", "", """
SELECT CAST(doc_id AS VARCHAR) AS id, 'Post ' || doc_id AS title, 'a' || (doc_id % 3) || ',end' AS tags, '# Head' AS first FROM documents""")
def post_parts(t: Tables) -> DataFrame:
    """What is read out of posts that a model wrote: the head's title, tags, and the text without what stands before it."""
    d = F.col("doc_id").cast("string")
    post = F.concat(F.lit('---\ntitle: "Post '), d, F.lit('"\n---\nWords &#39; #a'), (F.col("doc_id") % 3).cast("string"), F.lit(" and #end and #end"))
    said = F.lit("Sure, here it is:\n\n# Head\ntext")
    return adapters.table(t.spark, t.sf_dir, "documents").select(d.alias("id"), markup.frontmatter(post, "title").alias("title"), F.array_join(markup.hashtags(post), ",").alias("tags"), F.split(markup.without_preamble(said), "\n")[0].alias("first"))




@query("parsed_posts", "", rf"""
WITH posts AS (
  SELECT doc_id, doc_id % 6 AS k, replace(coalesce(text, ''), '---', '') AS t, CASE WHEN doc_id % 6 = 1 THEN '# Heading ' || doc_id || chr(10) ELSE '' END || CASE WHEN doc_id % 6 IN (1, 2) THEN '' ELSE '---' || chr(10) || 'title: "A \"' || doc_id || '\" post"' || chr(10)
    || CASE WHEN doc_id % 6 = 3 THEN '' ELSE 'tldr: short: ' || doc_id || chr(10) END || 'tags: [''a'', "b' || doc_id || '" , c]' || chr(10) || '---' || chr(10) END || replace(coalesce(text, ''), '---', '') AS p FROM documents),
read AS (SELECT *, k IN (0, 4, 5) AS fine, regexp_replace(t, '^\s+|\s+$', '', 'g') AS body FROM posts)
SELECT CAST(doc_id AS VARCHAR) AS id, NOT fine AS degraded, CASE WHEN fine THEN 'A "' || doc_id || '" post' WHEN regexp_matches(p, '(?m)^#+\s+(.+)$') THEN regexp_extract(p, '(?m)^#+\s+(.+)$', 1) ELSE 'Untitled' END AS title, CASE WHEN fine THEN 'short: ' || doc_id ELSE '' END AS tldr,
  CASE WHEN fine THEN 'a,b' || doc_id || ',c' ELSE '' END AS tags, sha256(CASE WHEN fine THEN body ELSE p END) AS body_sha256, CASE k WHEN 1 THEN 'missing-frontmatter' WHEN 2 THEN 'missing-frontmatter' WHEN 3 THEN 'malformed-frontmatter' END AS error FROM read""")
def parsed_posts(t: Tables) -> DataFrame:
    """Posts made of the table's texts: whole ones, and some without a head or without one of its lines."""
    d, k = F.col("doc_id").cast("string"), F.col("doc_id") % 6
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("---"), F.lit(""))
    head = F.concat(F.lit('---\ntitle: "A \\"'), d, F.lit('\\" post"\n'), F.when(k == 3, "").otherwise(F.concat(F.lit("tldr: short: "), d, F.lit("\n"))), F.lit("tags: ['a', \"b"), d, F.lit('" , c]\n---\n'))
    post = F.concat(F.when(k == 1, F.concat(F.lit("# Heading "), d, F.lit("\n"))).otherwise(""), F.when(k.isin(1, 2), "").otherwise(head), text)
    rows = adapters.table(t.spark, t.sf_dir, "documents").select(d.alias("id"), post.alias("post"))
    rows = rows.select("id", markup.parsed_post(F.col("post"))["error"].alias("error"), markup.read_post(F.col("post")).alias("x"))
    return rows.select("id", "x.degraded", "x.title", "x.tldr", F.array_join("x.tags", ",").alias("tags"), F.sha2(F.col("x.body").cast("binary"), 256).alias("body_sha256"), "error")


@query("publish_verdicts", "sessions live usage", """+
now AS (SELECT id, CASE WHEN CAST(id AS BIGINT) % 13 = 0 THEN 'r9' ELSE 'r' || (CAST(id AS BIGINT) % 3) END AS r, CASE WHEN CAST(id AS BIGINT) % 5 <> 0 THEN CAST(id AS BIGINT) % 7 ELSE message_count END AS n FROM live),
s AS (SELECT *, CASE WHEN analysis_type = 'session' AND CAST(session_id AS BIGINT) % 11 = 0 THEN 'de-DE' ELSE language END AS l FROM usage),
per AS (SELECT session_id, count(*) AS passes, bool_or(pipeline_revision <> 'v2') AS old, min(l) AS l1, max(l) AS l2, count(DISTINCT coalesce(session_message_count, -1)) AS counts, any_value(input_revision) AS r, max(coalesce(session_message_count, -1)) AS n FROM s GROUP BY 1)
SELECT session_id, CASE WHEN passes < 2 THEN 'incomplete' WHEN old THEN 'policy' WHEN l1 <> l2 THEN 'language' WHEN counts > 1 THEN 'passes' WHEN id IS NULL THEN 'gone' WHEN per.r <> now.r OR per.n <> now.n THEN 'changed' ELSE 'published' END AS verdict
FROM per LEFT JOIN now ON id = session_id""")
def publish_verdicts(t: Tables) -> DataFrame:
    k = F.col("id").cast("long")
    now = t.live.select(F.col("id").alias("session_id"), F.when(k % 13 == 0, "r9").otherwise(F.concat(F.lit("r"), k % 3)).alias("input_revision"), F.when(k % 5 != 0, k % 7).otherwise(F.col("message_count")).alias("message_count"))
    k = F.col("session_id").cast("long")
    stages = t.usage.withColumn("language", F.when((F.col("analysis_type") == "session") & (k % 11 == 0), "de-DE").otherwise(F.col("language")))
    return publishing.judged(stages, now, {"en-US": "v2", "zh-CN": "v2", "de-DE": "v2"})


@query("deleted_counts", "sessions", "SELECT project_id, count(*) AS deleted FROM sessions WHERE deleted_at IS NOT NULL GROUP BY 1")
def deleted_counts(t: Tables) -> DataFrame:
    return views.deleted_counts(t.sessions)


@query("message_page", "messages", "SELECT id, type, content FROM messages WHERE session_id = '3' ORDER BY messages.timestamp, position LIMIT 3 OFFSET 1")
def message_page(t: Tables) -> DataFrame:
    return views.message_page(t.messages, "3", limit=3, offset=1).select("id", "type", "content")


# --- facets and reports -------------------------------------------------------------------------------------


@query("reflect_threshold", "facets", "SELECT count(DISTINCT session_id) AS facets, 8 AS required, count(DISTINCT session_id) >= 8 AS enough FROM facets")
def reflect_threshold(t: Tables) -> DataFrame:
    return reflect.enough(t.facets)


_FRICTION = f"""friction_named AS (SELECT session_id, {sql_category("category", categories.FRICTION)} AS c, CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS s FROM friction WHERE trim(category) <> ''),
friction_by AS (SELECT c AS category, count(*) AS count, avg(s) AS avg_severity FROM friction_named WHERE NOT regexp_matches(c, '(?i)rate.?limit|throttl') GROUP BY 1)"""
_PATTERN = f"""pattern_by AS (SELECT c AS category, count(*) AS frequency FROM (SELECT {sql_category("category", categories.PATTERN)} AS c FROM patterns WHERE confidence >= 50) GROUP BY 1)"""


@query("recurring_friction", "facets", "+" + _FRICTION + " SELECT category, count FROM friction_by WHERE count >= 3")
def recurring_friction(t: Tables) -> DataFrame:
    return reflect.recurring_friction(facets.friction_points(t.facets)).select("category", "count")


@query("recurring_patterns", "facets", "+" + _PATTERN + " SELECT category, frequency FROM pattern_by WHERE frequency >= 2")
def recurring_patterns(t: Tables) -> DataFrame:
    return reflect.recurring_patterns(facets.pattern_points(t.facets)).select("category", "frequency")


@query("synthesis_inputs", "sessions live facets pq", f"""+{_FRICTION}, {_PATTERN},
top AS (SELECT 'friction' AS kind, category, count AS n FROM (SELECT * FROM friction_by ORDER BY round(count * round(avg_severity, 4), 8) DESC, category LIMIT 15) UNION ALL SELECT 'patterns', category, frequency FROM (SELECT * FROM pattern_by ORDER BY frequency DESC, category LIMIT 10)),
name_pq AS (SELECT c, count(DISTINCT session_id) AS n FROM (SELECT session_id, {sql_category("category", categories.PROMPT_QUALITY)} AS c FROM pq_findings) GROUP BY 1 HAVING n >= 2),
told AS (SELECT * FROM top UNION ALL SELECT CASE WHEN c IN ({_STRENGTHS}) THEN 'strengths' ELSE 'deficits' END, c, n FROM name_pq UNION ALL SELECT 'outcome', outcome_satisfaction, count(*) FROM facets GROUP BY 2
  UNION ALL SELECT 'workflow', workflow_pattern, count(*) FROM facets WHERE workflow_pattern IS NOT NULL GROUP BY 2 UNION ALL SELECT 'character', session_character, count(*) FROM live WHERE session_character IS NOT NULL GROUP BY 2)
SELECT kind, '[' || string_agg('{{"category":"' || category || '","n":' || n || '}}', ',' ORDER BY n DESC, category) || ']' AS items FROM told GROUP BY 1""")
def synthesis_inputs(t: Tables) -> DataFrame:
    spread = {"outcome": facets.distribution(t.facets, "outcome_satisfaction"), "workflow": facets.distribution(t.facets, "workflow_pattern"), "character": facets.distribution(t.live, "session_character")}
    return reflect.synthesis_inputs(facets.friction_categories(facets.friction_points(t.facets)), facets.effective_patterns(facets.pattern_points(t.facets)), facets.quality_findings(t.pq), spread)


@query("backfill_progress", "sessions live facets queue", """+
asked AS (SELECT row_number() OVER () - 1 AS position, k FROM (VALUES ('1'), ('2'), ('3'), ('7'), ('32'), ('gone'), ('34'), ('35'), ('64'), ('65'), ('66'), ('67')) v(k)),
judged AS (SELECT position, k, CASE WHEN id IS NULL THEN 'gone' WHEN k IN (SELECT session_id FROM facets) THEN 'skipped' WHEN status = 'failed' THEN 'failed' ELSE 'done' END AS outcome FROM asked LEFT JOIN live ON id = k LEFT JOIN queue ON session_id = k)
SELECT k AS session_id, outcome, count(*) FILTER (outcome IN ('done', 'skipped')) OVER so_far AS completed, count(*) FILTER (outcome IN ('gone', 'failed')) OVER so_far AS failed, count(*) OVER () AS total FROM judged WINDOW so_far AS (ORDER BY position)""")
def backfill_progress(t: Tables) -> DataFrame:
    ids = ["1", "2", "3", "7", "32", "gone", "34", "35", "64", "65", "66", "67"]
    results = t.queue.select("session_id", (F.col("status") != "failed").alias("success"))
    return quality.backfill_progress(ids, t.live, t.facets.select("session_id"), results)


@query("recurring_candidates", "insights", "SELECT id, type FROM insights WHERE type NOT IN ('summary', 'prompt_quality') ORDER BY insights.timestamp DESC, id LIMIT 200")
def recurring_candidates(t: Tables) -> DataFrame:
    return views.recurring_candidates(t.insights).select("id", "type")


def _weeks(t: Tables) -> DataFrame:
    rows = [(f"w{k}", f"2024-01-{d:02d}", f"2024-01-{d + 7:02d}") for k, d in enumerate((1, 8, 15))]
    ts = lambda c: F.col(c).cast("timestamp").alias(c)
    return t.spark.createDataFrame(rows, "period string, window_start string, window_end string").select("period", ts("window_start"), ts("window_end"), F.lit("2024-05-01").cast("timestamp").alias("generated_at"))


@query("stale_snapshots", "facets", """+
weeks AS (SELECT * FROM (VALUES ('w0', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-08'), ('w1', TIMESTAMP '2024-01-08', TIMESTAMP '2024-01-15'), ('w2', TIMESTAMP '2024-01-15', TIMESTAMP '2024-01-22')) v(period, a, b)),
s AS (SELECT CAST(event_id AS VARCHAR) AS id, ts FROM events WHERE event_id % 19 <> 0)
SELECT period, coalesce(max(extracted_at) > TIMESTAMP '2024-05-01', false) AS stale FROM weeks LEFT JOIN (s JOIN facets ON session_id = id) ON ts >= a AND ts < b GROUP BY period""")
def stale_snapshots(t: Tables) -> DataFrame:
    return reflect.stale(t.facets, adapters.events(t.spark, t.sf_dir), _weeks(t))


@query("stored_snapshots", "sessions live", """
SELECT period, project_id, source_scope, CAST(coalesce(new_sessions, old_sessions) AS BIGINT) AS sessions, new_sessions IS NOT NULL AS replaced FROM (
  SELECT strftime(started_at, '%G-W%V') AS period, project_id, source_tool AS source_scope, count(*) FILTER (CAST(id AS BIGINT) % 2 = 0) AS old_n, nullif(count(*) FILTER (CAST(id AS BIGINT) % 3 = 0), 0) AS new_sessions, nullif(old_n, 0) AS old_sessions
  FROM live GROUP BY 1, 2, 3) WHERE coalesce(new_sessions, old_sessions) IS NOT NULL""")
def stored_snapshots(t: Tables) -> DataFrame:
    """Reports by week, project and tool, made from half of the sessions, and newer ones from a third."""
    key = F.col("id").cast("long")
    made = lambda n, new: t.live.filter(key % n == 0).groupBy(times.iso_week(F.col("started_at")).alias("period"), "project_id", F.col("source_tool").alias("source_scope")).agg(F.count(F.lit(1)).alias("sessions")).withColumn("replaced", F.lit(new))
    return reflect.store_snapshot(made(2, False), made(3, True))


@query("written_facets", "facets", f"""
SELECT session_id, count(*) AS points, 'high' AS outcome FROM friction WHERE trim(category) <> '' AND CAST(session_id AS BIGINT) % 2 = 0 GROUP BY 1
UNION ALL SELECT session_id, 0, 'high' FROM facets WHERE CAST(session_id AS BIGINT) % 2 = 0 AND session_id NOT IN (SELECT session_id FROM friction WHERE trim(category) <> '')
UNION ALL SELECT f.session_id, (SELECT count(*) FROM friction x WHERE x.session_id = f.session_id), outcome_satisfaction FROM facets f WHERE CAST(f.session_id AS BIGINT) % 2 <> 0""")
def written_facets(t: Tables) -> DataFrame:
    new = t.facets.filter("CAST(session_id AS BIGINT) % 2 = 0").withColumn("outcome_satisfaction", F.lit("high"))
    rows = reflect.write_facets(t.facets, new)
    return rows.select("session_id", nested.array_length(F.col("friction_points")).cast("long").alias("points"), F.col("outcome_satisfaction").alias("outcome"))


@query("deleted_facets", "facets", "SELECT session_id FROM facets WHERE CAST(session_id AS BIGINT) % 3 <> 0")
def deleted_facets(t: Tables) -> DataFrame:
    return reflect.delete_facets(t.facets, t.facets.filter("CAST(session_id AS BIGINT) % 3 = 0")).select("session_id")


@query("valid_facets", "facets", f"""+
ok AS (SELECT session_id, iteration_count FROM facets WHERE iteration_count < 4),
pts AS (SELECT session_id, count(*) AS points FROM (SELECT *, {sql_category("category", categories.FRICTION)} AS c FROM friction) WHERE c IN ({", ".join(f"'{c}'" for c in categories.FRICTION.canonical)}) GROUP BY 1),
pats AS (SELECT session_id, count(*) AS patterns FROM (SELECT *, {sql_category("category", categories.PATTERN)} AS c FROM patterns) WHERE c IN ({", ".join(f"'{c}'" for c in categories.PATTERN.canonical)}) GROUP BY 1)
SELECT session_id, iteration_count, coalesce(points, 0) AS points, coalesce(patterns, 0) AS patterns FROM ok LEFT JOIN pts USING (session_id) LEFT JOIN pats USING (session_id)""")
def valid_facets(t: Tables) -> DataFrame:
    """Answers made of stored facets: one in five has a negative count of iterations and is refused."""
    absent = lambda c: F.coalesce(F.from_json(c, "array<struct<category:string,attribution:string,description:string,severity:string,resolution:string,confidence:double,driver:string>>"), F.array().cast("array<struct<category:string,attribution:string,description:string,severity:string,resolution:string,confidence:double,driver:string>>"))
    points = F.transform(absent("friction_points"), lambda x: x.withField("resolution", F.lit("resolved")))
    n = F.when(F.col("iteration_count") < 4, F.col("iteration_count")).otherwise(-1)
    answer = F.to_json(F.struct("outcome_satisfaction", "workflow_pattern", F.lit(None).cast("string").alias("course_correction_reason"), "had_course_correction", n.alias("iteration_count"), points.alias("friction_points"), absent("effective_patterns").alias("effective_patterns")))
    rows = reflect.valid_facets(t.facets.select("session_id", answer.alias("facets")))
    return rows.select("session_id", "iteration_count", F.size("friction_points").cast("long").alias("points"), F.size("effective_patterns").cast("long").alias("patterns"))


@query("quality_insight_rows", "pq", """
SELECT session_id, 'Prompt Efficiency: ' || CASE kind WHEN 'full' THEN doc_id % 101 ELSE 50 END || '/100' AS title, CASE WHEN kind = 'full' THEN doc_id % 3 + 1 ELSE 0 END AS findings FROM pq WHERE kind <> 'broken'""")
def quality_insight_rows(t: Tables) -> DataFrame:
    rows = reflect.quality_rows(t.pq.select("session_id", F.col("metadata").alias("answer")))
    return rows.select("session_id", "title", F.coalesce(F.json_array_length(F.get_json_object("metadata", "$.findings")), F.lit(0)).cast("long").alias("findings"))


# --- writes -------------------------------------------------------------------------------------------------


@query("usage_upsert", "usage", "SELECT session_id, analysis_type, session_message_count, CASE WHEN CAST(session_id AS BIGINT) % 5 = 0 THEN NULL ELSE pipeline_revision END AS pipeline_revision FROM usage")
def usage_upsert(t: Tables) -> DataFrame:
    new = t.usage.filter("CAST(session_id AS BIGINT) % 5 = 0").withColumn("session_message_count", F.lit(None).cast("long")).withColumn("pipeline_revision", F.lit(None).cast("string"))
    return state.upsert_usage(t.usage, new).select("session_id", "analysis_type", "session_message_count", "pipeline_revision")


@query("created_insights", "sessions insights", """
SELECT id FROM insights UNION ALL SELECT 'n' || id FROM insights WHERE CAST(id AS BIGINT) % 3 = 1 AND trim(title) <> '' AND trim(content) <> '' AND session_id IN (SELECT id FROM sessions)""")
def created_insights(t: Tables) -> DataFrame:
    """New ones: a third have a type that isn't known, a third an id that is taken."""
    k = F.col("id").cast("long")
    new = t.insights.withColumn("type", F.when(k % 3 == 0, "odd").otherwise(F.col("type"))).withColumn("id", F.when(k % 3 == 2, F.col("id")).otherwise(F.concat(F.lit("n"), "id")))
    return state.create_insights(t.insights, new, t.sessions).select("id")


@query("deleted_insights", "insights", "SELECT id FROM insights WHERE CAST(id AS BIGINT) % 3 <> 0")
def deleted_insights(t: Tables) -> DataFrame:
    return state.delete_insights(t.insights, t.insights.filter("CAST(id AS BIGINT) % 3 = 0")).select("id")


@query("migrated_sessions", "sessions", "SELECT id, CAST(message_count AS INTEGER) AS message_count, 'claude-code' AS source, NULL::VARCHAR AS device FROM sessions")
def migrated_sessions(t: Tables) -> DataFrame:
    return state.migrate(t.sessions.select("id", "message_count", "project_id"), "id string, message_count int, source string, device string", {"source": F.lit("claude-code")})


@query("truncated_fields", "messages", "SELECT id, CAST(CASE WHEN length(content) * 40 > 5000 THEN 5000 - 20 + 16 ELSE length(content) * 40 END AS BIGINT) AS thinking, CAST(CASE WHEN length(content) * 40 > 2000 THEN 2000 - 20 + 16 ELSE length(content) * 40 END AS BIGINT) AS output FROM messages")
def truncated_fields(t: Tables) -> DataFrame:
    long = F.repeat("content", 40)
    rows = state.truncate_messages(t.messages.withColumn("thinking", long).withColumn("tool_results", F.array(F.struct(F.lit("c").alias("id"), long.alias("output")))))
    return rows.select("id", F.length("thinking").cast("long").alias("thinking"), F.length(F.col("tool_results")[0]["output"]).cast("long").alias("output"))


@query("navigable_weeks", "events", """
SELECT strftime(d, '%G-W%V') AS week FROM generate_series(TIMESTAMP '2024-02-26' - INTERVAL 133 DAY, TIMESTAMP '2024-02-26', INTERVAL 7 DAY) g(d)
WHERE d = TIMESTAMP '2024-02-26' OR d IN (SELECT date_trunc('week', started_at) FROM ev)""")
def navigable_weeks(t: Tables) -> DataFrame:
    weeks = activity.week_inventory(t.events, t.facets, "2024-02-26", 20)
    return scope.navigable_weeks(weeks, "2024-W09").select("week")


@query("presence", "sessions queue", """
SELECT 'deleted' AS "check", EXISTS (SELECT 1 FROM sessions WHERE deleted_at IS NOT NULL) AS present UNION ALL SELECT 'no_start', EXISTS (SELECT 1 FROM sessions WHERE started_at IS NULL)
UNION ALL SELECT 'failed', EXISTS (SELECT 1 FROM queue WHERE status = 'failed') UNION ALL SELECT 'lost', EXISTS (SELECT 1 FROM queue WHERE status = 'lost')""")
def presence(t: Tables) -> DataFrame:
    asked = {"deleted": (t.sessions, F.col("deleted_at").isNotNull()), "no_start": (t.sessions, F.col("started_at").isNull()), "failed": (t.queue, F.col("status") == "failed"), "lost": (t.queue, F.col("status") == "lost")}
    found = [views.present(*x).select(F.lit(n).alias("check"), "present") for n, x in asked.items()]
    return found[0].union(found[1]).union(found[2]).union(found[3])


#: A year and some with both changes of the clock: in Berlin it is UTC + 2 from 1997-03-30 to 1997-10-26, at one o'clock UTC.
_BERLIN = "s + CASE WHEN s >= TIMESTAMP '1997-03-30 01:00:00' AND s < TIMESTAMP '1997-10-26 01:00:00' THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END"
#: Sessions start through the hours of their day.
_CLOCK = "started_at::TIMESTAMP + to_minutes(CAST(CAST(id AS BIGINT) * 7 % 1440 AS BIGINT))"


def _through_the_day(t: Tables) -> DataFrame:
    minutes = F.make_dt_interval(mins=F.pmod(F.col("id").cast("long") * 7, F.lit(1440)).cast("int"))
    return t.live.withColumn("started_at", F.col("started_at") + minutes).withColumn("ended_at", F.greatest("ended_at", F.col("started_at")))


@query("local_days", "sessions live", f"""+
told AS (SELECT *, {_CLOCK} AS s FROM live),
berlin AS (SELECT ({_BERLIN})::DATE AS d, count(*) AS n, sum(estimated_cost_usd) AS cost, sum(epoch(greatest(ended_at::TIMESTAMP, s) - s) / 60) AS minutes FROM told GROUP BY 1)
SELECT g.d::DATE AS day, coalesce(n, 0) AS sessions, round(coalesce(cost, 0), 4) AS cost, round(coalesce(minutes, 0), 2) AS minutes FROM generate_series(TIMESTAMP '1997-01-15', TIMESTAMP '1998-01-15', INTERVAL 1 DAY) g(d) LEFT JOIN berlin ON berlin.d = g.d::DATE""")
def local_days(t: Tables) -> DataFrame:
    return stats.local_days(_through_the_day(t), date(1997, 1, 15), date(1998, 1, 15), "Europe/Berlin")


@query("local_campaign", "sessions live messages", f"""+
told AS (SELECT *, {_CLOCK} AS s FROM live)
SELECT id, row_number() OVER (ORDER BY s, id) - 1 AS ordinal FROM told WHERE ({_BERLIN})::DATE BETWEEN DATE '1997-03-30' AND DATE '1997-10-26' AND id IN (SELECT session_id FROM messages)""")
def local_campaign(t: Tables) -> DataFrame:
    """Campaign items of the days between two changes of the clock."""
    return state.campaign_items(_through_the_day(t), t.messages, "1997-03-30", "1997-10-26", "Europe/Berlin").select("id", "ordinal")


@query("local_today", "sessions live", f"""+
told AS (SELECT *, {_CLOCK} AS s FROM live)
SELECT id, {sql_time("s", "started_at")} FROM told WHERE s >= TIMESTAMP '1997-10-24 22:00:00'""")
def local_today(t: Tables) -> DataFrame:
    """A day that is 25 hours long: the period starts at a midnight of summer time, two hours before that of UTC."""
    return scope.scoped(_through_the_day(t), "today", as_of=datetime(1997, 10, 25, 12), rolling=False, zone="Europe/Berlin").select("id", when_text("started_at"))


@query("local_streak", "events", """+
days AS (SELECT DISTINCT (started_at::TIMESTAMP + INTERVAL 9 HOUR)::DATE AS d FROM ev WHERE started_at < TIMESTAMP '2024-01-30 15:00:00'),
numbered AS (SELECT d, row_number() OVER (ORDER BY d DESC) AS r, max(d) OVER () AS last FROM days)
SELECT count(*) AS streak FROM numbered WHERE d = last - CAST(r - 1 AS INTEGER) AND last >= DATE '2024-01-29'""")
def local_streak(t: Tables) -> DataFrame:
    return stats.streak(t.events, EVENTS_NOW, "Asia/Tokyo")


_SEVERITY = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"


@query("facet_bundle", "facets", f"""+
f AS (SELECT session_id, {sql_category("category", categories.FRICTION)} AS c, coalesce(attribution, 'unattributed') AS a, {_SEVERITY} AS s, description FROM friction WHERE trim(category) <> ''),
p AS (SELECT session_id, {sql_category("category", categories.PATTERN)} AS c, coalesce(driver, 'unlabeled') AS a, confidence AS s, description FROM patterns WHERE confidence >= 50 AND trim(category) <> ''),
tagged AS (
  SELECT 'friction' AS section, c AS key, session_id, s, description FROM f WHERE NOT regexp_matches(c, '(?i)rate.?limit|throttl') UNION ALL SELECT 'rate_limit', c, session_id, s, description FROM f WHERE regexp_matches(c, '(?i)rate.?limit|throttl')
  UNION ALL SELECT 'attribution', a, session_id, s, NULL FROM f UNION ALL SELECT 'pattern', c, session_id, s, description FROM p UNION ALL SELECT 'driver', c || ':' || a, session_id, s, NULL FROM p
  UNION ALL SELECT 'outcome', outcome_satisfaction, session_id, NULL, NULL FROM facets UNION ALL SELECT 'workflow', workflow_pattern, session_id, NULL, NULL FROM facets WHERE workflow_pattern IS NOT NULL UNION ALL SELECT 'sessions', 'all', session_id, NULL, NULL FROM facets)
SELECT section, key, count(*) AS count, count(DISTINCT session_id) AS sessions, round(avg(s), 4) AS mean, min(description) AS example FROM tagged GROUP BY ALL""")
def facet_bundle(t: Tables) -> DataFrame:
    return facets.bundle(t.facets)
