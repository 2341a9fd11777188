"""Reports over many sessions: what goes in, when there is enough, and whether a stored one is stale; facets as they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import categories as C
from tallyspark.functions import nested
from tallyspark.operators import facets, state

# What facets may say.
SEVERITIES = ("high", "medium", "low")
ATTRIBUTIONS = ("user-actionable", "ai-capability", "environmental")
DRIVERS = ("user-driven", "ai-driven", "collaborative")
UNCATEGORIZED = "uncategorized"
# End of fixed values.

TOP_FRICTION, TOP_PATTERNS = 15, 10
SNAPSHOT_KEY = ["period", "project_id", "source_scope"]


def enough(facet_rows: DataFrame) -> DataFrame:
    """facets, required and enough, one row."""
    return facet_rows.agg(F.count_distinct("session_id").alias("facets")).select("facets", F.lit(facets.LEAST_FACETS).alias("required"), (F.col("facets") >= facets.LEAST_FACETS).alias("enough"))


def recurring_friction(points: DataFrame) -> DataFrame:
    return facets.friction_categories(points).filter(F.col("count") >= facets.RECURRING_FRICTION)


def recurring_patterns(points: DataFrame) -> DataFrame:
    return facets.effective_patterns(points).filter(F.col("frequency") >= facets.RECURRING_PATTERNS)


def synthesis_inputs(friction: DataFrame, patterns: DataFrame, findings: DataFrame | None = None, distributions: dict[str, DataFrame] | None = None) -> DataFrame:
    """kind and items, JSON: the friction categories that weigh most, the most frequent patterns, and if given deficits and strengths of prompts (findings: category, type, sessions) and distributions (value, count) by name. A few rows of each."""
    top_f = friction.orderBy(F.desc(F.col("count") * F.col("avg_severity")), "category").limit(TOP_FRICTION).select(F.lit("friction").alias("kind"), F.struct(F.col("count").alias("n"), "category").alias("x"))
    top_p = patterns.orderBy(F.desc("frequency"), "category").limit(TOP_PATTERNS).select(F.lit("patterns").alias("kind"), F.struct(F.col("frequency").alias("n"), "category").alias("x"))
    parts = top_f.union(top_p)
    if findings is not None:
        parts = parts.union(findings.filter(F.col("type").isin("deficit", "strength")).select(F.concat("type", F.lit("s")).alias("kind"), F.struct(F.col("sessions").alias("n"), "category").alias("x")))
    for name, rows in (distributions or {}).items():
        parts = parts.union(rows.select(F.lit(name).alias("kind"), F.struct(F.col("count").alias("n"), F.col("value").alias("category")).alias("x")))
    return parts.groupBy("kind").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("x.n")).alias("o"), F.col("x.category").alias("category"), F.col("x.n").alias("n")))), lambda x: F.struct(x["category"].alias("category"), x["n"].alias("n")))).alias("items"))


def store_snapshot(snapshots: DataFrame, new: DataFrame) -> DataFrame:
    """Reports by period, project and tool: a new one takes the old one's place."""
    return state.replace_keyed(snapshots, new, SNAPSHOT_KEY)


def stale(facet_rows: DataFrame, sessions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """period and stale: were facets of a session of the window extracted after the report was made? snapshots: period, window_start, window_end, generated_at."""
    rows = facet_rows.select(F.col("session_id").alias("id"), "extracted_at").join(sessions.filter("deleted_at IS NULL").select("id", "started_at"), "id")
    # windows are told by the months they touch, so that the two sides meet by equal keys; a month's facets are few numbers by then
    month = lambda c: F.date_trunc("month", c)
    windows = snapshots.filter("window_start < window_end").withColumn("month", F.explode(F.sequence(month("window_start"), month("window_end"), F.expr("INTERVAL 1 MONTH"))))
    by_second = rows.groupBy(month("started_at").alias("month"), "started_at").agg(F.max("extracted_at").alias("extracted_at"))
    inside = (F.col("started_at") >= F.col("window_start")) & (F.col("started_at") < F.col("window_end"))
    latest = windows.join(by_second, "month").filter(inside).groupBy("period", "generated_at").agg(F.max("extracted_at").alias("latest"))
    told = snapshots.select("period", "generated_at").distinct().join(latest, ["period", "generated_at"], "left")
    return told.select("period", F.coalesce(F.col("latest") > F.col("generated_at"), F.lit(False)).alias("stale"))


def _elements(text: Column) -> Column:
    return F.coalesce(F.try_variant_get(nested.variant(text), "$", "array<variant>"), F.array().cast("array<variant>"))


def _kept(items: Column, ok, fields) -> Column:
    return F.transform(F.filter(items, lambda x: F.coalesce(ok(x), F.lit(False))), lambda x: F.struct(*[c.alias(n) for n, c in fields(x).items()]))


def _optional(x: Column, path: str, allowed: tuple[str, ...]) -> Column:
    return F.try_variant_get(x, path, "variant").isNull() | nested.text_field(x, path).isin(*allowed)


def valid_facets(rows: DataFrame) -> DataFrame:
    """Facets (session_id, facets as JSON) whose structure holds; friction points and patterns that break a rule go, categories are normalised."""
    v = F.col("v")
    t = lambda path: nested.text_field(v, path)
    n = nested.number_field(v, "$.iteration_count")
    is_list = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith("ARRAY")
    null_or_text = lambda path: F.try_variant_get(v, path, "string").isNull() | t(path).isNotNull()
    ok = (F.trim(t("$.outcome_satisfaction")) != "") & null_or_text("$.workflow_pattern") & null_or_text("$.course_correction_reason") & (F.schema_of_variant(F.try_variant_get(v, "$.had_course_correction", "variant")) == "BOOLEAN") & (n >= 0) & (n == F.floor(n)) & is_list("$.friction_points") & is_list("$.effective_patterns")
    friction = lambda x: C.normalize_category(nested.text_field(x, "$.category"), C.FRICTION)
    pattern = lambda x: C.normalize_category(nested.text_field(x, "$.category"), C.PATTERN)
    sure = lambda x: nested.number_field(x, "$.confidence")
    points = _kept(
        F.coalesce(F.try_variant_get(v, "$.friction_points", "array<variant>"), F.array().cast("array<variant>")),
        lambda x: friction(x).isin(*C.FRICTION.canonical) & nested.text_field(x, "$.description").isNotNull() & nested.text_field(x, "$.severity").isin(*SEVERITIES) & nested.text_field(x, "$.resolution").isNotNull() & _optional(x, "$.attribution", ATTRIBUTIONS),
        lambda x: {"category": friction(x), "description": nested.text_field(x, "$.description"), "severity": nested.text_field(x, "$.severity"), "resolution": nested.text_field(x, "$.resolution"), "attribution": nested.text_field(x, "$.attribution")},
    )
    patterns = _kept(
        F.coalesce(F.try_variant_get(v, "$.effective_patterns", "array<variant>"), F.array().cast("array<variant>")),
        lambda x: pattern(x).isin(*C.PATTERN.canonical) & nested.text_field(x, "$.description").isNotNull() & sure(x).between(0, 100) & _optional(x, "$.driver", DRIVERS),
        lambda x: {"category": pattern(x), "description": nested.text_field(x, "$.description"), "confidence": sure(x), "driver": nested.text_field(x, "$.driver")},
    )
    found = rows.select("session_id", nested.variant(F.col("facets")).alias("v")).filter(F.coalesce(ok, F.lit(False)))
    return found.select("session_id", t("$.outcome_satisfaction").alias("outcome_satisfaction"), t("$.workflow_pattern").alias("workflow_pattern"), F.try_variant_get(v, "$.had_course_correction", "boolean").alias("had_course_correction"), n.cast("long").alias("iteration_count"), points.alias("friction_points"), patterns.alias("effective_patterns"))


def write_facets(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored with the rows of new (same columns; arrays as JSON) by session: points without a category go, pattern categories are normalised."""
    category = lambda x: nested.text_field(x, "$.category")
    points = F.transform(F.filter(_elements(F.col("friction_points")), lambda x: F.coalesce(F.trim(category(x)) != "", F.lit(False))), lambda x: F.struct(*[nested.text_field(x, f"$.{f}").alias(f) for f in ("category", "attribution", "description", "severity")]))
    normal = lambda x: F.coalesce(C.normalize_category(F.nullif(category(x), F.lit("")), C.PATTERN), F.lit(UNCATEGORIZED))
    patterns = F.transform(_elements(F.col("effective_patterns")), lambda x: F.struct(normal(x).alias("category"), nested.text_field(x, "$.description").alias("description"), nested.number_field(x, "$.confidence").alias("confidence"), nested.text_field(x, "$.driver").alias("driver")))
    clean = new.withColumn("friction_points", F.to_json(points)).withColumn("effective_patterns", F.to_json(patterns))
    return state.replace_keyed(stored, clean.select(*stored.columns), ["session_id"])


def delete_facets(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the sessions in ids (session_id), whose new analysis has none."""
    return stored.join(ids.select("session_id").distinct(), "session_id", "left_anti")


MOST_TAKEAWAYS, MOST_FINDINGS, MISSING_SCORE = 4, 8, 50


def quality_rows(answers: DataFrame) -> DataFrame:
    """session_id, title, content, confidence and metadata of prompt-quality answers (session_id, answer as JSON): categories normalised, lists cut, missing scores in the middle."""
    v = F.col("v")
    score = lambda path: F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(nested.number_field(v, path), F.lit(float(MISSING_SCORE))))).cast("long")
    normal = lambda x: F.coalesce(C.normalize_category(F.nullif(nested.text_field(x, "$.category"), F.lit("")), C.PROMPT_QUALITY), F.lit(UNCATEGORIZED))
    items = lambda path, most: F.slice(F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>")), 1, most)
    findings = F.transform(items("$.findings", MOST_FINDINGS), lambda x: F.struct(normal(x).alias("category"), nested.text_field(x, "$.type").alias("type"), nested.text_field(x, "$.description").alias("description")))
    takeaways = F.transform(items("$.takeaways", MOST_TAKEAWAYS), lambda x: F.struct(normal(x).alias("category"), nested.text_field(x, "$.label").alias("label")))
    dimensions = F.struct(*[score(f"$.dimension_scores.{d}").alias(d) for d in ("context_provision", "request_specificity", "scope_management", "information_timing", "correction_quality")])
    told = F.coalesce(nested.text_field(v, "$.assessment"), F.lit(""))
    rows = answers.select("session_id", nested.variant(F.col("answer")).alias("v")).filter("v IS NOT NULL")
    meta = F.to_json(F.struct(score("$.efficiency_score").alias("efficiency_score"), takeaways.alias("takeaways"), findings.alias("findings"), dimensions.alias("dimension_scores")))
    return rows.select("session_id", F.concat(F.lit("Prompt Efficiency: "), score("$.efficiency_score").cast("string"), F.lit("/100")).alias("title"), told.alias("content"), F.lit(0.85).alias("confidence"), meta.alias("metadata"))
