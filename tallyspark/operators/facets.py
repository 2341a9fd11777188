"""Aggregates over facets: friction, patterns, prompt quality, and what is missing or outdated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions import categories as C
from tallyspark.functions import costs, nested, texts

SEVERITY = {"high": 3, "medium": 2, "low": 1}
EXAMPLES, LEAST_CONFIDENCE, RECURRING_FRICTION, RECURRING_PATTERNS, LEAST_FACETS = 10, 50, 3, 2, 8


def severity(c: Column) -> Column:
    out = F.lit(1)
    for name, n in SEVERITY.items():
        out = F.when(c == name, n).otherwise(out)
    return out


def elements(facets: DataFrame, column: str) -> DataFrame:
    """One row for each element of a JSON array; null and malformed text has none."""
    # the null-safe explode keeps no row for them
    items = F.explode(F.coalesce(F.try_variant_get(nested.variant(F.col(column)), "$", "array<variant>"), F.array().cast("array<variant>")))
    return facets.select("session_id", items.alias("e"))


def friction_points(facets: DataFrame) -> DataFrame:
    """session_id, category, attribution, description, severity; points without a category that is text are left out."""
    e = F.col("e")
    rows = elements(facets, "friction_points").select(
        "session_id",
        nested.text_field(e, "$.category").alias("category"),
        nested.text_field(e, "$.attribution").alias("attribution"),
        nested.text_field(e, "$.description").alias("description"),
        severity(nested.text_field(e, "$.severity")).alias("severity"),
    )
    return rows.filter(F.trim("category") != "")


def is_rate_limit(category: Column) -> Column:
    return category.rlike(texts.RATE_LIMIT)


def friction_categories(points: DataFrame) -> DataFrame:
    """Of each normalised category but rate limits: count, sessions, mean severity and examples."""
    named = points.withColumn("category", C.normalize_category(F.col("category"), C.FRICTION)).filter(~is_rate_limit(F.col("category")))
    counts = named.groupBy("category").agg(F.count(F.lit(1)).alias("count"), F.count_distinct("session_id").alias("sessions"), F.round(F.avg("severity"), 4).alias("avg_severity"))
    return counts.join(top_values(named, "category", "description", "examples"), "category", "left")


def top_values(rows: DataFrame, key: str, value: str, name: str, *order: Column, most: int = EXAMPLES) -> DataFrame:
    """key and up to most of its values in an order, value by value: ranked before they are collected."""
    order = order or (F.col(value).asc(),)
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= most)
    return ranked.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", value))), lambda x: x[value]).alias(name))


def rate_limits(points: DataFrame) -> DataFrame:
    """Count and sessions of all rate-limit points, and three examples."""
    hit = points.withColumn("category", C.normalize_category(F.col("category"), C.FRICTION)).filter(is_rate_limit(F.col("category")))
    return hit.agg(F.count(F.lit(1)).alias("count"), F.count_distinct("session_id").alias("sessions"), F.slice(F.sort_array(F.collect_set("category")), 1, 3).alias("kinds"))


def attribution_counts(points: DataFrame) -> DataFrame:
    return points.groupBy(F.coalesce("attribution", F.lit("unattributed")).alias("attribution")).agg(F.count(F.lit(1)).alias("count"))


def pattern_points(facets: DataFrame) -> DataFrame:
    """session_id, category, description, confidence, driver of patterns with enough confidence; confidence that isn't a number is none."""
    e = F.col("e")
    rows = elements(facets, "effective_patterns").select(
        "session_id",
        nested.text_field(e, "$.category").alias("category"),
        nested.text_field(e, "$.description").alias("description"),
        nested.number_field(e, "$.confidence").alias("confidence"),
        nested.text_field(e, "$.driver").alias("driver"),
    )
    rows = rows.filter((F.trim("category") != "") & (F.col("confidence") >= LEAST_CONFIDENCE))
    return rows.withColumn("category", C.normalize_category(F.col("category"), C.PATTERN))


def effective_patterns(points: DataFrame) -> DataFrame:
    """Of each category: frequency, mean confidence, label and the descriptions of most confidence."""
    counts = points.groupBy("category").agg(F.count(F.lit(1)).alias("frequency"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))
    best = top_values(points, "category", "description", "descriptions", F.desc("confidence"), F.col("description"))
    return counts.join(best, "category").withColumn("label", C.category_label(F.col("category"), C.PATTERN))


def pattern_drivers(points: DataFrame) -> DataFrame:
    return points.groupBy("category", F.coalesce("driver", F.lit("unlabeled")).alias("driver")).agg(F.count(F.lit(1)).alias("count"))


def quality_findings(insights: DataFrame) -> DataFrame:
    """Categories of prompt-quality findings in at least two sessions, deficits and strengths."""
    items = F.explode(F.coalesce(F.try_variant_get(nested.variant(F.col("metadata")), "$.findings", "array<variant>"), F.array().cast("array<variant>")))
    rows = insights.select("session_id", items.alias("e")).select("session_id", nested.text_field(F.col("e"), "$.category").alias("raw")).filter("raw IS NOT NULL")
    category = C.normalize_category(F.col("raw"), C.PROMPT_QUALITY)
    by = rows.groupBy(category.alias("category")).agg(F.count_distinct("session_id").alias("sessions")).filter("sessions >= 2")
    return by.select("category", C.category_label(F.col("category"), C.PROMPT_QUALITY).alias("label"), C.prompt_quality_type(F.col("category")).alias("type"), "sessions")


def dimension_scores(insights: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Rounded means of the dimensions over scores of 0 to 100, and the rounded mean of those."""
    v = nested.variant(F.col("metadata"))
    scores = insights.select(*[nested.number_field(v, f"$.dimension_scores.{d}").alias(d) for d in dimensions])
    means = scores.agg(*[costs.half_up(F.avg(F.when(F.col(d).between(0, 100), F.col(d)))).alias(d) for d in dimensions])
    known = F.array_compact(F.array(*[F.col(d) for d in dimensions]))
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))
    return means.withColumn("overall", costs.half_up(mean))


def quality_score(metadata: Column) -> Column:
    """The efficiency score of either schema; null if it isn't a number."""
    v = nested.variant(metadata)
    return F.coalesce(nested.number_field(v, "$.efficiency_score"), nested.number_field(v, "$.efficiencyScore"))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def bundle(facets: DataFrame) -> DataFrame:
    """section, key, count, sessions, mean and example of all that a facets page shows, from one scan and one grouped aggregate.

    Each session's row gives tags: a point of friction its category (or that of a rate limit) and its attribution, a
    pattern of enough confidence its category and driver, a session its outcome and workflow. mean is the severity
    of points and the confidence of patterns, example the first description.
    """
    array = lambda c: F.coalesce(F.try_variant_get(nested.variant(F.col(c)), "$", "array<variant>"), F.array().cast("array<variant>"))
    text = nested.text_field
    tag = lambda section, key, weight, said: F.struct(F.lit(section).alias("section"), key.alias("key"), weight.cast("double").alias("weight"), said.cast("string").alias("said"))
    none = F.lit(None)
    points = F.transform(F.filter(array("friction_points"), lambda e: F.trim(text(e, "$.category")) != ""), lambda e: F.array(tag("friction", text(e, "$.category"), severity(text(e, "$.severity")), text(e, "$.description")), tag("attribution", F.coalesce(text(e, "$.attribution"), F.lit("unattributed")), severity(text(e, "$.severity")), none)))
    sure = lambda e: nested.number_field(e, "$.confidence")
    kept = F.filter(array("effective_patterns"), lambda e: (F.trim(text(e, "$.category")) != "") & (sure(e) >= LEAST_CONFIDENCE))
    patterns = F.transform(kept, lambda e: F.array(tag("pattern", text(e, "$.category"), sure(e), text(e, "$.description")), tag("driver", F.concat_ws("\x01", text(e, "$.category"), F.coalesce(text(e, "$.driver"), F.lit("unlabeled"))), sure(e), none)))
    own = F.array(tag("outcome", F.col("outcome_satisfaction"), none, none), tag("workflow", F.col("workflow_pattern"), none, none), tag("sessions", F.lit("all"), none, none))
    rows = facets.select("session_id", F.explode(F.concat(F.flatten(points), F.flatten(patterns), own)).alias("x")).select("session_id", "x.*").filter("key IS NOT NULL")
    # raw categories are few, so they are counted by session first and named after
    section, key = F.col("section"), F.col("key")
    pattern, driver = F.substring_index(key, "\x01", 1), F.substring_index(key, "\x01", -1)
    named = F.when(section == "friction", C.normalize_category(key, C.FRICTION)).when(section == "pattern", C.normalize_category(key, C.PATTERN)).when(section == "driver", F.concat_ws(":", C.normalize_category(pattern, C.PATTERN), driver)).otherwise(key)
    rows = rows.withColumn("key", named).withColumn("section", F.when((section == "friction") & is_rate_limit(F.col("key")), "rate_limit").otherwise(section))
    return rows.groupBy("section", "key").agg(F.count(F.lit(1)).alias("count"), F.count_distinct("session_id").alias("sessions"), F.round(F.avg("weight"), 4).alias("mean"), F.min("said").alias("example"))


def missing_facets(sessions: DataFrame, insights: DataFrame, facets: DataFrame) -> DataFrame:
    """Sessions that have insights and no facets."""
    analysed = sessions.select("id").join(insights.select(F.col("session_id").alias("id")), "id", "left_semi")
    return analysed.join(facets.select(F.col("session_id").alias("id")), "id", "left_anti")


def outdated_facets(facets: DataFrame) -> DataFrame:
    """Sessions with a pattern that lacks category or driver, or a point that lacks an attribution."""
    pattern = elements(facets, "effective_patterns").filter(nested.text_field(F.col("e"), "$.category").isNull() | nested.text_field(F.col("e"), "$.driver").isNull())
    point = elements(facets, "friction_points").filter(nested.text_field(F.col("e"), "$.attribution").isNull())
    return pattern.select("session_id").union(point.select("session_id")).distinct()


def outdated_quality(insights: DataFrame) -> DataFrame:
    """Prompt-quality insights whose metadata has no findings at all; null findings are there."""
    return insights.filter(nested.variant(F.col("metadata")).isNotNull() & ~nested.has_key(F.col("metadata"), "findings"))
