"""Publication of prepared analyses: both passes checked against each other and against what their session is now.

An analysis is prepared from a frozen input and published later. Per session the two passes must be there, of the
present pipeline, in one language, of one input; and that input must still be the session's. What passes replaces all
of the session's rows in one version of the table, under the number that the writer started from; what doesn't is
named with its reason and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.streaming import ingest

PASSES = ("session", "prompt_quality")
PUBLISHED = "published"


def judged(stages: DataFrame, now: DataFrame, pipelines: dict[str, str]) -> DataFrame:
    """session_id and verdict of the sessions in stages (session_id, analysis_type, input_revision, session_message_count, language, pipeline_revision).

    now: session_id, input_revision and message_count of the sessions that exist; pipelines: the revision for each
    language. Verdicts: published, or incomplete, policy, language, passes, gone, changed. Of repeated passes all count.
    """
    revision = F.lit(None).cast("string")
    for language, current in pipelines.items():
        revision = F.when(F.col("language") == language, current).otherwise(revision)
    told = F.struct("input_revision", "session_message_count")
    per = stages.groupBy("session_id").agg(
        F.count_distinct(F.when(F.col("analysis_type").isin(*PASSES), F.col("analysis_type"))).alias("passes"),
        F.count_if(F.col("language").isNull() | ~F.col("pipeline_revision").eqNullSafe(revision) | revision.isNull()).alias("old"),
        F.min("language").alias("low"), F.max("language").alias("high"), F.min(told).alias("least"), F.max(told).alias("most"),
    )
    rows = per.join(now.select("session_id", F.lit(True).alias("there"), F.struct("input_revision", F.col("message_count").alias("session_message_count")).alias("now")), "session_id", "left")
    verdict = (
        F.when(F.col("passes") < len(PASSES), "incomplete").when(F.col("old") > 0, "policy").when(F.col("low") != F.col("high"), "language").when(F.col("least") != F.col("most"), "passes")
        .when(F.col("there").isNull(), "gone").when(~F.col("least").eqNullSafe(F.col("now")), "changed").otherwise(PUBLISHED)
    )
    return rows.select("session_id", verdict.alias("verdict"))


def publish(spark: SparkSession, table: str, stages: DataFrame, now: DataFrame, pipelines: dict[str, str], insights: DataFrame, state: ingest.State) -> DataFrame:
    """Verdicts of the sessions in stages, after the insights (session_id, ...) of those that pass took the place of their old ones.

    state is what the table was when the analyses were prepared; StaleWriter is raised if it has changed since.
    """
    verdicts = ingest.staged(judged(stages, now, pipelines), table)
    passed = verdicts.filter(F.col("verdict") == PUBLISHED).select(F.col("session_id").alias("path"))
    new = ingest.staged(insights.withColumn("path", F.col("session_id")).join(passed, "path", "left_semi"), table)
    ingest.replace(spark, table, new, passed, state)
    return verdicts
