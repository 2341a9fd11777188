"""Groups of insights that share linked ids."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import nested
from tallyspark.plans.shared import write_table


def shared_links(insights: DataFrame) -> DataFrame:
    """id and linked, a row for each linked id; links lead to ids, which are not members by that."""
    return insights.select("id", F.explode(nested.string_list(F.col("linked_insight_ids"))).alias("linked")).distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Has every node at most one edge to a smaller one, which has none?"""
    ends = edges.select(F.explode(F.array(F.struct(F.col("high").alias("node"), F.lit(1).alias("lower")), F.struct(F.col("low").alias("node"), F.lit(0).alias("lower")))).alias("e")).select("e.*")
    per = ends.groupBy("node").agg(F.sum("lower").alias("lower"), F.count(F.lit(1)).alias("all"))
    return per.filter("lower > 1 OR (lower = 1 AND all > 1)").isEmpty()


def stars(edges: DataFrame) -> DataFrame:
    """high and low: each node's edge to the smallest node of its component, from edges (high > low) of any shape.

    Two steps take turns: every node ties its larger neighbours to the smallest node it knows, and then, with
    all smaller neighbours, itself. Both keep components whole and count of edges at most; a star stays as it is,
    so a node that a third of all others point to costs no further rounds. A round is a table in the shared folder.
    """
    edges = write_table(edges.distinct(), f"edges-{uuid.uuid4().hex}")
    while not _is_forest_of_stars(edges):
        around = edges.select("high", "low").union(edges.select(F.col("low"), F.col("high"))).toDF("node", "other")
        least = around.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("least"))
        tied = around.filter("other > node").join(least, "node").filter("other <> least").select(F.col("other").alias("high"), F.col("least").alias("low")).distinct()
        least = tied.groupBy("high").agg(F.min("low").alias("least"))
        both = tied.join(least, "high")
        tied = both.select("high", F.col("least").alias("low")).union(both.filter("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low")))
        edges = write_table(tied.distinct(), f"edges-{uuid.uuid4().hex}")
    return edges


def groups(insights: DataFrame) -> DataFrame:
    """id and group for each insight with links: insights that share a linked id, at however many removes, have one group, its smallest id.

    Those that share an id are tied to the smallest of them, which is one row a link however many share it.
    """
    links = write_table(shared_links(insights), f"links-{uuid.uuid4().hex}")
    smallest = links.groupBy("linked").agg(F.min("id").alias("low"))
    edges = links.join(smallest, "linked").filter("id <> low").select(F.col("id").alias("high"), "low")
    roots = stars(edges).select(F.col("high").alias("id"), F.col("low").alias("group"))
    return links.select("id").distinct().join(roots, "id", "left").select("id", F.coalesce("group", "id").alias("group"))


def group_summary(insights: DataFrame, members: DataFrame) -> DataFrame:
    """Groups of two and more: size, the most frequent type, projects and the latest time."""
    rows = insights.join(members, "id")
    size = rows.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("project_id").alias("projects"), F.max("timestamp").alias("latest"))
    kinds = rows.groupBy("group", "type").agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(F.min_by("type", F.struct(-F.col("n"), F.col("type"))).alias("type"))
    return size.filter("size >= 2").join(kinds, "group")


def linked_groups(found: DataFrame) -> DataFrame:
    """id, group and others, how many an id is linked to there, of groups (group, id) of at least two ids.

    Everybody in a group is linked to everybody else. The members say that in as many rows as there are;
    written out, a group's links would grow with the square of its size. links_of() looks a few up.
    """
    members = found.distinct()
    sizes = members.groupBy("group").agg((F.count(F.lit(1)) - 1).alias("others")).filter("others > 0")
    return members.join(sizes, "group")


def links_of(ids: DataFrame, members: DataFrame) -> DataFrame:
    """id and link for each of ids (id), over linked_groups()."""
    mine = members.join(ids.select("id").distinct(), "id", "left_semi").select("id", "group")
    return mine.join(members.select("group", F.col("id").alias("link")), "group").filter("id <> link").select("id", "link").distinct()
