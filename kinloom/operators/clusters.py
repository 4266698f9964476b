"""Connected groups of accepted pairs and the contradictions inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.sources.stage import Stage


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """(id, component) for the ends of ``edges`` (left_id, right_id); component is the least id.

    Least labels spread along the edges and then jump along the labels, so long
    chains take few rounds.  Every round is one aggregation with map-side combining,
    written to the shared folder.
    """
    both = edges.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    links = stage.write(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = stage.write(links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("id"), "label"))
    while True:
        spread = links.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(spread.withColumnRenamed("a", "id"), "id").select("id", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("label").alias("further"))
        moved = stage.write(nearer.join(jump, "next").select("id", F.least("next", "further").alias("component"), F.col("label").alias("before")))
        stage.drop(labels)
        if moved.filter("component <> before").isEmpty():
            return moved.select("id", "component")
        labels = stage.write(moved.select("id", F.col("component").alias("label")))
        stage.drop(moved)


def inconsistent_pairs(pairs: DataFrame, stage: Stage) -> DataFrame:
    """(left_id, right_id) of all pairs whose left end lies in a component that holds a conflict.

    ``pairs`` has left_id, right_id, tier; tiers high and review link, conflict_review
    contradicts when both its ends are in one component.
    """
    groups = stage.write(components(pairs.filter("tier IN ('high', 'review')"), stage))
    left = groups.select(F.col("id").alias("left_id"), F.col("component").alias("cl"))
    right = groups.select(F.col("id").alias("right_id"), F.col("component").alias("cr"))
    against = pairs.filter("tier = 'conflict_review'")
    broken = against.join(left, "left_id").join(right, "right_id").filter("cl = cr").select("cl").distinct()
    ends = left.join(broken, "cl", "left_semi").select("left_id")
    alone = against.filter("left_id = right_id").select("left_id")
    marked = ends.unionByName(alone).distinct()
    return pairs.join(marked, "left_id", "left_semi").select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")).distinct()
