"""Problem 5: one group identifier for everything linked directly or indirectly.

Hash-to-min over relation rows: ``(v, u)`` says that u is in the cluster set of v.
In a round every vertex sends its set to the least member and that minimum to all
members.  Sets are never gathered: a set of any size is many rows, joined by shuffle
with skew handling and reduced by partial aggregation.  Groups that have become
stars (the root knows all, each other member knows only the root) are set aside, so
later rounds touch only what is still changing - long chains, which take a number
of rounds logarithmic in their length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.sources.stage import Stage


def connected_groups(edges: DataFrame, left: str, right: str, stage: Stage) -> DataFrame:
    """(vertex, group) for every vertex of ``edges``; group is the least vertex of its component.

    A row with equal ends, or with one end null, makes a vertex without link; rows
    with both ends null are left out.  Repeated edges and both directions are fine;
    an empty table gives an empty result.
    """
    a, b = F.coalesce(F.col(left), F.col(right)), F.coalesce(F.col(right), F.col(left))
    sent = F.array(*(F.struct(x.alias("v"), y.alias("u")) for x, y in ((a, b), (b, a), (a, a), (b, b))))
    sets = stage.write(edges.filter(a.isNotNull()).select(F.explode(sent).alias("e")).select("e.v", "e.u").distinct())
    done = []
    while True:
        least = stage.write(sets.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n")))
        leaves = least.filter("n = 1 AND v <> m").groupBy("m").agg(F.count(F.lit(1)).alias("k"))
        roots = least.filter("v = m").select("m", "n")
        stars = stage.write(roots.join(leaves, "m", "left").filter("n = coalesce(k, 0) + 1").select("m"))
        done.append(stage.write(least.join(stars, "m", "left_semi").select(F.col("v").alias("vertex"), F.col("m").alias("group"))))
        active = least.join(stars, "m", "left_anti").select("v", "m")
        reach = sets.join(active, "v")
        sent = F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))
        after = stage.write(reach.select(F.explode(sent).alias("e")).select("e.v", "e.u").distinct())
        for old in (sets, least, stars):
            stage.drop(old)
        sets = after
        if sets.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def contracted_groups(edges: DataFrame, left: str, right: str, stage: Stage) -> DataFrame:
    """(vertex, group), group the least vertex of the component, for links whose vertices are numbered without regard to the links.

    Every vertex goes into its least neighbour and the links between what is left are
    drawn again, until none is left; then the steps are followed back.  Small groups,
    as records of one person make, end in one round.  A row with equal ends or with
    a null makes no vertex; an empty table gives an empty result.
    """
    links = edges.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    steps, drawn = [], None
    while True:
        ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = stage.write(ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("vertex"), F.least("a", "m").alias("group")))
        steps.append(near)
        one, two = (near.select(F.col("vertex").alias(x), F.col("group").alias(f"g{x}")).hint("shuffle_hash") for x in "ab")
        up = links.join(one, "a").join(two, "b").filter("ga <> gb").select(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).distinct()
        before, drawn = drawn, stage.write(up)
        stage.drop(before)
        links = drawn
        if drawn.isEmpty():
            break
    out = steps.pop()
    while steps:
        further = out.select(F.col("vertex").alias("group"), F.col("group").alias("to"))
        out = steps.pop().join(further, "group", "left").select("vertex", F.coalesce("to", "group").alias("group"))
    return out


def registration_key(source: Column, key: Column, record_id: Column) -> list[Column]:
    """Two columns that name the registration of a row; a row without source or key is one of its own."""
    whole = (F.coalesce(source, F.lit("")) != "") & key.isNotNull()
    return [F.when(whole, source).otherwise(F.lit("")).alias("_s"), F.when(whole, key).otherwise(record_id).alias("_k")]


def registration_groups(master: DataFrame, matching: DataFrame) -> DataFrame:
    """(record_id, group_id) of all rows whose registration is a parent's or a linked candidate's.

    * Match rows whose parent is null or not in ``master`` link nothing; those
      without client or client_id, or with a candidate not in ``master``, leave the
      parent's registration unlinked.
    * Self matches, both directions and repeated match rows change nothing.
    * group_id is the smallest record_id of the group; scores play no part.
    """
    stage = Stage(master.sparkSession, "groups")
    rows = master.filter("record_id IS NOT NULL").select("record_id", *registration_key(F.col("source"), F.col("ccd_source_key"), F.col("record_id")))
    filled = (F.coalesce("client", F.lit("")) != "") & (F.coalesce("client_id", F.lit("")) != "")
    matches = matching.filter("parent IS NOT NULL").select("parent", F.when(filled, F.col("client")).alias("_cs"), F.when(filled, F.col("client_id")).alias("_ck")).distinct()
    registrations = stage.write(rows.groupBy("_s", "_k").agg(F.min("record_id").alias("_rep")))
    candidates = registrations.select(F.col("_s").alias("_cs"), F.col("_k").alias("_ck"), F.col("_rep").alias("_right"))
    links = (
        matches.join(rows.withColumnRenamed("record_id", "parent"), "parent")
        .join(registrations, ["_s", "_k"])
        .join(candidates, ["_cs", "_ck"], "left")
        .select(F.col("_rep").alias("_left"), "_right")
    )
    groups = connected_groups(links, "_left", "_right", stage)
    grouped = registrations.join(groups, F.col("_rep") == F.col("vertex")).select("_s", "_k", F.col("group").alias("group_id"))
    return rows.join(grouped, ["_s", "_k"]).select("record_id", "group_id")
