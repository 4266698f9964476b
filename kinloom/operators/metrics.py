"""Evaluation against labels: confusion counts, threshold sweep, calibration, kappa, Wilson interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.operators.sampling import partition_of


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def with_rates(df: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to counts tp, fp, tn, fn; empty denominators give 0."""
    precision, recall = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    rated = df.withColumn("precision", precision).withColumn("recall", recall)
    return rated.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confusion(predicted: Column, label: Column) -> list[Column]:
    """Aggregates tp, fp, tn, fn; null counts as false."""
    p, y = F.coalesce(predicted, F.lit(False)), F.coalesce(label, F.lit(False))
    return [F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & ~y).alias("tn"), F.count_if(~p & y).alias("fn")]


def sweep(scored: DataFrame, *, bound: int = 1_000_000) -> DataFrame:
    """Counts and rates at every distinct score taken as threshold (score at or above it is positive).

    ``scored`` has label (boolean) and score.  One row per distinct score is
    aggregated first; the running sums go over those.  More than ``bound`` distinct
    scores are summed in two levels, so no task sees them all.
    """
    at = scored.filter("score IS NOT NULL").groupBy(F.col("score").alias("threshold")).agg(F.count_if("label").alias("y"), F.count_if(~F.col("label")).alias("n"))
    coarse = at.groupBy(F.floor(F.col("threshold") * 1024).alias("_c")).agg(F.sum("y").alias("cy"), F.sum("n").alias("cn"))
    above = Window.orderBy(F.desc("_c")).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = coarse.select("_c", F.coalesce(F.sum("cy").over(above), F.lit(0)).alias("by"), F.coalesce(F.sum("cn").over(above), F.lit(0)).alias("bn"), F.sum("cy").over(total).alias("ty"), F.sum("cn").over(total).alias("tn_"))
    within = Window.partitionBy("_c").orderBy(F.desc("threshold"))
    fine = at.withColumn("_c", F.floor(F.col("threshold") * 1024)).join(base, "_c")
    counted = fine.select(
        "threshold",
        (F.col("by") + F.sum("y").over(within)).alias("tp"),
        (F.col("bn") + F.sum("n").over(within)).alias("fp"),
        "ty",
        "tn_",
    ).select("threshold", "tp", "fp", (F.col("tn_") - F.col("fp")).alias("tn"), (F.col("ty") - F.col("tp")).alias("fn"))
    return with_rates(counted)


def select_thresholds(points: DataFrame, *, precision_target: float = 0.95, least_high: int = 30) -> DataFrame:
    """One row (high_threshold, review_threshold): the lowest precise enough on enough pairs (or null), and the best f1."""
    enough = (F.col("precision") >= precision_target) & (F.col("tp") + F.col("fp") >= least_high)
    best = F.struct("f1", "recall", "precision", (-F.col("threshold")).alias("t"))
    return points.agg(F.min(F.when(enough, F.col("threshold"))).alias("high_threshold"), F.max_by("threshold", best).alias("review_threshold"))


def calibrate(pairs: DataFrame, *, precision_target: float = 0.95, least_high: int = 30) -> DataFrame:
    """One row: thresholds chosen on the calibration part; high only if the held-out part bears it out.

    ``pairs`` has name, label (boolean) and score; rows without score take no part.
    """
    scored = pairs.filter("score IS NOT NULL").withColumn("part", partition_of(F.col("name")))
    chosen = select_thresholds(sweep(scored.filter("part = 'calibration'")), precision_target=precision_target, least_high=least_high)
    counts = scored.agg(F.count(F.lit(1)).alias("available_pairs"), F.count_if(F.col("part") == "calibration").alias("calibration_pairs"), F.count_if(F.col("part") == "held_out").alias("held_out_pairs"))
    picked = chosen.first()
    high, review = picked["high_threshold"], picked["review_threshold"]
    held = scored.filter("part = 'held_out'")
    holds = F.lit(False)
    if high is not None:
        positive = F.col("score") >= high
        n, right = F.count_if(positive), F.count_if(positive & F.col("label"))
        row = held.agg(n.alias("n"), right.alias("right")).first()
        holds = F.lit(bool(row["n"]) and row["right"] / row["n"] >= precision_target and row["n"] >= least_high)
    return counts.select(
        "*",
        F.when(holds, F.lit(high)).cast("double").alias("high_threshold"),
        F.lit(review).cast("double").alias("review_threshold"),
        F.when(~holds, F.lit("high_tier_disabled")).alias("warning"),
    )


def tier_metrics(pairs: DataFrame, tiers: dict[str, tuple[str, tuple[str, ...]]]) -> DataFrame:
    """(model, part, tp, fp, tn, fn, precision, recall, f1) for models given as name: (tier column, positive tiers).

    ``pairs`` has name and label; part is all_labeled or held_out.  One pass for all models.
    """
    calls = F.array(*(F.struct(F.lit(m).alias("model"), F.coalesce(F.col(c).isin(*positive), F.lit(False)).alias("predicted")) for m, (c, positive) in tiers.items()))
    parts = F.when(partition_of(F.col("name")) == "held_out", F.array(F.lit("all_labeled"), F.lit("held_out"))).otherwise(F.array(F.lit("all_labeled")))
    long = pairs.select("label", F.explode(parts).alias("part"), calls.alias("calls")).select("label", "part", F.inline("calls"))
    return with_rates(long.groupBy("model", "part").agg(*confusion(F.col("predicted"), F.col("label"))))


def cohens_kappa(pairs: DataFrame) -> DataFrame:
    """One row (n, kappa) for label_a, label_b: null without pairs, 1 when chance alone would agree fully."""
    rated = pairs.filter("coalesce(label_a, '') <> '' AND coalesce(label_b, '') <> ''")
    both = F.array(F.struct(F.col("label_a").alias("c"), F.lit(1).alias("a"), F.lit(0).alias("b"), (F.col("label_a") == F.col("label_b")).cast("int").alias("same")), F.struct(F.col("label_b").alias("c"), F.lit(0).alias("a"), F.lit(1).alias("b"), F.lit(0).alias("same")))
    each = rated.select(F.inline(both)).groupBy("c").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("same").alias("same"))
    total = each.agg(F.sum("a").alias("n"), F.sum("same").alias("same"), F.sum(F.col("a") * F.col("b")).alias("ab"))
    n = F.col("n")
    by_chance = F.try_divide(F.col("ab"), n * n)
    kappa = F.when(by_chance < 1, (F.col("same") / n - by_chance) / (1 - by_chance)).when(by_chance >= 1, 1.0)
    return total.select(F.coalesce(n, F.lit(0)).alias("n"), kappa.alias("kappa"))


def wilson_interval(successes: Column, total: Column, z: float = 1.96) -> Column:
    """(low, high), within 0 and 1; (0, 0) without trials."""
    p = successes / total
    base = 1 + z * z / total
    centre = (p + z * z / (2 * total)) / base
    radius = z * F.sqrt((p * (1 - p) + z * z / (4 * total)) / total) / base
    none = F.struct(F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))
    return F.when(F.coalesce(total, F.lit(0)) <= 0, none).otherwise(F.struct(F.greatest(F.lit(0.0), centre - radius).alias("low"), F.least(F.lit(1.0), centre + radius).alias("high")))
