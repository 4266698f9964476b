"""Per-key results when a few keys hold most rows.

The rows of a key never meet in one task.  Every partition keeps a hash table of
mergeable states - counts per key and slice of the order - which Spark's partial
aggregation spills when full, and only those compact states are shuffled.  The
states of one key tell in which slice the wanted position lies; the next round
looks into that slice alone with finer slices, until what is left of a key fits a
stated bound.  Those few rows are then ordered exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.sources.stage import Stage

#: Widths, as powers of two in microseconds, of the slices of successive rounds: 25 days, 18 minutes, 1 s, 1 ms, 1 us.
TIME_SLICES = (41, 30, 20, 10, 0)
#: Code points of the tie-breaking identifier that successive rounds look at, three a round.
TIE_STEP, TIE_LENGTH = 3, 60


def _slices() -> list:
    """Each a function of (microseconds, identifier) to an order-preserving slice, coarse to fine."""
    rounds = [lambda us, rid, w=w: F.shiftright(us, w) for w in TIME_SLICES]
    return rounds + [lambda us, rid, p=p: F.substring(rid, p, TIE_STEP) for p in range(1, TIE_LENGTH, TIE_STEP)]


def value_at_position(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    tie: str,
    *,
    position=lambda n: F.floor((n - 1) / F.lit(2)),
    bound: int = 50_000,
    broadcast_rows: int = 150_000,
) -> DataFrame:
    """``tie`` of the row at ``position(n)`` (from 0) of the n rows of each key, ordered by ``time``, then ``tie``.

    * ``time`` is a timestamp; null times come first, null ties before others.
    * ``bound``: most rows of a key that one task orders; beyond it, slices get finer.
    * ``broadcast_rows``: states up to this many rows (measured, about 60 bytes
      each) are broadcast to the scan; more are joined by shuffle.
    * Null keys form a key of their own; repeated rows count as often as they
      stand; an empty table gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    stage = Stage(spark, "keyed-rank")
    keys = list(keys)
    rows = df.select(*keys, F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(-(2**62))).alias("_us"), F.coalesce(F.col(tie), F.lit("")).alias("_tie"))
    left, wanted = rows, None
    for slice_of in _slices():
        cut: Column = slice_of(F.col("_us"), F.col("_tie"))
        # partial aggregation: a bounded hash table per partition, compact states shuffled
        states = left.groupBy(*keys, cut.alias("_slice")).agg(F.count(F.lit(1)).alias("_n"))
        by_key = Window.partitionBy(*keys)
        upto = by_key.orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if wanted is None:
            states = states.withColumn("_pos", position(F.sum("_n").over(by_key)))
        else:
            states = _match(states, wanted.select(*keys, "_pos"), keys, broadcast=False)
        states = states.withColumn("_upto", F.sum("_n").over(upto))
        states = states.filter((F.col("_pos") < F.col("_upto")) & (F.col("_pos") >= F.col("_upto") - F.col("_n")))
        found = stage.write(states.select(*keys, "_slice", (F.col("_pos") - F.col("_upto") + F.col("_n")).alias("_pos"), "_n"))
        size, most = found.agg(F.count(F.lit(1)), F.max("_n")).first()
        left = _match(left.withColumn("_slice", cut), found.select(*keys, "_slice"), [*keys, "_slice"], broadcast=size <= broadcast_rows).drop("_slice")
        wanted = found.drop("_slice", "_n")
        if not most or most <= bound:
            break
        left = stage.write(left)
    ranked = left.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_us", "_tie"))).alias("_rows"))
    out = _match(ranked, wanted, keys, broadcast=False)
    return out.select(*keys, F.element_at("_rows", (F.col("_pos") + 1).cast("int"))["_tie"].alias(tie))


def _match(a: DataFrame, b: DataFrame, keys: Sequence[str], *, broadcast: bool) -> DataFrame:
    """Null-safe equi-join keeping the columns of ``a`` and the further ones of ``b``."""
    b = b.select(*(F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in b.columns))
    on = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = one if on is None else on & one
    return a.join(F.broadcast(b) if broadcast else b, on).drop(*(f"_r_{k}" for k in keys))
