"""Problem 9: filling containers of fixed capacity with items of varying length.

Only an item longer than the capacity is split: into full pieces and a rest.  The
lengths of all pieces make a histogram with at most ``capacity`` entries, whatever
the number of items.  Over it the configuration linear program (how often to use
which combination of lengths) is solved by multiplicative weights: lengths still
lacking containers are dearer, a knapsack dynamic program finds the combination
worth most at these prices, until every item is placed.  Each use of a combination
is rounded to whole containers when it is found and what it takes is gone, so later
prices and combinations are those of what rounding left.  The combinations then meet
the items by rank: the k-th item of a length goes to the k-th place for that length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.sources.stage import Stage

#: Rows of one length that one task numbers; longer runs are parted.
RANK_BOUND = 100_000


def best_combination(lengths: np.ndarray, prices: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[dict[int, int], float]:
    """Bounded knapsack: index to multiplicity of the combination of greatest price within ``capacity`` and ``counts``, and that price.

    Multiplicities are split into powers of two, so each step of the dynamic program
    is one whole-array operation over the capacities.
    """
    kind, many = [], []
    for k in range(len(lengths)):
        left, size = min(int(counts[k]), capacity // int(lengths[k])), 1
        while left > 0:
            kind.append(k)
            many.append(min(size, left))
            left -= size
            size *= 2
    value = np.zeros(capacity + 1)
    taken = np.zeros((len(kind), capacity + 1), bool)
    for i, (k, a) in enumerate(zip(kind, many, strict=True)):
        room = a * int(lengths[k])
        with_it = value[: capacity + 1 - room] + a * prices[k]
        np.greater(with_it, value[room:], out=taken[i, room:])
        np.maximum(with_it, value[room:], out=value[room:])
    used: dict[int, int] = {}
    c = capacity
    for i in range(len(kind) - 1, -1, -1):
        if taken[i, c]:
            used[kind[i]] = used.get(kind[i], 0) + many[i]
            c -= many[i] * int(lengths[kind[i]])
    return used, float(value[capacity])


@dataclass
class Plan:
    """Combinations in order: each ({length: multiplicity}, number of containers)."""

    capacity: int
    combinations: list[tuple[dict[int, int], int]] = field(default_factory=list)
    #: No packing of the histogram, even with fractions of containers, takes fewer (from the prices of the program).
    least: float = 0.0

    @property
    def containers(self) -> int:
        return sum(n for _, n in self.combinations)

    def places(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length: first rank, multiplicity and first container of every combination that holds it."""
        out: dict[int, list[list[int]]] = {}
        first = 0
        for combination, n in self.combinations:
            for length, many in combination.items():
                rows = out.setdefault(length, [[0, 0, 0]])
                rows[-1][1:] = [many, first]
                rows.append([rows[-1][0] + many * n, 0, 0])
            first += n
        return {k: tuple(np.array(v[:-1], np.int64).T) for k, v in out.items()}  # type: ignore[misc]


def _program(lengths: np.ndarray, counts: np.ndarray, capacity: int, step: float) -> tuple[list[tuple[dict[int, int], int]], float]:
    """Combinations of indexes that place the whole histogram, and the greatest lower bound met on the way.

    Multiplicative weights: the price of a length falls with the share of it that is
    placed.  The knapsack finds the combination worth most at these prices; it is
    used for ``step`` of what its scarcest length has left, rounded to whole
    containers, one at least.  At any prices, what the whole histogram is worth over
    what a container can be worth bounds the containers of the linear program from
    below.
    """
    left, found = counts.astype(np.int64), []
    worth = lengths / capacity
    least = float(worth @ counts)  # prices in proportion to the lengths
    while len(open_ := np.flatnonzero(left)):
        prices = np.exp(left[open_] / counts[open_]) * lengths[open_] ** 1.2  # long lengths are worth more for their size: they are harder to place late
        used, _ = best_combination(lengths[open_], prices, left[open_], capacity)
        used = {int(open_[k]): a for k, a in used.items()}
        n = max(1, int(step * min(left[k] // a for k, a in used.items())))
        found.append((used, n))
        for k, a in used.items():
            left[k] -= a * n
    return found, least


def dual_bound(lengths: np.ndarray, prices: np.ndarray, counts: np.ndarray, capacity: int) -> float:
    """Containers that any packing of the histogram needs, by ``prices`` of the lengths."""
    best = best_combination(lengths, prices, np.full(len(lengths), capacity), capacity)[1]
    return float(prices @ counts) / best if best else 0.0


def longest_first(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Combinations of indexes: longest lengths first, each as often as it still fits."""
    left, found = counts.astype(np.int64), []
    while left.any():
        room, used = capacity, {}
        for k in np.flatnonzero(left)[::-1]:
            many = min(int(left[k]), room // int(lengths[k]))
            if many:
                used[int(k)] = many
                room -= many * int(lengths[k])
        n = min(int(left[k]) // a for k, a in used.items())
        found.append((used, n))
        for k, a in used.items():
            left[k] -= a * n
    return found


def make_plan(histogram: dict[int, int], capacity: int, *, step: float = 0.5) -> Plan:
    """Containers for all of ``histogram`` (length to count, lengths within capacity).

    The combinations are those of the program; should packing longest lengths first
    ever take fewer containers, that packing is used instead.
    """
    plan = Plan(capacity)
    histogram = {k: v for k, v in histogram.items() if v > 0}
    if not histogram:
        return plan
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], np.int64)
    found, least = _program(lengths, counts, capacity, step)
    halves = np.where(2 * lengths > capacity, 1.0, np.where(2 * lengths == capacity, 0.5, 0.0))  # of lengths over half, no two share a container
    plan.least = max(least, dual_bound(lengths, halves, counts, capacity))
    other = longest_first(lengths, counts, capacity)
    if sum(n for _, n in other) < sum(n for _, n in found):
        found = other
    plan.combinations = [({int(lengths[k]): a for k, a in used.items()}, n) for used, n in found]
    return plan


def pieces(df: DataFrame, item: str, size: Column, capacity: int) -> DataFrame:
    """(item, piece, start, n_tokens): one piece, or full pieces and a rest for an item beyond ``capacity``."""
    sized = df.select(F.col(item), size.cast("long").alias("_size")).filter("_size > 0")
    number = F.explode(F.sequence(F.lit(0), ((F.col("_size") - 1) / capacity).cast("int")))
    out = sized.select(item, "_size", number.alias("piece"))
    start = F.col("piece").cast("long") * capacity
    return out.select(item, "piece", start.alias("start"), F.least(F.col("_size") - start, F.lit(capacity)).cast("int").alias("n_tokens"))


def pack(df: DataFrame, item: str, size: Column, capacity: int, stage: Stage, *, rank_bound: int = RANK_BOUND) -> DataFrame:
    return pack_by_plan(df, item, size, capacity, stage, rank_bound=rank_bound)[0]


def pack_by_plan(df: DataFrame, item: str, size: Column, capacity: int, stage: Stage, *, rank_bound: int = RANK_BOUND) -> tuple[DataFrame, Plan]:
    """(item, piece, start, n_tokens, container_id) of every item with a size above 0, and the plan it follows.

    Items of null or zero size need no room and get no row.  Items are told apart by
    ``item``; repeated items are placed as often as they stand.  An empty table
    gives an empty result.  What the driver holds is bounded by ``capacity``.
    """
    if capacity < 1:
        raise ValueError("a container holds at least one token")
    cut = stage.write(pieces(df, item, size, capacity))
    histogram = {r[0]: r[1] for r in cut.groupBy("n_tokens").agg(F.count(F.lit(1))).collect()}  # at most `capacity` rows
    plan = make_plan(histogram, capacity)
    parts = max(1, -(-max(histogram.values(), default=1) // rank_bound))
    cut = cut.withColumn("_part", F.pmod(F.xxhash64(item, "piece"), F.lit(parts)).cast("int"))
    sizes = cut.groupBy("n_tokens", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("n_tokens").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("n_tokens", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("n_tokens", "_part").orderBy(item, "piece")
    ranked = cut.withColumn("_row", F.row_number().over(own)).join(sizes, ["n_tokens", "_part"])
    ranked = ranked.select(item, "piece", "start", "n_tokens", (F.col("_before") + F.col("_row") - 1).alias("_rank"))
    places = plan.places()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("n_tokens").to_numpy(), batch.column("_rank").to_numpy()
            container = np.empty(len(rank), np.int64)
            for value in np.unique(length):
                at = np.nonzero(length == value)[0]
                first, many, base = places[int(value)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                container[at] = base[k] + (rank[at] - first[k]) // many[k]
            columns = [batch.column(c) for c in (item, "piece", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(container)], names=[item, "piece", "start", "n_tokens", "container_id"])

    kind = dict(df.select(item).dtypes)[item]
    return ranked.mapInArrow(place, f"`{item}` {kind}, piece int, start bigint, n_tokens int, container_id bigint"), plan
