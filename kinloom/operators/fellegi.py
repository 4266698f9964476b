"""Fellegi-Sunter model over comparison levels: u from random pairs, m by EM over level patterns.

Levels: -1 missing, 0 different, then one for each threshold reached.  Pairs are
counted by their pattern of levels in one distributed pass; the fit runs over these
few counts on the driver.  Pairs that meet in blocks are counted block by block and
never leave the task that makes them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions.strings import JaroWinkler, column, jaro_winkler
from kinloom.operators import blocking

#: Comparisons with their Jaro-Winkler thresholds (equality alone where there are none).
COMPARISONS = (("chi_full", (0.85, 0.95)), ("eng_full", (0.80, 0.88, 0.95)), ("birthday", ()), ("phone", ()), ("email", ()))
PRIOR = 1e-4
#: Pairs of the random sample for u, and pairs scored at most on request.
RANDOM_PAIRS, REQUESTED_PAIRS = 1_000_000, 5_000


def level(name: str, thresholds: tuple[float, ...], a: Column, b: Column) -> Column:
    """-1 missing, else the number of thresholds reached; equality is the highest level."""
    out = F.when(a.isNull() | b.isNull(), -1).when(a == b, len(thresholds) + 1)
    if thresholds:
        score = column(jaro_winkler, a, b)
        for i in range(len(thresholds) - 1, -1, -1):
            out = out.when(score >= thresholds[i], i + 1)
    return out.otherwise(0)


def level_columns() -> list[Column]:
    """``g_<comparison>`` of sides ``l_`` and ``r_`` in one row."""
    return [level(n, t, F.col(f"l_{n}"), F.col(f"r_{n}")).alias(f"g_{n}") for n, t in COMPARISONS]


def levels(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """``pairs`` (left_id, right_id) with ``g_<comparison>`` levels."""
    names = [n for n, _ in COMPARISONS]
    left = records.select(F.col("record_id").alias("left_id"), *(F.col(n).alias(f"l_{n}") for n in names))
    right = records.select(F.col("record_id").alias("right_id"), *(F.col(n).alias(f"r_{n}") for n in names))
    both = pairs.join(left, "left_id").join(right, "right_id")
    return both.select(*pairs.columns, *level_columns())


def pattern_counts(leveled: DataFrame) -> DataFrame:
    """(g_..., n): pairs of each pattern; at most 810 rows."""
    return leveled.groupBy(*(f"g_{n}" for n, _ in COMPARISONS)).agg(F.count(F.lit(1)).alias("n"))


#: Levels of each comparison, -1 among them.
_LEVELS = tuple(len(t) + 3 for _, t in COMPARISONS)
#: Pairs gone through at once, rows gathered at least before.
CHUNK, GATHERED = 1_000_000, 20_000


def _reached(thresholds: tuple[float, ...], score: JaroWinkler, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Thresholds that pairs of values reach; values that meet often are compared once."""
    (lefts, x), (rights, y) = (_places(v, len(score.texts)) for v in (a, b))
    if len(lefts) * len(rights) > 4 * len(a):
        return np.searchsorted(np.array(thresholds), score(a, b), side="right")
    at, known = x * len(rights) + y, np.zeros(len(lefts) * len(rights), np.int8)
    known[at] = 1
    asked = np.flatnonzero(known)
    known[asked] = np.searchsorted(np.array(thresholds), score(lefts[asked // len(rights)], rights[asked % len(rights)]), side="right")
    return known[at]


def _places(v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers (below ``n``) of ``v``, and the place of each among them."""
    held = np.zeros(n, bool)
    held[v] = True
    return np.flatnonzero(held), (np.cumsum(held) - 1)[v]


def _block_counts(table: pa.Table) -> np.ndarray:
    """Pairs of each pattern (a number in base ``_LEVELS``) among the rows of whole blocks, which are ordered by block and id."""
    n, slot = table.num_rows, table.column("slot").to_numpy()
    kid, rows = table.column("kid").to_numpy(), np.arange(table.num_rows)

    def coded(c: str) -> tuple[np.ndarray, list[str]]:
        whole = pa.array(table.column(c).to_pylist(), pa.string()).dictionary_encode()
        return whole.indices.fill_null(-1).to_numpy(zero_copy_only=False), whole.dictionary.to_pylist()

    source, values = coded("source")[0], {c: coded(c) for c, _ in COMPARISONS}
    scores = {c: JaroWinkler(values[c][1]) for c, t in COMPARISONS if t}
    earlier = []  # the blocks of a row before this one; none is like no other
    for i in range(int(slot.max())):
        own = table.column(f"k{i}").combine_chunks()
        used = own.is_valid().to_numpy(zero_copy_only=False) & (slot > i)
        if used.any():
            earlier.append(np.where(used, own.fill_null(0).to_numpy(), -1 - rows))

    def counted(l: np.ndarray, r: np.ndarray) -> np.ndarray:
        met = source[l] != source[r]
        for k in earlier:
            met &= k[l] != k[r]
        l, r = l[met], r[met]
        pattern = np.zeros(len(l), np.int64)
        for (c, thresholds), base in zip(COMPARISONS, _LEVELS, strict=True):
            a, b = values[c][0][l], values[c][0][r]
            level = np.where(a == b, len(thresholds) + 1, 0)
            if thresholds:
                asked = np.flatnonzero((a != b) & (a >= 0) & (b >= 0))
                level[asked] = _reached(thresholds, scores[c], a[asked], b[asked])
            level[(a < 0) | (b < 0)] = -1
            pattern = pattern * base + level + 1
        return np.bincount(pattern, minlength=int(np.prod(_LEVELS)))

    partners = np.searchsorted(kid_ends := np.append(np.flatnonzero(np.diff(kid)) + 1, n), rows, side="right")
    partners = kid_ends[partners] - rows - 1
    before = np.cumsum(partners) - partners
    total, at = np.zeros(int(np.prod(_LEVELS)), np.int64), 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(before, before[at] + CHUNK, side="right")) - 1)
        own = partners[at:end]
        l = np.repeat(rows[at:end], own)
        r = np.arange(len(l)) - np.repeat(before[at:end] - before[at], own) + l + 1
        total += counted(l, r)
        at = end
    return total


def _count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``mapInArrow`` function over rows in order of block and id: (pattern, n) of the pairs within blocks."""
    total, held, waiting = np.zeros(int(np.prod(_LEVELS)), np.int64), [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        waiting += batch.num_rows
        if waiting < GATHERED:
            continue
        table = pa.Table.from_batches(held)
        kid = table.column("kid").to_numpy()
        end = int(np.searchsorted(kid, kid[-1]))  # the last block may go on
        if end:
            total += _block_counts(table.slice(0, end))
        held, waiting = table.slice(end).combine_chunks().to_batches(), table.num_rows - end
    if waiting:
        total += _block_counts(pa.Table.from_batches(held))
    known = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(total[known])], names=["pattern", "n"])


def met_pattern_counts(found: blocking.Blocks) -> DataFrame:
    """(g_..., n): pattern counts of the pairs of records with ids of their own that meet in a block of ``found``, which carries the comparisons."""
    placed = blocking.spread(found.members, range(len(blocking.SLOTS)), found.tasks()).sortWithinPartitions("kid", "record_id")
    wanted = placed.select("kid", "slot", "source", *(f"k{i}" for i in range(len(blocking.SLOTS))), *(c for c, _ in COMPARISONS))
    patterns = wanted.mapInArrow(_count_blocks, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))
    levels_of, weight = [], 1
    for (c, _), base in zip(reversed(COMPARISONS), reversed(_LEVELS), strict=True):
        levels_of.insert(0, (F.floor(F.col("pattern") / F.lit(weight)).cast("int") % base - 1).alias(f"g_{c}"))
        weight *= base
    return patterns.select(*levels_of, "n")


def random_pairs(records: DataFrame, most: int = RANDOM_PAIRS) -> DataFrame:
    """Pairs of different sources that met by chance: records are dealt into lots by the hash of their id.

    A lot holds about 32 records and pairs within itself; lots are taken in hash
    order until about ``most`` pairs are reached.
    """
    lot_size = 32
    lots_wanted = max(1, most // (lot_size * lot_size // 2))
    n = records.count()
    lots = max(1, n // lot_size)
    dealt = records.filter("source IS NOT NULL").select("record_id", "source", F.pmod(F.xxhash64("record_id"), F.lit(lots)).alias("lot")).filter(F.col("lot") < lots_wanted)
    a = dealt.select("lot", F.col("record_id").alias("left_id"), F.col("source").alias("left_source"))
    b = dealt.select("lot", F.col("record_id").alias("right_id"), F.col("source").alias("right_source"))
    return a.join(b, "lot").filter("left_id < right_id AND left_source <> right_source").select("left_id", "right_id")


@dataclass
class Model:
    m: dict[str, dict[int, float]]
    u: dict[str, dict[int, float]]
    prior: float = PRIOR


def _shares(patterns: list, name: str, weights: np.ndarray, top: int) -> dict[int, float]:
    """Smoothed share of each level among pairs where the comparison is known."""
    total = np.full(top + 1, 1e-6)
    for p, w in zip(patterns, weights, strict=True):
        if p[name] >= 0:
            total[p[name]] += w
    return {i: float(x) for i, x in enumerate(total / total.sum())}


def fit(random_counts: list, block_counts: list[tuple[tuple[str, ...], list]], *, rounds: int = 25) -> Model:
    """u from the random pairs' counts; m by EM with u fixed, in one session for each blocking rule.

    ``block_counts`` gives for each rule the comparisons it holds fixed and the
    pattern counts of its pairs; a fixed comparison learns nothing in that session,
    and the sessions' m are averaged.
    """
    tops = {n: len(t) + 1 for n, t in COMPARISONS}
    n_random = np.array([r["n"] for r in random_counts], float)
    plain = [{n: r[f"g_{n}"] for n in tops} for r in random_counts]
    u = {n: _shares(plain, n, n_random, tops[n]) for n in tops}
    learnt: dict[str, list[dict[int, float]]] = {n: [] for n in tops}
    for fixed, rows in block_counts:
        if not rows:
            continue
        counts = np.array([r["n"] for r in rows], float)
        patterns = [{n: r[f"g_{n}"] for n in tops} for r in rows]
        free = [n for n in tops if n not in fixed]
        m = {n: {i: (0.9 if i == tops[n] else 0.1 / tops[n]) for i in range(tops[n] + 1)} for n in free}
        share = 0.3
        for _ in range(rounds):
            odds = np.full(len(rows), np.log(share / (1 - share)))
            for n in free:
                odds += np.array([0.0 if p[n] < 0 else np.log(m[n][p[n]] / u[n][p[n]]) for p in patterns])
            posterior = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
            share = float(np.clip((posterior * counts).sum() / counts.sum(), 1e-6, 1 - 1e-6))
            m = {n: _shares(patterns, n, posterior * counts, tops[n]) for n in free}
        for n in free:
            learnt[n].append(m[n])
    default = {n: {i: (0.9 if i == tops[n] else 0.1 / tops[n]) for i in range(tops[n] + 1)} for n in tops}
    m = {n: {i: float(np.mean([x[i] for x in learnt[n]])) for i in range(tops[n] + 1)} if learnt[n] else default[n] for n in tops}
    return Model(m, u)


def term_frequencies(records: DataFrame, name: str) -> DataFrame:
    """(value, tf): share of each value among the records that have one."""
    counts = records.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = records.filter(F.col(name).isNotNull()).count()
    return counts.select("value", (F.col("n") / F.lit(max(1, total))).alias("tf"))


def match_weight(model: Model) -> Column:
    """Bits: log2 of the prior odds plus log2(m/u) of every known comparison."""
    weight = F.lit(float(np.log2(model.prior / (1 - model.prior))))
    for n, t in COMPARISONS:
        bits = F.when(F.col(f"g_{n}") < 0, 0.0)
        for i in range(len(t) + 2):
            bits = bits.when(F.col(f"g_{n}") == i, float(np.log2(model.m[n][i] / model.u[n][i])))
        weight = weight + bits
    return weight


def predict(leveled: DataFrame, model: Model, *, least_weight: float = -20.0) -> DataFrame:
    """(left_id, right_id, match_weight, probability) of pairs at or above ``least_weight`` bits."""
    w = leveled.withColumn("match_weight", match_weight(model)).filter(F.col("match_weight") >= least_weight)
    return w.select("left_id", "right_id", "match_weight", (1 / (1 + F.pow(F.lit(2.0), -F.col("match_weight")))).alias("probability"))


def fit_predict(records: DataFrame, pairs: DataFrame, rules: list[tuple[tuple[str, ...], DataFrame]], requested: DataFrame | None = None) -> DataFrame:
    """Fit on ``rules`` (fixed comparisons, pairs) and score ``pairs``, and of ``requested`` the first unscored ones."""
    random_counts = pattern_counts(levels(random_pairs(records), records)).collect()
    blocks = [(fixed, pattern_counts(levels(p, records)).collect()) for fixed, p in rules]
    model = fit(random_counts, blocks)
    scored = predict(levels(pairs.select("left_id", "right_id"), records), model)
    if requested is not None:
        missing = requested.select("left_id", "right_id").distinct().join(scored, ["left_id", "right_id"], "left_anti")
        extra = levels(missing.orderBy("left_id", "right_id").limit(REQUESTED_PAIRS), records)
        scored = scored.unionByName(predict(extra, model, least_weight=float("-inf")))
    return scored
