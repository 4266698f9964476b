"""Problem 7: consensus of annotators who disagree.

Each annotator has a confusion matrix (what they say of a pair that is the same
person, and of one that is not); each item has a posterior over the classes.  Both
are estimated by expectation-maximisation with smoothing.  An item's machine score,
where there is one, takes part as one more annotator whose answers are score bands;
it is weak evidence, and its matrix says how weak.  Chance-corrected agreement is
reported apart from the model, from the answers alone.

One pass over the items a round: a partition adds up its items' votes as arrays and
returns one row per (annotator, answer), so what moves and what the driver holds is
bounded by the number of annotators, never by the number of items.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.sources.stage import Stage

ANSWERS = ("Same", "Different", "Unsure")
#: Most annotators a run accepts; their matrices (a few numbers each) are held by the driver.
MAX_ANNOTATORS = 200_000
BANDS = 12


def latest_answers(labels: DataFrame) -> DataFrame:
    """(item, annotator, answer): each annotator's latest answer, adjudication left out.

    Rows without parent, reviewer or a known label count as not given; equal times
    are settled by the greater idx, then the greater label; repeated rows change nothing.
    """
    own = labels.filter("parent IS NOT NULL AND reviewer IS NOT NULL AND coalesce(is_adjudication, 0) <> 1").filter(F.col("label").isin(*ANSWERS))
    return own.groupBy(F.col("parent").alias("item"), F.col("reviewer").alias("annotator")).agg(
        F.max_by("label", F.struct("submitted_at", "idx", "label")).alias("answer")
    )


def score_band(score: Column) -> Column:
    """Band 0..BANDS-1 of a score in [0, 1]; -1 without one."""
    return F.coalesce(F.least(F.greatest(F.floor(score * BANDS), F.lit(0)), F.lit(BANDS - 1)).cast("int"), F.lit(-1))


def _vote_sums(llr: np.ndarray, prior: float):
    """Posterior of each item, summed per code: ``codes`` are positions in ``llr`` (log likelihood ratios)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, total, items, mass = np.zeros(len(llr)), np.zeros(len(llr)), 0, 0.0
        for batch in batches:
            lists = batch.column(0)
            codes, starts = _flat(lists)
            post = _posterior(llr, prior, codes, starts)
            lengths = np.diff(starts)
            each = np.repeat(post, lengths)
            same += np.bincount(codes, weights=each, minlength=len(llr))
            total += np.bincount(codes, minlength=len(llr))
            items += len(post)
            mass += post.sum()
        used = np.nonzero(total)[0]
        code = np.append(used, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(code, pa.int32()), pa.array(np.append(same[used], mass)), pa.array(np.append(total[used], items).astype(float))],
            names=["code", "same", "total"],
        )

    return run


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    starts = lists.offsets.to_numpy().astype(np.int64)
    codes = lists.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]]
    return codes, starts - starts[0]


def _posterior(llr: np.ndarray, prior: float, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(llr[codes])])
    logit = prior + sums[starts[1:]] - sums[starts[:-1]]
    return 1.0 / (1.0 + np.exp(-np.clip(logit, -60, 60)))


class Consensus:
    """Fitted annotator model over coded answers."""

    def __init__(self, names: list[str], same: np.ndarray, different: np.ndarray, prior: float, rounds: int):
        #: names[i] is (kind, annotator, answer); same[i] and different[i] are P(answer | class)
        self.names, self.same, self.different, self.prior, self.rounds = names, same, different, prior, rounds

    @property
    def llr(self) -> np.ndarray:
        return np.log(self.same) - np.log(self.different)


def _matrices(sums: np.ndarray, blocks: list[slice], smoothing: float) -> np.ndarray:
    out = np.empty_like(sums)
    for b in blocks:
        out[b] = (sums[b] + smoothing) / (sums[b].sum() + smoothing * (b.stop - b.start))
    return out


def fit_consensus(coded: DataFrame, annotators: list[str], *, bands: int, smoothing: float = 1.0, tolerance: float = 1e-4, most_rounds: int = 60) -> Consensus:
    """EM over ``coded`` (one array column ``codes``); starts from the answers' own votes."""
    width = len(ANSWERS)
    size = len(annotators) * width + bands
    blocks = [slice(i, i + width) for i in range(0, len(annotators) * width, width)] + ([slice(size - bands, size)] if bands else [])
    llr = np.zeros(size)
    llr[0 : len(annotators) * width : width] = math.log(3)
    llr[1 : len(annotators) * width : width] = -math.log(3)
    prior, same, different, rounds = 0.0, None, None, 0
    for rounds in range(1, most_rounds + 1):
        got = coded.select("codes").mapInArrow(_vote_sums(llr, prior), "code int, same double, total double")
        rows = got.groupBy("code").agg(F.sum("same").alias("same"), F.sum("total").alias("total")).collect()  # one row per (annotator, answer)
        s, t, mass, items = np.zeros(size), np.zeros(size), 0.0, 0.0
        for r in rows:
            if r["code"] < 0:
                mass, items = r["same"], r["total"]
            else:
                s[r["code"]], t[r["code"]] = r["same"], r["total"]
        same, different = _matrices(s, blocks, smoothing), _matrices(t - s, blocks, smoothing)
        rate = (mass + smoothing) / (items + 2 * smoothing)
        new, prior_new = np.log(same) - np.log(different), math.log(rate / (1 - rate))
        moved = max(np.abs(new - llr).max(initial=0.0), abs(prior_new - prior))
        llr, prior = new, prior_new
        if moved < tolerance:
            break
    names = [f"{a}\t{x}" for a in annotators for x in ANSWERS] + [f"\tband {i}" for i in range(bands)]
    return Consensus(names, same, different, prior, rounds)


def code_answers(answers: DataFrame, scores: DataFrame | None, stage: Stage) -> tuple[DataFrame, list[str], int]:
    """(item, codes, n_annotators) with the list of annotators and the number of bands.

    ``scores`` has (item, band); items without answer are left out.
    """
    count = answers.select("annotator").distinct().count()
    if count > MAX_ANNOTATORS:
        raise ValueError(f"{count} annotators; the model holds at most {MAX_ANNOTATORS}")
    annotators = sorted(r[0] for r in answers.select("annotator").distinct().collect())
    spark = answers.sparkSession
    index = spark.createDataFrame(list(enumerate(annotators)), "i int, annotator string")
    position = F.array_position(F.array(*map(F.lit, ANSWERS)), F.col("answer")).cast("int") - 1
    coded = answers.join(F.broadcast(index), "annotator").select("item", (F.col("i") * len(ANSWERS) + position).alias("code"))
    if scores is not None:
        base = len(annotators) * len(ANSWERS)
        banded = scores.filter("band >= 0").select("item", (F.lit(base) + F.col("band")).cast("int").alias("code"))
        coded = coded.unionByName(banded)
    grouped = coded.groupBy("item").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    answered = F.size(F.filter("codes", lambda c: c < len(annotators) * len(ANSWERS)))
    out = stage.write(grouped.select("item", "codes", answered.alias("n_annotators")).filter("n_annotators > 0"))
    return out, annotators, BANDS if scores is not None else 0


def item_posteriors(coded: DataFrame, model: Consensus) -> DataFrame:
    """(item, n_annotators, p_same) under the fitted model."""
    llr, prior = model.llr, model.prior

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, starts = _flat(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(_posterior(llr, prior, codes, starts))], names=["item", "n_annotators", "p_same"])

    return coded.select("item", "codes", "n_annotators").mapInArrow(run, "item string, n_annotators int, p_same double")


def fit_pairs(pairs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Consensus, list[str]]:
    """Coded items of all labelled pairs, the fitted model and the annotators, for the review tables."""
    stage = Stage(pairs.sparkSession, "annotators")
    answers = stage.write(latest_answers(labels))
    scores = pairs.filter("name IS NOT NULL").groupBy(F.col("name").alias("item")).agg(score_band(F.max("tiered_score")).alias("band"))
    coded, annotators, bands = code_answers(answers, scores.join(answers.select("item").distinct(), "item", "left_semi"), stage)
    return coded, fit_consensus(coded, annotators, bands=bands), annotators


def pair_consensus(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(pair_name, consensus, p_same, n_annotators) of pairs that need double review and have answers of three or more.

    ``consensus`` is Same or Different; an even posterior goes to Different.
    review_status, final_label and adjudications play no part.  Pairs without
    answers, and empty tables, give no rows.
    """
    coded, model, _ = fit_pairs(pairs, labels)
    wanted = pairs.filter("needs_double_review = 1 AND name IS NOT NULL").select(F.col("name").alias("item")).distinct()
    posterior = item_posteriors(coded.filter("n_annotators >= 3"), model).join(wanted, "item", "left_semi")
    return posterior.select(F.col("item").alias("pair_name"), F.when(F.col("p_same") > 0.5, "Same").otherwise("Different").alias("consensus"), "p_same", "n_annotators")


def annotator_reliability(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per annotator: P(says Same | same), P(says Different | different), P(Unsure) and the information of an answer in bits."""
    coded, model, annotators = fit_pairs(pairs, labels)
    rate = 1 / (1 + math.exp(-model.prior))
    rows = []
    for i, a in enumerate(annotators):
        s, d = model.same[3 * i : 3 * i + 3], model.different[3 * i : 3 * i + 3]
        mix = rate * s + (1 - rate) * d
        bits = float((rate * s * np.log2(s / mix) + (1 - rate) * d * np.log2(d / mix)).sum())
        rows.append((a, float(s[0]), float(d[1]), float(mix[2]), bits))
    return pairs.sparkSession.createDataFrame(rows, "reviewer string, says_same double, says_different double, unsure double, bits double")


def agreement(answers: DataFrame) -> DataFrame:
    """Krippendorff's alpha (nominal) over items with two or more answers: one row, from the answers alone.

    Null when nothing can be compared or all answers are equal.
    """
    counts = answers.groupBy("item", "answer").agg(F.count(F.lit(1)).alias("n"))
    items = counts.groupBy("item").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq"), *(F.sum(F.when(F.col("answer") == a, F.col("n")).otherwise(0)).alias(a) for a in ANSWERS))
    paired = items.filter("m >= 2")
    total = paired.agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum("m").alias("n_answers"),
        F.sum((F.col("m") * F.col("m") - F.col("sq")) / (F.col("m") - 1)).alias("off"),
        *(F.sum(a).alias(a) for a in ANSWERS),
    )
    n = F.col("n_answers")
    by_chance = n * n - sum((F.col(a) * F.col(a) for a in ANSWERS[1:]), F.col(ANSWERS[0]) * F.col(ANSWERS[0]))
    alpha = 1 - F.try_divide(F.col("off") * (n - 1), by_chance)
    return total.select("n_items", F.coalesce(n, F.lit(0)).alias("n_answers"), F.round(alpha, 6).alias("alpha"))
