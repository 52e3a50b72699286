"""One settled label per finding from reviewers who disagree (problem 1).

Confidence-aware truth discovery. The label of a finding is the one of least
weighted distance to all its observations; a reviewer's weight is the reciprocal
of an upper confidence bound on the reviewer's error variance, that is the
chi-squared quantile chi2(ALPHA / 2, n) over the summed distances of the
reviewer's n labels to the settled ones. The bound is wide for the long tail of
reviewers with few labels. Both steps alternate until no label changes.
SMOOTHING adds an error share to every reviewer, for without it the weight of
one reviewer who always agrees grows until it settles everything alone.

Labels are absent, minor, moderate and severe; a distance of 1 separates
absence from presence, steps of severity are half as far, and a defect that is
present without a known severity is far from absence only. An adjudicated
observation settles its finding, from the first round on; other findings use
all reviewers' last observations, drafts only where the reviewer left no review.

After the first grouping a finding has at most one label per reviewer, so no
finding can be hot; a reviewer may be, and is met by partial aggregation and a
join that adaptive execution splits. Reviewers' weights are joined, never
collected.

Defined results: rows without finding keys count for no finding, rows without a
reviewer as the reviewer ''; repeated rows count once; of rows recorded at one
time the one with the greater ``observation_id`` holds; ties between labels go
to the less severe; a finding with no usable label is not settled (null). A
reviewer who left no label but adjudications has a row without labels: the mean
error is null, and the weight 0, to which the bound goes with the labels' number.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidewright.functions.text import squeezed, value_or_null
from tidewright.session import cut

FINDING = ("fish_instance_id", "finding_id")
LABELS = ("absent", "minor", "moderate", "severe")
#: DISTANCE[truth][label]; the last label is a present defect of unknown severity.
DISTANCE = ((0.0, 1.0, 1.0, 1.0, 1.0), (1.0, 0.0, 0.5, 1.0, 0.0), (1.0, 0.5, 0.0, 0.5, 0.0), (1.0, 1.0, 0.5, 0.0, 0.0))
PRESENT = 4
ALPHA = 0.05
SMOOTHING = 0.1
#: Rounds end when no label changes; findings that still change after this many are told apart in settled_by.
MAX_ROUNDS = 50


def label(presence: Column, severity: Column) -> Column:
    """The number of the label, or null where nothing is known."""
    says, how = value_or_null(presence), squeezed(severity)
    grade = F.coalesce(*(F.when(how == name, i) for i, name in enumerate(LABELS) if i), F.lit(PRESENT))
    return F.when(says.isin("no", "n", "false"), 0).when(says.isin("yes", "y", "true"), grade)


def votes(observations: DataFrame) -> DataFrame:
    """(finding, reviewer_id, label, settles): each reviewer's last word on each finding."""
    status = squeezed(F.col("review_status"))
    rank = F.when(status == "adjudicated", 2).when(status == "pending", 0).otherwise(1)
    word = F.struct(rank.alias("rank"), "recorded_at", "observation_id", label(F.col("presence"), F.col("severity")).alias("label"))
    return (
        observations.where("fish_instance_id is not null and finding_id is not null")
        .select(*FINDING, F.coalesce("reviewer_id", F.lit("")).alias("reviewer_id"), word.alias("word"))
        .groupBy(*FINDING, "reviewer_id")
        .agg(F.max("word").alias("word"))
        .select(*FINDING, "reviewer_id", "word.label", (F.col("word.rank") == 2).alias("settles"), F.col("word.recorded_at").alias("at"))
    )


def _chi2(p: float, k: float) -> float:
    """The p-quantile of chi-squared with k degrees of freedom; for many degrees by Wilson and Hilferty's cube."""
    if k > 5000:
        z = -1.959963984540054 if p == 0.025 else _normal(p)
        return k * (1 - 2 / (9 * k) + z * math.sqrt(2 / (9 * k))) ** 3
    low, high = 0.0, k + 20 * math.sqrt(2 * k) + 20
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_below(mid, k) < p else (low, mid)
    return high


def _chi2_below(x: float, k: float) -> float:
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-13:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0


def _normal(p: float) -> float:
    low, high = -10.0, 10.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (1 + math.erf(mid / math.sqrt(2))) / 2 < p else (low, mid)
    return low


@F.pandas_udf(DoubleType())
def _low_quantile(n: pd.Series) -> pd.Series:
    quantile = {k: _chi2(ALPHA / 2, k) for k in n.unique()}
    return n.map(quantile)


def _distances(to: Column) -> list[Column]:
    """Distance from each possible truth to a label column."""
    return [F.element_at(F.array(*map(F.lit, row)), to + 1) for row in DISTANCE]


def _settle(weighted: DataFrame) -> DataFrame:
    """(finding, truth, support, agreement): the label of least weighted distance."""
    sums = [F.sum(F.col("weight") * d).alias(f"d{i}") for i, d in enumerate(_distances(F.col("label")))]
    scored = weighted.groupBy(*FINDING).agg(*sums, F.sum("weight").alias("total"), F.count("*").alias("n_labels"))
    best = F.array_min(F.array(*(F.struct(F.col(f"d{i}").alias("d"), F.lit(i).alias("truth")) for i in range(len(LABELS)))))
    return scored.withColumn("b", best).select(*FINDING, F.col("b.truth").alias("truth"), (1 - F.col("b.d") / F.col("total")).alias("agreement"), "n_labels")


def _weights(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """(reviewer_id, n, errors, weight) from the distances to the settled labels."""
    all_ = F.array(*(F.array(*map(F.lit, row)) for row in DISTANCE))
    error = F.element_at(F.element_at(all_, F.col("truth") + 1), F.col("label") + 1)
    sums = labels.join(truth.select(*FINDING, "truth"), list(FINDING)).groupBy("reviewer_id").agg(F.count("*").cast("double").alias("n"), F.sum(error).alias("errors"))
    return sums.withColumn("weight", _low_quantile("n") / (F.col("errors") + SMOOTHING * F.col("n")))


def discover(observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, reviewers).

    findings: fish_instance_id, finding_id, presence, severity, agreement (weighted share of the labels' nearness), n_labels, settled_by
    (adjudication, consensus, or last round where MAX_ROUNDS ended before the label stood still).
    reviewers: reviewer_id, n_labels, mean_error, weight.
    """
    all_votes = votes(observations).repartition(*FINDING)
    voted = cut(all_votes)
    labels = voted.where("label is not null")
    free = labels.where("not settles")
    fixed = labels.where("settles").groupBy(*FINDING).agg(F.max_by("label", F.struct("at", "reviewer_id")).alias("fixed"))
    fixed = cut(fixed)
    weights, truth, moving = None, None, None
    for _ in range(MAX_ROUNDS):
        weighted = free.withColumn("weight", F.lit(1.0)) if weights is None else free.join(weights.select("reviewer_id", "weight"), "reviewer_id")
        now = cut(_settle(weighted))
        known = now.join(fixed, list(FINDING), "left").select(*FINDING, F.coalesce("fixed", "truth").alias("truth"))
        weights = cut(_weights(free, known))
        if truth is not None:
            moving = now.join(truth.select(*FINDING, F.col("truth").alias("was")), list(FINDING)).where("truth <> was").select(*FINDING, F.lit(True).alias("moves"))
            if moving.isEmpty():
                moving = None
                break
        truth = now
    settled = truth.join(fixed, list(FINDING), "full").withColumn("final", F.coalesce("fixed", "truth"))
    settled = settled.withColumn("moves", F.lit(False)) if moving is None else settled.join(moving, list(FINDING), "left")
    everything = voted.select(*FINDING).distinct().join(settled, list(FINDING), "left")
    names = F.array(*map(F.lit, LABELS), F.lit("unknown"))
    findings = everything.select(
        *FINDING,
        F.when(F.col("final") == 0, "no").when(F.col("final") > 0, "yes").alias("presence"),
        F.when(F.col("final") > 0, F.element_at(names, F.col("final") + 1)).alias("severity"),
        F.col("agreement"),
        F.coalesce("n_labels", F.lit(0)).alias("n_labels"),
        F.when(F.col("fixed").isNotNull(), "adjudication").when(F.col("moves"), "last round").when(F.col("truth").isNotNull(), "consensus").alias("settled_by"),
    )
    reviewers = voted.select("reviewer_id").distinct().join(weights, "reviewer_id", "left")
    reviewers = reviewers.select("reviewer_id", F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n_labels"), (F.col("errors") / F.col("n")).alias("mean_error"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
    return findings, reviewers


def found(observations: DataFrame) -> DataFrame:
    findings, _ = discover(observations)
    return findings.where(F.col("severity").isin(*LABELS[1:])).select(*FINDING, "severity")
