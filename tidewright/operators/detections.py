"""Detections against annotated boxes: matching inside pictures, precision over the ranking, tracks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.numbers import ratio
from tidewright.operators import metrics
from tidewright.operators.matching import greedy_match, iou_matrix

HITS = "picture string, class int, threshold double, score double, ordinal int, hit int"


def hits(pictures: DataFrame, thresholds: tuple[float, ...], most: int = 100) -> DataFrame:
    """One row per detection and threshold: whether it claims a true box of its class.

    ``pictures`` has picture, truth and found: arrays of structs of class and
    box (x0, y0, x1, y1), found with a score. The ``most`` best detections of a
    picture count; ties keep their order.
    """

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                best = sorted(enumerate(row.found), key=lambda f: (-f[1]["score"], f[0]))[:most]
                for c in sorted({f["class"] for _, f in best}):
                    own = [(i, f) for i, f in best if f["class"] == c]
                    boxes = np.array([[f["box"][k] for k in ("x0", "y0", "x1", "y1")] for _, f in own], float)
                    true = np.array([[t["box"][k] for k in ("x0", "y0", "x1", "y1")] for t in row.truth if t["class"] == c], float).reshape(-1, 4)
                    scores = np.array([f["score"] for _, f in own], float)
                    for threshold in thresholds:
                        claimed = greedy_match(true, boxes, scores, threshold)
                        out += [(row.picture, c, threshold, float(s), i, int(j >= 0)) for (i, _), s, j in zip(own, scores, claimed)]
            yield pd.DataFrame(out, columns=["picture", "class", "threshold", "score", "ordinal", "hit"])

    return pictures.select("picture", "truth", "found").mapInPandas(match, HITS)


#: The ten thresholds of overlap from 0.5 to 0.95.
TEN = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
BACKGROUND = "background"


def objects(pictures: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(picture, truth, predicted, duplicate): every true and every found box once, matched regardless of class.

    The best detection first takes the free true box of most overlap. What
    stays free is truth against background, and what takes none is background
    against a class; it is a duplicate if its best true box was taken by another.
    Pictures without boxes have no rows.
    """

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                truth, found = list(row.truth if row.truth is not None else []), list(row.found if row.found is not None else [])
                corners = lambda rows: np.array([[r["box"][k] for k in ("x0", "y0", "x1", "y1")] for r in rows], float).reshape(-1, 4)
                true, boxes = corners(truth), corners(found)
                claimed = greedy_match(true, boxes, np.array([f["score"] for f in found], float), threshold)
                near = iou_matrix(boxes, true).max(axis=1, initial=0.0) >= threshold
                out += [(row.picture, str(truth[j]["class"]) if j >= 0 else BACKGROUND, str(f["class"]), bool(j < 0 and n)) for f, j, n in zip(found, claimed, near)]
                out += [(row.picture, str(t["class"]), BACKGROUND, False) for i, t in enumerate(truth) if i not in set(claimed)]
            yield pd.DataFrame(out, columns=["picture", "truth", "predicted", "duplicate"])

    return pictures.select("picture", "truth", "found").mapInPandas(match, "picture string, truth string, predicted string, duplicate boolean")


def summary(matched: DataFrame) -> DataFrame:
    """One row over ``objects``: true boxes, those detected and of the right class, false positives, duplicates, and the rates."""
    is_true, is_found = F.col("truth") != BACKGROUND, F.col("predicted") != BACKGROUND
    counts = matched.agg(
        F.count_if(is_true).alias("presented"), F.count_if(is_true & is_found).alias("detected"), F.count_if(F.col("truth") == F.col("predicted")).alias("right_class"),
        F.count_if(~is_true & ~F.col("duplicate")).alias("false_positives"), F.count_if("duplicate").alias("duplicates"), F.count_if(is_found).alias("found"),
    )
    return counts.withColumn("detection_rate", ratio(F.col("detected"), F.col("presented"))).withColumn("duplicate_rate", ratio(F.col("duplicates"), F.col("found")))


def average_precision(pictures: DataFrame, thresholds: tuple[float, ...] = TEN) -> DataFrame:
    """(class, threshold, truths, ap): 101-level average precision; a class without true boxes has none."""
    truths = pictures.select(F.explode("truth.class").alias("class")).groupBy("class").agg(F.count("*").alias("truths"))
    rows = hits(pictures, thresholds).withColumn("id", F.concat_ws("/", "picture", F.col("ordinal").cast("string")))
    ranked = metrics.ranked(rows, ["class", "threshold"], "score", "id", F.col("hit") == 1).join(truths, "class")
    # recall counts the boxes that were never found
    ranked = ranked.withColumn("positives", F.col("truths"))
    scored = metrics.average_precision_101(ranked.where("tp > 0"), ["class", "threshold"])
    grid = truths.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return grid.join(scored, ["class", "threshold"], "left").na.fill(0.0, ["ap"]).select("class", "threshold", "truths", "ap")


def track_quality(tracks: DataFrame, fish: list[str], order: str, track: str) -> DataFrame:
    """Per fish: frames, distinct tracks, switches between consecutive frames, frames without a track."""
    from pyspark.sql import Window

    w = Window.partitionBy(*fish).orderBy(order)
    before = F.last(track, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = tracks.withColumn("__before", before)
    return rows.groupBy(*fish).agg(
        F.count("*").alias("frames"), F.countDistinct(track).alias("tracks"), F.count_if(F.col(track) != F.col("__before")).alias("switches"), F.count_if(F.col(track).isNull()).alias("missed")
    )
