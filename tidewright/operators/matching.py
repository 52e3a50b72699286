"""Assignments inside one picture: scored candidates, suppression, greedy and optimal matching.

A picture's boxes are a bounded group (an array column), so candidates are made
inside the row or the group and never across pictures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.geometry import area, centre, contains, intersection


def owner_score(part: Column, parent: Column) -> Column:
    """0.7 share inside + 0.2 centre inside + 0.1 nearness of the centres, in the parent's diagonals."""
    x, y = centre(part)
    px, py = centre(parent)
    inside = F.coalesce(F.try_divide(intersection(part, parent), area(part)), F.lit(0.0))
    diagonal = F.sqrt(F.pow(parent["x1"] - parent["x0"], F.lit(2)) + F.pow(parent["y1"] - parent["y0"], F.lit(2)))
    far = F.coalesce(F.try_divide(F.sqrt(F.pow(x - px, F.lit(2)) + F.pow(y - py, F.lit(2))), diagonal), F.lit(1.0))
    return 0.7 * inside + 0.2 * contains(parent, x, y).cast("double") + 0.1 * (1 - F.least(far, F.lit(1.0)))


def owners(df: DataFrame, parts: str, parents: str, least: float, margin: float) -> DataFrame:
    """One row per part: its best parent, score, margin to the second, and ASSIGNED, AMBIGUOUS or UNASSIGNED.

    ``parts`` and ``parents`` are array columns of structs with id and box.
    Ties go to the smaller parent id.
    """
    kept = [c for c in df.columns if c not in (parts, parents)]
    rows = df.select(*kept, parents, F.explode(parts).alias("p"))
    ranked = F.array_sort(F.transform(parents, lambda q: F.struct((-owner_score(F.col("p.box"), q["box"])).alias("minus"), q["id"].alias("parent"))))
    best = rows.select(*kept, F.col("p.id").alias("part"), F.slice(ranked, 1, 2).alias("r"))
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    scored = best.select(*kept, "part", first["parent"].alias("parent"), (-first["minus"]).alias("score"), F.coalesce(second["minus"] - first["minus"], -first["minus"]).alias("margin"))
    status = F.when(F.coalesce("score", F.lit(0.0)) < least, "UNASSIGNED").when(F.col("margin") < margin, "AMBIGUOUS").otherwise("ASSIGNED")
    return scored.withColumn("status", status)


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) == 0 or len(b) == 0:
        return np.zeros((len(a), len(b)))
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    both = np.clip(w, 0, None) * np.clip(h, 0, None)
    size = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = size(a)[:, None] + size(b)[None, :] - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


def suppress(boxes: np.ndarray, scores: np.ndarray, threshold: float) -> np.ndarray:
    """Greedy suppression: the kept rows, best score first, ties in row order."""
    order, kept = np.argsort(-scores, kind="stable"), []
    overlap = iou_matrix(boxes, boxes)
    for i in order:
        if all(overlap[i, j] <= threshold for j in kept):
            kept.append(int(i))
    return np.array(kept, int)


def greedy_match(truth: np.ndarray, found: np.ndarray, scores: np.ndarray, threshold: float) -> list[int]:
    """For each found box, best score first, the free true box of most overlap, or -1."""
    overlap, free, out = iou_matrix(found, truth), set(range(len(truth))), [-1] * len(found)
    for i in np.argsort(-scores, kind="stable"):
        best = max(free, key=lambda j: (overlap[i, j], -j), default=None)
        if best is not None and overlap[i, best] >= threshold:
            out[int(i)] = best
            free.discard(best)
    return out


def optimal_match(score: np.ndarray, threshold: float) -> list[int]:
    """For each row the column of the matching with the greatest total score, or -1 below the threshold.

    Shortest augmenting paths with potentials; each row may also take a private
    column of the threshold's score, so a pair below it is never worth taking.
    """
    n, m = score.shape
    if n == 0:
        return []
    cost = np.hstack([-score, np.where(np.eye(n, dtype=bool), -threshold, np.inf)])
    columns = m + n
    u, v, row_of = np.zeros(n + 1), np.zeros(columns + 1), np.full(columns + 1, -1)
    for i in range(n):
        row_of[columns] = i
        at, least, way, used = columns, np.full(columns, np.inf), np.full(columns, -1), np.zeros(columns + 1, bool)
        while row_of[at] >= 0:
            used[at] = True
            r = row_of[at]
            reduced = cost[r] - u[r] - v[:columns]
            better = ~used[:columns] & (reduced < least)
            least[better], way[better] = reduced[better], at
            open_ = np.flatnonzero(~used[:columns])
            nearest = int(open_[least[open_].argmin()])
            delta = least[nearest]
            u[row_of[used]] += delta
            v[used] -= delta
            least[open_] -= delta
            at = nearest
        while at != columns:
            row_of[at] = row_of[way[at]]
            at = way[at]
        row_of[columns] = -1
    out = [-1] * n
    for j in range(m):
        if row_of[j] >= 0:
            out[int(row_of[j])] = j
    return out


def in_pictures(df: DataFrame, kernel, schema: str) -> DataFrame:
    """Apply a kernel (one row of array columns to output tuples) to every picture, in Arrow batches."""
    names = [f.strip().split()[0] for f in schema.split(",")]

    def batches(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            yield pd.DataFrame([out for row in pdf.itertuples(index=False) for out in kernel(row)], columns=names)

    return df.mapInPandas(batches, schema)
