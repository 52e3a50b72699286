"""Runs of near-identical consecutive events (problem 4).

A fish's frames, ordered by number, are cut into runs by optimal segmentation:
the segmentation of least within-run dissimilarity plus a penalty per run. A
run's dissimilarity is the least sum of distances from its frames' grades to
one grade, the run's own. Dynamic programming finds the optimum; a start is
pruned once its cost reaches the best total, for from there it can never win
again (adding frames never lowers a run's dissimilarity). Frames without a
grade and steps of more than ``max_gap`` frame numbers end runs and so cut the
problem into independent sections.

With unit distances and a penalty under 1/2 a foreign frame always costs more
than the two cuts that avoid it, so the optimum consists of runs of one grade;
that is EXACT below. A larger penalty lets runs step over flickers.

A fish may hold any share of all rows: frames are first reduced to the row
received last (a partial aggregation), then dealt to tasks by fish and stretch
of STRETCH frame numbers, at most STRETCH rows each, and streamed in order.
Runs of one grade that end at the border of a stretch are joined to their
continuation afterwards; only those few rows are windowed per fish. Where runs
may hold foreign frames, a section that crosses a border is not solved by its
parts: their blocks of equal frames, which is all the program needs, are brought
together and the section is solved whole, so borders never change a result. A
task then holds the blocks of one unbroken section, never a fish's frames.

Defined results: rows without session, fish or frame number belong to no run;
of rows of one frame received at the same time the better-known grade in the
order of GRADES holds, a graded one before an ungraded one; rows without a time
of receipt come before all others; an empty table has no runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.text import GRADES, grade_name
from tidewright.session import cut

STRETCH = 1 << 16


@dataclass(frozen=True)
class Segmentation:
    """Penalty per run, distances between grades, and the largest step inside a run."""

    penalty: float
    distance: tuple[tuple[float, ...], ...]
    max_gap: int = 30

    @property
    def plain(self) -> bool:
        """Whether a foreign frame always costs more than two cuts, so that the optimum is the runs of one grade."""
        return 2 * self.penalty < min(v for row in self.distance for v in row if v > 0)


_UNIT = tuple(tuple(float(a != b) for b in range(4)) for a in range(4))
_STEPS = tuple(tuple(abs(a - b) / 3 for b in range(4)) for a in range(4))
EXACT = Segmentation(0.25, _UNIT)
NEAR = Segmentation(0.7, _STEPS)


def last_received(frames: DataFrame) -> DataFrame:
    """(session_id, fish_id, frame, code, at): one row per frame; code -1 is ungraded, at is micros or null."""
    grade = grade_name(F.col("provisional_grade"))
    code = F.coalesce(*(F.when(grade == g, len(GRADES) - i) for i, g in enumerate(GRADES)), F.lit(0))
    # time of receipt and grade in one long: 3 low bits for the grade
    order = F.coalesce(F.unix_micros(F.col("received_at").cast("timestamp")), F.lit(-(1 << 58))) * 8 + code
    return (
        frames.where("session_id is not null and fish_id is not null and frame is not null")
        .select("session_id", "fish_id", "frame", order.alias("o"), F.unix_micros(F.col("observed_at").cast("timestamp")).alias("at"))
        .groupBy("session_id", "fish_id", "frame")
        .agg(F.max("o").alias("o"), F.min("at").alias("at"))
        .select("session_id", "fish_id", "frame", F.when(F.pmod("o", F.lit(8)) > 0, len(GRADES) - F.pmod("o", F.lit(8))).otherwise(-1).cast("int").alias("code"), "at")
    )


def segment(codes: list[int], weights: list[int], how: Segmentation) -> list[tuple[int, int]]:
    """(end, grade) of each run over blocks of equal frames: the optimal segmentation."""
    kinds, d = range(len(how.distance)), how.distance
    total = [0.0] * len(kinds)  # distance of all frames so far to each grade
    seen = [tuple(total)]
    best, back = [-how.penalty], [(0, 0)]
    starts = [0]
    for t, (code, weight) in enumerate(zip(codes, weights), 1):
        total = [total[k] + weight * d[code][k] for k in kinds]
        seen.append(tuple(total))
        least, choice, costs = float("inf"), (0, 0), []
        for s in starts:
            from_ = seen[s]
            inside, grade = min((total[k] - from_[k], k) for k in kinds)
            costs.append(best[s] + inside)
            if costs[-1] < least:
                least, choice = costs[-1], (s, grade)
        best.append(least + how.penalty)
        back.append(choice)
        starts = [s for s, c in zip(starts, costs) if c < best[-1]]
        starts.append(t)
    runs, t = [], len(codes)
    while t:
        s, grade = back[t]
        runs.append((t, grade))
        t = s
    return runs[::-1]


def _sections(batches: Iterator[pd.DataFrame], max_gap: int) -> Iterator[pd.DataFrame]:
    """Blocks of equal neighbouring frames, in whole sections; a section ends a yielded frame.

    Columns: session_id, fish_id, stretch, code, start, end, n, t0, t1, section, first, last
    (first and last: whether the block has its stretch's first or last frame).
    """
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        if len(batch) == 0:
            continue
        # rows of the last stretch stay until the next batch shows where it ends
        key = (batch["session_id"].to_numpy(), batch["fish_id"].to_numpy(), batch["stretch"].to_numpy())
        same = np.logical_and.reduce([k[:-1] == k[1:] for k in key])
        cuts = np.flatnonzero(~same)
        done = cuts[-1] + 1 if len(cuts) else 0
        if done:
            yield _blocks(batch.iloc[:done], max_gap)
        rest = batch.iloc[done:]
    if rest is not None and len(rest):
        yield _blocks(rest, max_gap)


def _blocks(rows: pd.DataFrame, max_gap: int) -> pd.DataFrame:
    session, fish, stretch = (rows[c].to_numpy() for c in ("session_id", "fish_id", "stretch"))
    frame, code, at = rows["frame"].to_numpy(), rows["code"].to_numpy(), rows["at"].to_numpy()
    n = len(rows)
    other = np.ones(n + 1, bool)  # another stretch begins before row i
    other[1:n] = (session[1:] != session[:-1]) | (fish[1:] != fish[:-1]) | (stretch[1:] != stretch[:-1])
    section = other[:n].copy()
    section[1:] |= (frame[1:] - frame[:-1] > max_gap) | (code[1:] < 0) | (code[:-1] < 0)
    starts = section.copy()
    starts[1:] |= code[1:] != code[:-1]
    at_row = np.flatnonzero(starts)
    ends = np.append(at_row[1:], n) - 1
    out = pd.DataFrame({
        "session_id": session[at_row], "fish_id": fish[at_row], "stretch": stretch[at_row], "code": code[at_row], "start": frame[at_row], "end": frame[ends],
        "n": ends - at_row + 1, "t0": at[at_row], "t1": at[ends], "section": np.cumsum(section)[at_row], "first": other[at_row], "last": other[ends + 1],
    })
    return out[out["code"].to_numpy() >= 0]


RUN_SCHEMA = (
    "session_id string, fish_id bigint, stretch bigint, code int, start_frame bigint, end_frame bigint, "
    "n_frames bigint, foreign bigint, t0 bigint, t1 bigint, opens boolean, closes boolean, section bigint, solved boolean"
)


def _cut_runs(how: Segmentation):
    def cut_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for blocks in _sections(batches, how.max_gap):
            section = blocks["section"].to_numpy()
            code, n = blocks["code"].to_numpy(), blocks["n"].to_numpy()
            begins = np.flatnonzero(np.r_[True, section[1:] != section[:-1]]) if len(section) else np.array([], int)
            bounds = np.append(begins, len(section))
            stretches = blocks["stretch"].to_numpy()
            opens = blocks["first"].to_numpy() & (blocks["start"].to_numpy() - stretches * STRETCH < how.max_gap)
            closes = blocks["last"].to_numpy() & ((stretches + 1) * STRETCH - blocks["end"].to_numpy() <= how.max_gap)
            first_block, last_block, grades, solved = [], [], [], []
            for a, b in zip(bounds[:-1], bounds[1:]):
                whole = how.plain or not (opens[a] or closes[b - 1])
                if not whole:  # the blocks themselves
                    found = [(k + 1, int(code[a + k])) for k in range(b - a)]
                elif b - a == 1:
                    found = [(1, int(code[a]))]
                else:
                    found = segment(code[a:b].tolist(), n[a:b].tolist(), how)
                at = a
                for end, grade in found:
                    first_block.append(at)
                    last_block.append(a + end - 1)
                    grades.append(grade)
                    solved.append(whole)
                    at = a + end
            i, j, grade = np.array(first_block, int), np.array(last_block, int), np.array(grades, int)
            reach = np.append(0, np.cumsum(n))
            own = np.array([np.append(0, np.cumsum(np.where(code == g, n, 0))) for g in range(len(GRADES))])
            total = reach[j + 1] - reach[i]
            stretch, start, end = stretches[i], blocks["start"].to_numpy()[i], blocks["end"].to_numpy()[j]
            yield pd.DataFrame({
                "session_id": blocks["session_id"].to_numpy()[i], "fish_id": blocks["fish_id"].to_numpy()[i], "stretch": stretch, "code": grade,
                "start_frame": start, "end_frame": end, "n_frames": total, "foreign": total - (own[grade, j + 1] - own[grade, i]),
                "t0": pd.array(blocks["t0"].to_numpy()[i]), "t1": pd.array(blocks["t1"].to_numpy()[j]),
                "opens": opens[i], "closes": closes[j], "section": section[i], "solved": np.array(solved, bool),
            })

    return cut_runs


def runs(frames: DataFrame, how: Segmentation = EXACT, min_frames: int = 2) -> DataFrame:
    """One row per run of at least ``min_frames`` frames: grade, first and last frame, number of frames,
    frames of another grade, and duration in seconds between the observations of its ends."""
    stretch = F.floor(F.col("frame") / STRETCH).alias("stretch")
    dealt = last_received(frames).select("session_id", "fish_id", stretch, "frame", "code", F.coalesce("at", F.lit(-(1 << 60))).alias("at"))
    ordered = dealt.repartition("session_id", "fish_id", "stretch").sortWithinPartitions("session_id", "fish_id", "stretch", "frame")
    parts = cut(ordered.mapInPandas(_cut_runs(how), RUN_SCHEMA))  # read twice below
    return (_joined if how.plain else _resolved)(parts, how).where(F.col("n_frames") >= min_frames).select(
        "session_id", "fish_id", F.element_at(F.array(*map(F.lit, GRADES)), F.col("code") + 1).alias("grade"), "start_frame", "end_frame", "n_frames", F.col("foreign").alias("foreign_frames"),
        F.when((F.col("t0") > -(1 << 60)) & (F.col("t1") > -(1 << 60)), (F.col("t1") - F.col("t0")) / 1e6).alias("duration_s"),
    )


def _resolved(parts: DataFrame, how: Segmentation) -> DataFrame:
    """Solved runs, and the runs of the sections that cross borders, each solved over all its blocks."""
    fish = Window.partitionBy("session_id", "fish_id").orderBy("start_frame")
    before = F.lag(F.struct("stretch", "section", "end_frame", "closes")).over(fish)
    inside = (before["stretch"] == F.col("stretch")) & (before["section"] == F.col("section"))
    across = F.col("opens") & before["closes"] & (before["stretch"] + 1 == F.col("stretch")) & (F.col("start_frame") - before["end_frame"] <= how.max_gap)
    chain = F.sum(F.when(inside | across, 0).otherwise(1)).over(fish.rowsBetween(Window.unboundedPreceding, 0))
    columns = ["session_id", "fish_id", "code", "start_frame", "end_frame", "n_frames", "foreign", "t0", "t1"]

    def solve(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("start_frame", ignore_index=True)
        code, n = blocks["code"].to_numpy(), blocks["n_frames"].to_numpy()
        rows, at = [], 0
        for end, grade in segment(code.tolist(), n.tolist(), how):
            i, j = at, end - 1
            foreign = int(n[i:end][code[i:end] != grade].sum())
            rows.append((blocks["session_id"][i], blocks["fish_id"][i], grade, blocks["start_frame"][i], blocks["end_frame"][j], int(n[i:end].sum()), foreign, blocks["t0"][i], blocks["t1"][j]))
            at = end
        return pd.DataFrame(rows, columns=columns)

    kinds = {field.split()[0]: field for field in RUN_SCHEMA.split(", ")}
    open_ = parts.where("not solved").withColumn("chain", chain).groupBy("session_id", "fish_id", "chain")
    return parts.where("solved").select(*columns).unionByName(open_.applyInPandas(solve, ", ".join(kinds[c] for c in columns)))


def _joined(parts: DataFrame, how: Segmentation) -> DataFrame:
    """Runs with their continuations in the next stretch; only border runs are windowed."""
    border = parts.where("opens or closes")
    fish = Window.partitionBy("session_id", "fish_id").orderBy("start_frame")
    before = F.lag(F.struct("stretch", "code", "end_frame", "closes")).over(fish)
    continues = F.col("opens") & before["closes"] & (before["stretch"] + 1 == F.col("stretch")) & (before["code"] == F.col("code")) & (F.col("start_frame") - before["end_frame"] <= how.max_gap)
    chain = F.sum(F.when(continues, 0).otherwise(1)).over(fish.rowsBetween(Window.unboundedPreceding, 0))
    joined = (
        border.withColumn("chain", chain)
        .groupBy("session_id", "fish_id", "chain")
        .agg(F.max("code").alias("code"), F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.sum("n_frames").alias("n_frames"), F.sum("foreign").alias("foreign"), F.min_by("t0", "start_frame").alias("t0"), F.max_by("t1", "end_frame").alias("t1"))
        .drop("chain")
    )
    return parts.where("not (opens or closes)").select(*joined.columns).unionByName(joined)


def found(frames: DataFrame) -> DataFrame:
    return runs(frames, EXACT, 2).select("session_id", "fish_id", "start_frame", "end_frame")
