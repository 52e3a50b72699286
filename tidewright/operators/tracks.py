"""Following boxes from frame to frame by overlap."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ["stream", "frame", "ordinal", "x0", "y0", "x1", "y1"]
FOLLOWED = "stream string, frame bigint, ordinal int, track bigint"


def _overlap(a: tuple, b: tuple) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    size = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return w * h / (size(a) + size(b) - w * h)


class Follower:
    """Tracks of one stream: their last boxes, and for how many frames they were not seen."""

    def __init__(self, least: float, patience: int) -> None:
        self.least, self.patience = least, patience
        self.last: dict[int, tuple] = {}
        self.unseen: dict[int, int] = {}
        self.made = 0

    def frame(self, boxes: list[tuple]) -> list[int]:
        """The track of each box: in order, the free track of most overlap (the oldest on ties), or a new one."""
        free, out = sorted(self.last), []
        for box in boxes:
            best = max(free, key=lambda t: (_overlap(box, self.last[t]), -t), default=None)
            if best is not None and _overlap(box, self.last[best]) >= self.least:
                free.remove(best)
            else:
                self.made += 1
                best = self.made
            self.last[best], self.unseen[best] = box, 0
            out.append(best)
        for t in free:
            self.unseen[t] += 1
            if self.unseen[t] > self.patience:
                del self.last[t], self.unseen[t]
        return out


def follow(boxes: DataFrame, least: float = 0.3, patience: int = 30) -> DataFrame:
    """(stream, frame, ordinal, track) of every box of ``boxes`` (stream, frame, ordinal, x0, y0, x1, y1).

    A box takes the free track of the frame before with most overlap, at least
    ``least``; a track not seen in more than ``patience`` frames with boxes of
    its stream ends. Numbers start at 1 in every stream. Rows are streamed in
    order; a task holds the live tracks of one stream, never its rows, except
    for the boxes of one frame. Boxes without stream, frame or edges are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, follower = None, [], Follower(least, patience)

        def close(into: list) -> None:
            for (ordinal, *_), track in zip(held, follower.frame([r[1:] for r in held])):
                into.append((*now, ordinal, track))

        for batch in batches:
            out: list = []
            for stream, frame, ordinal, *box in batch.itertuples(index=False):
                if now != (stream, frame):
                    if held:
                        close(out)
                    if now is None or now[0] != stream:
                        follower = Follower(least, patience)
                    now, held = (stream, frame), []
                held.append((ordinal, *box))
            yield pd.DataFrame(out, columns=["stream", "frame", "ordinal", "track"])
        out = []
        if held:
            close(out)
        yield pd.DataFrame(out, columns=["stream", "frame", "ordinal", "track"])

    whole = boxes.select(F.col("stream").cast("string"), F.col("frame").cast("bigint"), F.col("ordinal").cast("int"), *(F.col(c).cast("double") for c in COLUMNS[3:])).na.drop()
    return whole.repartition("stream").sortWithinPartitions("stream", "frame", "ordinal").mapInPandas(run, FOLLOWED)
