"""Pictures: inventory, content hashes and similarity hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = "*.{jpg,jpeg,png,bmp,gif,tif,tiff,webp}"  # what can't be decoded is reported as such


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256, width, height, channels, valid) of every picture below a folder; unreadable ones are rows too (Spark skips files of no bytes)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", EXTENSIONS).load(path)
    read = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", EXTENSIONS).option("dropInvalid", False).load(path)
    size = read.select(F.regexp_replace("image.origin", "^file:/*", "/").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"))
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).join(size, "path", "left").withColumn("valid", F.coalesce(F.col("width") > 0, F.lit(False)))


def grey(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Luma of Spark's BGR bytes."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float)
    return pixels[..., 0] if channels == 1 else pixels[..., 2] * 0.299 + pixels[..., 1] * 0.587 + pixels[..., 0] * 0.114


def resized(picture: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area resampling: each target pixel is the mean of what it covers."""
    def weights(n: int, m: int) -> np.ndarray:
        edges = np.linspace(0, n, m + 1)
        cells = np.arange(n)
        return np.clip(np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells), 0, None) * (m / n)

    return weights(picture.shape[0], height) @ picture @ weights(picture.shape[1], width).T


def average_hash(picture: np.ndarray) -> int:
    small = resized(picture, 8, 8)
    return _bits(small > small.mean())


def difference_hash(picture: np.ndarray) -> int:
    small = resized(picture, 8, 9)
    return _bits(small[:, 1:] > small[:, :-1])


def perceptual_hash(picture: np.ndarray) -> int:
    """Signs of the 8 x 8 lowest cosine frequencies against their median, the mean left out."""
    small = resized(picture, 32, 32)
    k, n = np.arange(8)[:, None], np.arange(32)
    basis = np.cos(np.pi * k * (2 * n + 1) / 64)
    low = basis @ small @ basis.T
    return _bits(low > np.median(low.ravel()[1:]))


def _bits(b: np.ndarray) -> int:
    return int("".join("1" if v else "0" for v in b.ravel()), 2)


def sharpness(picture: np.ndarray) -> float:
    """Variance of the Laplacian over the inner pixels."""
    if min(picture.shape) < 3:
        return 0.0
    inner = -4 * picture[1:-1, 1:-1] + picture[:-2, 1:-1] + picture[2:, 1:-1] + picture[1:-1, :-2] + picture[1:-1, 2:]
    return float(inner.var())


def hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, average, difference, perceptual, brightness, sharpness) of every readable picture; hashes as 16 hex digits."""
    read = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", EXTENSIONS).option("dropInvalid", True).load(path)
    rows = read.select(F.regexp_replace("image.origin", "^file:/*", "/").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                g = grey(r.data, r.width, r.height, r.channels)
                out.append((r.path, *(f"{h(g):016x}" for h in (average_hash, difference_hash, perceptual_hash)), float(g.mean()), sharpness(g)))
            yield pd.DataFrame(out, columns=["path", "average", "difference", "perceptual", "brightness", "sharpness"])

    return rows.mapInPandas(compute, "path string, average string, difference string, perceptual string, brightness double, sharpness double")
