"""Measurements of pictures and masks, in NumPy; `measure` applies them to pictures in Arrow batches.

A mask is a boolean array; measurements of an empty mask are 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue in degrees, saturation and value of colours from 0 to 1."""
    top, span = rgb.max(-1), np.ptp(rgb, axis=-1)
    safe = np.where(span > 0, span, 1)
    r, g, b = np.moveaxis(rgb, -1, 0)
    sector = np.select([top == r, top == g], [((g - b) / safe) % 6, (b - r) / safe + 2], (r - g) / safe + 4)
    return np.stack([np.where(span > 0, sector * 60, 0), np.divide(span, top, out=np.zeros_like(top), where=top > 0), top], -1)


def lab(rgb: np.ndarray) -> np.ndarray:
    """CIE L*a*b* (D65) of sRGB colours from 0 to 1."""
    # The sRGB primaries and the D65 white.
    to_xyz = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]])
    white = np.array([0.95047, 1.0, 1.08883])
    linear = np.where(rgb <= 0.04045, rgb / 12.92, ((rgb + 0.055) / 1.055) ** 2.4)
    t = linear @ to_xyz.T / white
    f = np.where(t > (6 / 29) ** 3, np.cbrt(t), t * (29 / 6) ** 2 / 3 + 4 / 29)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def hue_mean(hue: Column, weight: Column) -> Column:
    """Aggregate: the weighted circular mean of hues in degrees; null without weight."""
    y, x = F.sum(F.sin(F.radians(hue)) * weight), F.sum(F.cos(F.radians(hue)) * weight)
    return F.when((F.abs(x) + F.abs(y)) > 1e-12, F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)))


def cooccurrence(grey: np.ndarray, mask: np.ndarray, levels: int = 16, distance: int = 1) -> np.ndarray:
    """Shares of grey-level pairs at a distance to the right, down and along both diagonals, inside the mask, both ways."""
    g = np.minimum((grey * levels / 256).astype(int), levels - 1)
    counts = np.zeros(levels * levels)
    h, w = g.shape
    for dy, dx in ((0, distance), (distance, 0), (distance, distance), (distance, -distance)):
        ys, xs = slice(0, h - dy), slice(max(0, -dx), w - max(0, dx))
        yt, xt = slice(dy, h), slice(max(0, dx), w - max(0, -dx))
        both = mask[ys, xs] & mask[yt, xt]
        counts += np.bincount((g[ys, xs] * levels + g[yt, xt])[both], minlength=levels * levels)
    m = counts.reshape(levels, levels)
    m = m + m.T
    return m / m.sum() if m.sum() else m


def texture(m: np.ndarray) -> dict[str, float]:
    """Contrast, homogeneity, energy, entropy and correlation of a co-occurrence matrix."""
    i, j = np.indices(m.shape)
    mean_i, mean_j = (m * i).sum(), (m * j).sum()
    spread = np.sqrt((m * (i - mean_i) ** 2).sum() * (m * (j - mean_j) ** 2).sum())
    p = m[m > 0]
    return {
        "contrast": float((m * (i - j) ** 2).sum()), "homogeneity": float((m / (1 + (i - j) ** 2)).sum()), "energy": float(np.sqrt((m**2).sum())), "entropy": float(-(p * np.log2(p)).sum()),
        "correlation": float((m * (i - mean_i) * (j - mean_j)).sum() / spread) if spread > 0 else 0.0,
    }


def binary_patterns(grey: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Shares of the uniform local binary patterns: 0 to 8 neighbours at least as bright in one arc, and all others."""
    if min(grey.shape) < 3:
        return np.zeros(10)
    c = grey[1:-1, 1:-1]
    ring = [grey[1 + dy : grey.shape[0] - 1 + dy, 1 + dx : grey.shape[1] - 1 + dx] for dy, dx in ((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))]
    bits = np.stack([r >= c for r in ring])
    changes = (bits != np.roll(bits, 1, 0)).sum(0)
    code = np.where(changes <= 2, bits.sum(0), 9)[mask[1:-1, 1:-1]]
    return np.bincount(code, minlength=10) / max(1, code.size)


def components(mask: np.ndarray) -> np.ndarray:
    """Labels 1, 2, ... of the 8-connected parts, 0 outside: the smallest index spreads along runs until nothing changes."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 1
    while True:
        padded = np.pad(np.where(label > 0, label, big), 1, constant_values=big)
        low = np.min([padded[1 + dy : padded.shape[0] - 1 + dy, 1 + dx : padded.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
        new = np.where(mask, low, 0)
        # follow pointers: a label's own cell may by now have a smaller label
        flat = new.ravel()
        new = np.where(mask, flat[np.maximum(new, 1) - 1], 0)
        if (new == label).all():
            return np.unique(label, return_inverse=True)[1].reshape(mask.shape) + (0 if (label == 0).any() else 1)
        label = new


def perimeter(mask: np.ndarray) -> int:
    """Edges between pixels of the mask and others."""
    p = np.pad(mask, 1)
    return int((p[1:] != p[:-1]).sum() + (p[:, 1:] != p[:, :-1]).sum())


def hull(mask: np.ndarray) -> tuple[float, float]:
    """Area and perimeter of the convex hull of the pixels' corners."""
    y, x = np.nonzero(mask)
    if len(x) == 0:
        return 0.0, 0.0
    points = sorted({(int(a + i), int(b + j)) for a, b in zip(x, y) for i in (0, 1) for j in (0, 1)})

    def half(ps) -> list:
        out: list = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ring = np.array(half(points) + half(points[::-1]), float)
    after = np.roll(ring, -1, 0)
    return float(abs((ring[:, 0] * after[:, 1] - after[:, 0] * ring[:, 1]).sum()) / 2), float(np.hypot(*(after - ring).T).sum())


def axes(mask: np.ndarray) -> tuple[float, float, float]:
    """Standard deviations along the principal axes and the long one's angle in radians."""
    y, x = np.nonzero(mask)
    if len(x) < 2:
        return 0.0, 0.0, 0.0
    values, vectors = np.linalg.eigh(np.cov(np.stack([x, y]), bias=True))
    long = vectors[:, 1]
    return float(np.sqrt(max(values[1], 0))), float(np.sqrt(max(values[0], 0))), float(np.arctan2(long[1], long[0]) % np.pi)


def widths(mask: np.ndarray) -> np.ndarray:
    """Pixels of the mask in each row that has any."""
    n = mask.sum(1)
    return n[n > 0]


def mirror_overlap(mask: np.ndarray) -> float:
    """Overlap of the mask's box with its mirror image, as intersection over union."""
    y, x = np.nonzero(mask)
    if len(x) == 0:
        return 0.0
    m = mask[y.min() : y.max() + 1, x.min() : x.max() + 1]
    return float((m & m[:, ::-1]).sum() / (m | m[:, ::-1]).sum())


def decode_runs(text: str, height: int, width: int) -> np.ndarray:
    """A mask from a COCO compressed run text (column by column, 5 bits a character, differences to the run before last)."""
    counts: list[int] = []
    value, shift = 0, 0
    for c in text.encode():
        bits = c - 48
        value |= (bits & 31) << shift
        shift += 5
        if not bits & 32:
            if bits & 16:
                value -= 1 << shift
            counts.append(value + (counts[-2] if len(counts) > 2 else 0))
            value, shift = 0, 0
    if sum(counts) != height * width or min(counts, default=0) < 0:
        raise ValueError("the runs do not fill the picture")
    return np.repeat(np.arange(len(counts)) % 2 == 1, counts).reshape(width, height).T


def measure(pictures: DataFrame, kernel: Callable[[np.ndarray], dict[str, float]], names: tuple[str, ...]) -> DataFrame:
    """(path, names...) of Spark's image rows (path, width, height, channels, data); the kernel gets RGB from 0 to 1."""

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                pixels = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels) / 255
                rgb = np.repeat(pixels, 3, -1) if r.channels == 1 else pixels[..., 2::-1]
                values = kernel(rgb)
                out.append((r.path, *(float(values[n]) for n in names)))
            yield pd.DataFrame(out, columns=["path", *names])

    return pictures.mapInPandas(compute, "path string, " + ", ".join(f"`{n}` double" for n in names))
