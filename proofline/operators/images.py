"""Image features and perceptual signatures over decoded pixels, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FEATURES = ("brightness", "contrast", "sharpness", "entropy", "saturation", "aspect_ratio")
_SCHEMA = "path string, width int, height int, pixel_count long, mode_group string, " + ", ".join(f"{f} double" for f in FEATURES) + ", signature string"


def _pixels(row) -> np.ndarray:
    """Rows of red, green, blue in [0, 1]."""
    raw = np.frombuffer(row.data, dtype=np.uint8).reshape(row.height, row.width, row.channels)
    bgr = np.repeat(raw, 3, axis=2) if row.channels == 1 else raw[:, :, :3]
    return bgr[:, :, ::-1] / 255.0


def _resized(grey: np.ndarray, size: int) -> np.ndarray:
    """Block means on a square grid; every cell covers at least one pixel."""
    h, w = grey.shape
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = grey.cumsum(0).cumsum(1)
    edge = lambda n: (np.arange(size) * n // size, np.maximum(np.arange(size) * n // size + 1, (np.arange(size) + 1) * n // size))
    (a, b), (c, d) = edge(h), edge(w)
    area = (b - a)[:, None] * (d - c)[None, :]
    return (total[b][:, d] - total[a][:, d] - total[b][:, c] + total[a][:, c]) / area


def signature(grey: np.ndarray) -> str:
    """64 bits of the low frequencies of a 32 x 32 cosine transform against their median, as hex, first bit first."""
    n = 32
    k = np.arange(n)
    basis = np.cos(np.pi / n * (k[None, :] + 0.5) * k[:, None])
    low = (basis @ _resized(grey, n) @ basis.T)[:8, :8].ravel()
    bits = low > np.median(low[1:])
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def _measure(row) -> tuple:
    rgb = _pixels(row)
    grey = rgb @ np.array([0.2126, 0.7152, 0.0722])
    gy, gx = np.gradient(grey) if min(grey.shape) > 1 else (np.zeros_like(grey), np.zeros_like(grey))
    counts = np.histogram(grey, bins=256, range=(0, 1))[0]
    p = counts[counts > 0] / counts.sum()
    top, bottom = rgb.max(2), rgb.min(2)
    saturation = np.divide(top - bottom, top, out=np.zeros_like(top), where=top > 0).mean()
    group = "GREY" if row.channels == 1 else "COLOUR" if row.channels == 3 else "ALPHA"
    return row.path, row.width, row.height, row.width * row.height, group, float(grey.mean()), float(grey.std()), float(np.hypot(gx, gy).var()), abs(float(-(p * np.log2(p)).sum())), float(saturation), row.width / row.height, signature(grey)


def features(decoded: DataFrame) -> DataFrame:
    """Features of the usable rows of ``sources.files.images``: pixels are decoded by Spark's image source, batches are NumPy."""
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "width", "height", "pixel_count", "mode_group", *FEATURES, "signature"]
        for pdf in batches:
            yield pd.DataFrame([_measure(r) for r in pdf.itertuples()], columns=names)

    return decoded.where("failure_code IS NULL").select("path", "width", "height", "channels", "data").mapInPandas(run, _SCHEMA)
