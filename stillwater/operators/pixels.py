"""Measures of images: read with Spark's own image source, one small function per image.

Rows of the image source have image.height, width, nChannels and data (BGR bytes).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUALITY = "luma_mean double, luma_stddev double, detail double, entropy double, symmetry double, phash long"


def images(spark, path: str) -> DataFrame:
    """origin, height, width, channels, data of readable images."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path)
    return rows.select(F.col("image.origin").alias("origin"), *[F.col(f"image.{a}").alias(b) for a, b in (("height", "height"), ("width", "width"), ("nChannels", "channels"), ("data", "data"))])


def rgb(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    px = np.frombuffer(data, np.uint8).reshape(height, width, channels)[..., :3]
    return px[..., ::-1] if channels >= 3 else np.repeat(px[..., :1], 3, 2)


def sampled(px: np.ndarray, most: int = 65_536) -> np.ndarray:
    """Pixels at an even stride."""
    flat = px.reshape(-1, 3)
    return flat[:: max(1, -(-len(flat) // most))]


def luma(px: np.ndarray) -> np.ndarray:
    return px.astype(np.float64) @ np.array([0.2126, 0.7152, 0.0722]) / 255


def cells(y: np.ndarray, n: int) -> np.ndarray:
    """n x n means of areas."""
    rows = np.array_split(np.arange(y.shape[0]), n) if y.shape[0] >= n else [np.array([i * y.shape[0] // n]) for i in range(n)]
    cols = np.array_split(np.arange(y.shape[1]), n) if y.shape[1] >= n else [np.array([i * y.shape[1] // n]) for i in range(n)]
    return np.array([[y[np.ix_(r, c)].mean() for c in cols] for r in rows])


def phash(y: np.ndarray) -> int:
    """64 bits: which low cosine coefficients of a 32 x 32 picture are above their median."""
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / 64)
    low = (basis @ cells(y, 32) @ basis.T)[:8, :8].ravel()
    bits = low > np.median(low)
    return int(np.packbits(bits).view(">i8")[0])


def measure(px: np.ndarray) -> tuple:
    y = luma(px)
    steps = [np.abs(np.diff(y, axis=a)).mean() for a in (0, 1) if y.shape[a] > 1]
    p = np.bincount(np.minimum((y.ravel() * 64).astype(int), 63), minlength=64) / y.size
    p = p[p > 0]
    return float(y.mean()), float(y.std()), float(np.mean(steps) if steps else 0.0), float(-(p * np.log2(p)).sum()), float(1 - np.abs(y - y[:, ::-1]).mean()), phash(y)


def quality(rows: DataFrame) -> DataFrame:
    """origin and QUALITY's columns of each image."""

    def run(it):
        for pdf in it:
            got = [measure(rgb(*r)) for r in zip(pdf["height"], pdf["width"], pdf["channels"], pdf["data"], strict=True)]
            yield pd.DataFrame([(o, *g) for o, g in zip(pdf["origin"], got, strict=True)], columns=["origin", *[c.split()[0] for c in QUALITY.split(", ")]])

    return rows.mapInPandas(run, "origin string, " + QUALITY)


def color_bins(rows: DataFrame) -> DataFrame:
    """origin, bin, weight, r, g, b: pixels in 16 x 16 x 16 bins, weighted by saturation and middle brightness, with each bin's mean colour."""

    def run(it):
        for pdf in it:
            out = []
            for o, *image in zip(pdf["origin"], pdf["height"], pdf["width"], pdf["channels"], pdf["data"], strict=True):
                px = sampled(rgb(*image)).astype(np.int64)
                top, low = px.max(1), px.min(1)
                w = (0.25 + (top - low) / np.maximum(top, 1)) * (1 - np.abs(luma(px) - 0.5))
                b = (px[:, 0] >> 4) * 256 + (px[:, 1] >> 4) * 16 + (px[:, 2] >> 4)
                total = np.bincount(b, w, 4096)
                for k in np.flatnonzero(total):
                    out.append((o, int(k), float(total[k] / w.sum()), *[float(np.average(px[b == k, c], weights=w[b == k])) for c in range(3)]))
            yield pd.DataFrame(out, columns=["origin", "bin", "weight", "r", "g", "b"])

    return rows.mapInPandas(run, "origin string, bin int, weight double, r double, g double, b double")


def dominant(bins: DataFrame, n: int = 6, apart: float = 42.0) -> DataFrame:
    """origin and up to n colours, heaviest first, each at least `apart` from those before; an image has 4,096 bins at most."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "bin"], ascending=[False, True])
        taken: list[tuple] = []
        for r in pdf.itertuples():
            if len(taken) < n and all(np.hypot(np.hypot(r.r - t[0], r.g - t[1]), r.b - t[2]) >= apart for t in taken):
                taken.append((r.r, r.g, r.b, r.weight))
        return pd.DataFrame([(pdf["origin"].iloc[0], k, "#%02X%02X%02X" % tuple(int(x + 0.5) for x in t[:3]), t[3]) for k, t in enumerate(taken)], columns=["origin", "rank", "hex", "weight"])

    return bins.groupBy("origin").applyInPandas(run, "origin string, rank int, hex string, weight double")
