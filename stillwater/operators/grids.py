"""Measures of small brightness grids (rows by rows, 0 to 1): brightness, detail, entropy, symmetry, tilt, cosine hash.

One pass over batches of grids of one side length; a grid of another length, or none, has no measures (nulls).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MEASURES = "luma_mean double, luma_stddev double, detail double, entropy double, symmetry double, tilt double, coherence double, hash string"
#: Fixed value: an edge is strong above this percentile.
STRONG = 80


def entropy(y: np.ndarray, bins: int) -> np.ndarray:
    at = np.minimum((y.reshape(len(y), -1) * bins).astype(int), bins - 1)
    p = np.stack([(at == k).mean(1) for k in range(bins)], 1)
    return np.maximum(0.0, -(p * np.log2(np.where(p > 0, p, 1))).sum(1))


def tilt(y: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Degrees in -45..45 by which the strong edges lean, and how much they agree: four times an edge's angle is one direction
    for what stands and what lies. Fewer than `least` strong edges lean nowhere."""
    gy, gx = np.gradient(y, axis=(1, 2))
    size = np.hypot(gx, gy)
    strong = size > np.percentile(size, STRONG, axis=(1, 2))[:, None, None]
    w = np.where(strong, size, 0.0)
    angle = 4 * (np.arctan2(gy, gx) + np.pi / 2)
    mass = np.maximum(w.sum((1, 2)), 1e-300)
    c, s = (w * np.cos(angle)).sum((1, 2)) / mass, (w * np.sin(angle)).sum((1, 2)) / mass
    lean = np.degrees(np.arctan2(s, c)) / 4
    enough = strong.sum((1, 2)) >= least
    return np.where(enough, (lean + 45) % 90 - 45, 0.0), np.where(enough, np.hypot(c, s), 0.0)


def cosine_hash(y: np.ndarray) -> list[str]:
    """A bit for each cosine coefficient: whether it is above their median."""
    n = y.shape[1]
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * n))
    low = (basis @ y @ basis.T).reshape(len(y), -1)
    bits = low > np.median(low, axis=1)[:, None]
    return ["".join("01"[b] for b in row) for row in bits.astype(int)]


def measure(grids: DataFrame, side: int = 8, bins: int = 16, least: int = 8) -> DataFrame:
    """id and MEASURES of each grid. grids: id, grid (array of side * side numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = part.column("grid").to_pylist()
            good = [k for k, r in enumerate(rows) if r is not None and len(r) == side * side and None not in r]
            columns: list[list] = [[None] * len(rows) for _ in range(8)]
            if good:
                y = np.array([rows[k] for k in good], np.float64).reshape(-1, side, side)
                detail = (np.abs(np.diff(y, axis=2)).mean((1, 2)) + np.abs(np.diff(y, axis=1)).mean((1, 2))) / 2
                found = [y.mean((1, 2)), y.std((1, 2)), detail, entropy(y, bins), 1 - np.abs(y - y[:, :, ::-1]).mean((1, 2)), *tilt(y, least), cosine_hash(y)]
                for column, values in zip(columns, found, strict=True):
                    for k, v in zip(good, values, strict=True):
                        column[k] = v
            arrays = [pa.array(c, pa.float64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.string())]
            yield pa.RecordBatch.from_arrays([part.column("id"), *arrays], ["id", *[m.split()[0] for m in MEASURES.split(", ")]])

    return grids.select("id", "grid").mapInArrow(run, f"id {grids.schema['id'].dataType.simpleString()}, {MEASURES}")
