"""Spectral clusters of the points of a map.

A map's points are bounded by its grid, so its Laplacian is one small matrix: maps are rows, and each task decomposes the
maps of its Arrow batches. k-means starts from points far from each other, so labels are the same on every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Width of the similarity, how many widths it reaches, and the most clusters that a gap may tell.
SIGMA, REACH, MOST = 3.0, 5.0, 10
ROUNDS = 100


def laplacian(points: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """1 - D^-1/2 W D^-1/2 for Gaussian similarities W within REACH widths; a point without neighbours has a row of its own 1."""
    d2 = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    near = np.where(d2 <= (REACH * sigma) ** 2, np.exp(-d2 / (2 * sigma * sigma)), 0.0)
    np.fill_diagonal(near, 0.0)
    degree = near.sum(axis=1)
    scale = np.where(degree > 1e-8, 1 / np.sqrt(np.maximum(degree, 1e-8)), 0.0)
    return np.eye(len(points)) - near * scale[:, None] * scale[None, :]


def gap_size(values: np.ndarray, most: int = MOST) -> int:
    """How many clusters the widest gap among the smallest eigenvalues tells, two at least; gaps equal to nine places: the first."""
    gaps = np.diff(values[: most + 1]).round(9)
    return max(2, int(gaps.argmax()) + 1) if len(gaps) else 2


def k_means(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Labels by Lloyd's rounds from the first row and then always the row farthest from those taken."""
    taken = [0]
    for _ in range(k - 1):
        away = ((rows[:, None] - rows[taken][None]) ** 2).sum(axis=2).min(axis=1).round(9)
        taken.append(int(away.argmax()))
    middle = rows[taken]
    labels = np.full(len(rows), -1)
    for _ in range(rounds):
        new = ((rows[:, None] - middle[None]) ** 2).sum(axis=2).round(9).argmin(axis=1)
        if (new == labels).all():
            break
        labels = new
        middle = np.stack([rows[labels == j].mean(axis=0) if (labels == j).any() else middle[j] for j in range(k)])
    return labels


def spectral_labels(points: np.ndarray, sigma: float = SIGMA, clusters: int | None = None) -> np.ndarray:
    """A label for each point, -1 where a cluster has one point only; under three points all are -1."""
    n = len(points)
    if n < 3:
        return np.full(n, -1)
    values, vectors = np.linalg.eigh(laplacian(points, sigma))
    k = min(clusters or gap_size(values, min(MOST, n)), n)
    rows = vectors[:, :k]
    rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-10)
    labels = k_means(rows, k)
    sizes = np.bincount(labels, minlength=k)
    return np.where(sizes[labels] >= 2, labels, -1)


def spectral_clusters(maps: DataFrame, w: int, sigma: float = SIGMA, clusters: int | None = None) -> DataFrame:
    """map_id, r, c, cluster of maps (map_id, points: set cells in order); a cluster is named by its first cell plus one, single points have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for map_id, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cells = np.array(cells or [], np.int64)
                labels = spectral_labels(np.stack([cells // w, cells % w], axis=1).astype(float), sigma, clusters)
                first = np.array([cells[labels == x][0] + 1 if x >= 0 else 0 for x in labels], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([map_id] * len(cells), pa.int64()), pa.array(cells // w), pa.array(cells % w), pa.array(first, pa.int64(), mask=first == 0)], ["map_id", "r", "c", "cluster"])

    return maps.select("map_id", "points").mapInArrow(run, "map_id long, r long, c long, cluster long")
