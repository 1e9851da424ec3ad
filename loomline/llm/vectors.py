"""Shared parts of the vector operators: classes of equal vectors and spherical k-means."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import tidy

SAMPLE = 16_384  # vectors that centroids are fitted on, those with the smallest hashes


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs, names, sizes = [], [], []
        for x in batch.column(1):
            v = None
            if x.is_valid and x.values.null_count == 0 and len(x.values):
                v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(v).all() or not v.any():
                    v = None
            blobs.append(None if v is None else v.tobytes())
            names.append(None if v is None else hashlib.blake2b(blobs[-1], digest_size=16).digest())
            sizes.append(0 if v is None else len(v))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(names, pa.binary()), pa.array(blobs, pa.binary())], ["vec_id", "size", "name", "vector"])


def valid(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, size, name, vector): vectors as bytes of doubles; null, zero and non-finite ones have none. name: equal for equal vectors."""
    source = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    return source.mapInArrow(tidy(_valid), "vec_id long, size int, name binary, vector binary")


def matrix(column, size: int) -> np.ndarray:
    """Unit vectors of a column of bytes of doubles."""
    m = np.frombuffer(b"".join(column), np.float64).reshape(-1, size)
    scale = np.abs(m).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    m = m / scale
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def spherical_kmeans(points: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Unit centroids; empty cells get the point that fits its own worst."""
    k = min(k, len(points))
    centres = points[np.random.default_rng(seed).choice(len(points), k, replace=False)]
    for _ in range(rounds):
        dots = points @ centres.T
        cell = dots.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, points)
        norms = np.linalg.norm(sums, axis=1)
        empty = norms < 1e-12
        if empty.any():
            worst = np.argsort(dots.max(axis=1))[: int(empty.sum())]
            sums[empty], norms[empty] = points[worst], 1
        centres = sums / norms[:, None]
    return centres


def fit_cells(vectors: DataFrame, count: int, per_cell: int, most: int = 2048) -> dict[int, np.ndarray]:
    """Centroids for every vector length that a bounded sample of (size, name, vector) shows."""
    rows = vectors.orderBy(F.xxhash64("name"), "name").limit(SAMPLE).select("size", "vector").toArrow()
    out = {}
    sizes = rows.column("size").to_numpy()
    for size in np.unique(sizes):
        picked = rows.filter(pa.array(sizes == size)).column("vector").to_pylist()
        k = int(np.clip(count * len(picked) / max(1, len(sizes)) / per_cell, 1, most))
        out[int(size)] = spherical_kmeans(matrix(picked, int(size)), k)
    return out
