"""Packed blocks of vectors, and the exact best of a block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "dim int, ids binary, data binary"
BLOCK_ARROW = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])


def usable(column: str = "embedding") -> Column:
    """Neither null nor holding null or non-finite components."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & ~bad


def of_rows(batch: pa.RecordBatch, ids: int, vectors: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and float64 vectors of a batch, by dimension."""
    column = batch.column(vectors)
    lengths = np.diff(np.array(column.offsets))
    flat, offsets = np.array(column.values, np.float64), np.array(column.offsets)
    all_ids = np.array(batch.column(ids), np.int64)
    found = {}
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        found[d] = all_ids[at], flat[(offsets[at][:, None] + np.arange(d)[None, :])].reshape(len(at), d)
    return found


def to_block(ids: np.ndarray, data: np.ndarray) -> tuple[int, bytes, bytes]:
    return data.shape[1], np.ascontiguousarray(ids, np.int64).tobytes(), np.ascontiguousarray(data, np.float64).tobytes()


def from_block(dim: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(data, np.float64).reshape(len(own), dim)


def held(batches: Iterator[pa.RecordBatch], key: Callable, limit: int) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
    """Gather (key, ids, vectors) pieces that key(batch) yields into runs of about ``limit`` rows for each key."""
    parts: dict[object, list] = {}
    size: dict[object, int] = {}
    for batch in batches:
        for k, ids, data in key(batch):
            parts.setdefault(k, []).append((ids, data))
            size[k] = size.get(k, 0) + len(ids)
            if size[k] >= limit:
                own = parts.pop(k)
                size.pop(k)
                yield k, np.concatenate([x for x, _ in own]), np.concatenate([x for _, x in own])
    for k, own in parts.items():
        yield k, np.concatenate([x for x, _ in own]), np.concatenate([x for _, x in own])


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, best first."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query's rows; a first cut is made before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
