"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are put into buckets of similar length, longest first. A query's k-th
best score among the longest vectors bounds its result from below. Against a
bucket that bound, over the query's length and the bucket's greatest, is a
cosine that a partner must reach: above 1 the bucket is skipped; from COORDINATE
up only vectors are taken whose component along the query's main coordinate
lies in the range that such a cosine allows, found in sorted components, if that
leaves one in NARROW; else those long enough. What is left is verified by products.

A query's reach is the least length of a partner that its bound allows. Queries
of similar reach make a block, and buckets of similar length a shell, of SHELLS
at most; a block is sent to those shells only that reach as far, and dealt there
over slots of about CELL buckets. So lengths prune before anything is sent.

Blocks of similar reach also make a group, of GROUP bytes, and a bucket is sent
once to each group that reaches it. Shell, slot and group are a cell: one task
holds its queries, and its buckets pass one at a time, longest first, each
raising the bounds. Nothing is joined, so no pair of a block and a bucket is
ever a row, and the driver sees no block.

Defined results: vectors that are null or hold null or non-finite components,
and rows with null id, take no part; rows with the query's vec_id are not its
partners; vectors of another dimension are not either; vectors without
components take part, with products of 0; equal scores go to the
smaller vec_id, repeated candidate rows count each; an empty table gives no
rows. Products are exact up to 2^53, else in wrapping 64-bit numbers. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftline.llm.common import materialise, prepare, table
from liftline.llm.vectors import BLOCK, BLOCK_ARROW, best, held, of_rows, ranked, usable

TOP, SCALE, EVERY = 5, 256, 50
#: Vectors in a bucket and in the head that gives the first bounds; queries in a block; least cosine for which coordinates are used.
BUCKET, HEAD, QUERIES, COORDINATE = 2048, 4096, 256, 0.4
#: Buckets that one task packs, and of a cell; bytes of queries that a cell holds; a coordinate is used if it leaves one vector in so many.
PACKED, CELL, GROUP, NARROW = 8, 32, 12 << 20, 16
#: Shells of buckets at most, whose greatest lengths go into the plan.
SHELLS = 64
_SLACK = 1e-9


def _products(data: np.ndarray, query: np.ndarray) -> np.ndarray:
    if data.size and np.abs(data).max() * max(1.0, np.abs(query).max()) * len(query) >= 2**53:
        return data.astype(np.int64) @ query.astype(np.int64)
    return (data @ query).astype(np.int64)


def _range(q: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest component along a coordinate of unit vectors at such a cosine to one with component q."""
    spread = np.sqrt((1 - cosine * cosine) * np.maximum(0.0, 1 - q * q)) + _SLACK
    # beyond the query's own direction every component of a vector at the very pole is allowed too
    return np.where(q <= -cosine, -1.0, q * cosine - spread) - _SLACK, np.where(q >= cosine, 1.0, q * cosine + spread) + _SLACK


def _first(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each query's k best, best first, and their ranks from 0."""
    order = np.lexsort((ids, -scores, query))
    new = np.flatnonzero(np.r_[True, np.diff(query[order]) != 0])
    rank = np.arange(len(order)) - np.repeat(new, np.diff(np.r_[new, len(order)]))
    return order[rank < k], rank[rank < k]


class _Bucket:
    """Vectors longest first, with sorted components made when first asked for."""

    def __init__(self, ids: np.ndarray, data: np.ndarray):
        norms = np.sqrt((data * data).sum(axis=1))
        order = np.argsort(-norms, kind="stable")
        self.ids, self.data, self.norms = ids[order], data[order], norms[order]
        self.single = self.data.astype(np.float32)
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def along(self, axis: int) -> tuple[np.ndarray, np.ndarray]:
        if axis not in self.sorted:
            unit = self.data[:, axis] / np.maximum(self.norms, 1e-300)
            order = np.argsort(unit, kind="stable")
            self.sorted[axis] = unit[order], order
        return self.sorted[axis]

    def near(self, query: np.ndarray, norm: float, bound: float) -> np.ndarray | None:
        """Places of the vectors that may reach the bound; None for all."""
        if not np.isfinite(bound) or not len(self.norms):
            return None
        longest = self.norms[0]
        if norm * longest == 0 or bound <= 0:
            return None if bound <= 0 else np.empty(0, np.int64)
        cosine = bound / (norm * longest) - _SLACK
        if cosine > 1:
            return np.empty(0, np.int64)
        if cosine < COORDINATE:
            return np.arange(np.searchsorted(-self.norms, -(bound / norm) * (1 - _SLACK), side="right"))
        axis = int(np.abs(query).argmax())
        low, high = _range(query[axis] / norm, cosine)
        values, order = self.along(axis)
        return order[np.searchsorted(values, low) : np.searchsorted(values, high, side="right")]

    def top(self, query_id: int, query: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        norm = float(np.sqrt(query @ query))
        at = self.near(query, norm, bound)
        ids, data = (self.ids, self.data) if at is None else (self.ids[at], self.data[at])
        scores = _products(data, query)
        fine = (ids != query_id) & (scores >= bound)
        ids, scores = ids[fine], scores[fine]
        chosen = best(scores, ids, k)
        return ids[chosen], scores[chosen]


class _Best:
    """Queries of one dimension with the k best that they have met, and the bounds that those raise."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, bounds: np.ndarray, k: int):
        self.ids, self.data, self.bounds, self.k = ids, data, np.array(bounds, np.float64), k
        self.norms, self.single = np.sqrt((data * data).sum(axis=1)), data.astype(np.float32)
        self.count = np.zeros(len(ids), np.int64)
        self.found, self.scores = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64)

    def meet(self, bucket: _Bucket) -> None:
        if not len(self.ids) or not len(bucket.ids):
            return
        largest = float(self.norms.max() * bucket.norms[0]) * (1 + _SLACK)
        for start in range(0, len(self.ids), QUERIES):
            at = np.arange(start, min(start + QUERIES, len(self.ids)))
            query, place, scores = self._reached(bucket, at, largest) if largest < 2**53 else self._one_by_one(bucket, at)
            ids = bucket.ids[place]
            fine = self.ids[query] != ids
            if fine.any():
                self._keep(query[fine], ids[fine], scores[fine].astype(np.int64))

    def _one_by_one(self, bucket: _Bucket, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As _reached, of products beyond 2^53."""
        query, place, scores = [], [], []
        for n in at.tolist():
            near = bucket.near(self.data[n], float(self.norms[n]), float(self.bounds[n]))
            near = np.arange(len(bucket.ids)) if near is None else near
            score = _products(bucket.data[near], self.data[n])
            fine = score >= self.bounds[n]
            query.append(np.full(int(fine.sum()), n))
            place.append(near[fine])
            scores.append(score[fine])
        return np.concatenate(query), np.concatenate(place), np.concatenate(scores)

    def _reached(self, bucket: _Bucket, at: np.ndarray, largest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, place in the bucket and score of what reaches the bounds; of a query without a bound, its k best and their ties."""
        bounds, longest = self.bounds[at], bucket.norms[0]
        need = np.where(bounds > 0, bounds / np.maximum(self.norms[at], 1e-300), -np.inf)
        alive = need <= longest * (1 + _SLACK)
        at, need = at[alive], need[alive]
        few, query, place = self._narrow(bucket, at, need / max(longest, 1e-300) - _SLACK)
        scores = (bucket.data[place] * self.data[query]).sum(axis=1)
        fine = scores >= self.bounds[query]
        found = [(query[fine], place[fine], scores[fine])]
        at, need = at[~few], need[~few]
        if len(at):
            rows = int(np.searchsorted(-bucket.norms, -need.min() * (1 - _SLACK), side="right"))
            exact = largest < 2**24  # then every sum of products of integers is exact in single precision
            scores = bucket.single[:rows] @ self.single[at].T if exact else bucket.data[:rows] @ self.data[at].T
            least = self.bounds[at]
            open_ = np.flatnonzero(~np.isfinite(least))
            if len(open_) and rows > self.k:
                own = np.where(bucket.ids[:rows, None] == self.ids[at[open_]], -np.inf, scores[:, open_])
                least[open_] = np.partition(own, rows - self.k, axis=0)[rows - self.k]
            place, query = np.divmod(np.flatnonzero(scores >= least.astype(scores.dtype)), len(at))
            found.append((at[query], place, scores[place, query]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _narrow(self, bucket: _Bucket, at: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which queries a coordinate leaves few partners, and their (query, place) pairs."""
        few, query, place = np.zeros(len(at), bool), [at[:0]], [at[:0]]
        sharp = np.flatnonzero(cosine >= COORDINATE)
        if len(sharp):
            axes = np.abs(self.data[at[sharp]]).argmax(axis=1)
            low, high = _range(self.data[at[sharp], axes] / self.norms[at[sharp]], cosine[sharp])
            sided = (low > 0) | (high < 0)  # what holds the middle leaves too many to be worth sorting
            for axis in np.unique(axes[sided]).tolist():
                n = np.flatnonzero(sided & (axes == axis))
                values, order = bucket.along(axis)
                first, last = np.searchsorted(values, low[n]), np.searchsorted(values, high[n], side="right")
                good = (last - first) * NARROW <= len(values)
                n, first, many = n[good], first[good], (last - first)[good]
                few[sharp[n]] = True
                query.append(np.repeat(at[sharp[n]], many))
                place.append(order[np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)])
        return few, np.concatenate(query), np.concatenate(place)

    def _keep(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        own = np.unique(query)
        had = np.arange(self.k) < self.count[own, None]
        query = np.concatenate([np.repeat(own, self.count[own]), query])
        ids, scores = np.concatenate([self.found[own][had], ids]), np.concatenate([self.scores[own][had], scores])
        order, rank = _first(query, ids, scores, self.k)
        query = query[order]
        self.found[query, rank], self.scores[query, rank] = ids[order], scores[order]
        self.count[query] = rank + 1  # the last of a query counts
        full = own[self.count[own] == self.k]
        self.bounds[full] = np.maximum(self.bounds[full], self.scores[full, self.k - 1])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        had = np.arange(self.k) < self.count[:, None]
        return np.repeat(self.ids, self.count), self.found[had], self.scores[had]


def scaled(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for dim, (ids, data) in of_rows(batch, 0, 1).items():
        yield dim, ids, scaled(data)


def _batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns.values()], list(columns))


def _to_block(ids: np.ndarray, data: np.ndarray) -> tuple[int, bytes, bytes]:
    """Whole numbers, of 16 bits where they fit."""
    small = not data.size or np.abs(data).max() < 2**15
    return data.shape[1], np.ascontiguousarray(ids, np.int64).tobytes(), np.ascontiguousarray(data, np.int16 if small else np.float64).tobytes()


def _from_block(dim: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(data, np.int16 if len(data) == 2 * dim * len(own) else np.float64).reshape(len(own), dim).astype(np.float64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, ids, data in held(batches, _rows, BUCKET):
        for k in range(0, len(ids), BUCKET):
            own = data[k : k + BUCKET]
            block = zip(_to_block(ids[k : k + BUCKET], own), BLOCK_ARROW, strict=True)
            yield _batch({f.name: ([x], f.type) for x, f in block} | {"longest": ([float(np.sqrt((own * own).sum(axis=1).max()))], pa.float64())})


def _bounds(heads: dict[int, _Bucket], k: int):  # noqa: ANN202
    """Of each query its k-th best score among the longest vectors, and the length that a partner needs to reach it."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, data in _rows(batch):
                found = _Best(ids, data, np.full(len(ids), -np.inf), k)
                if dim in heads:
                    found.meet(heads[dim])
                reach = np.where(found.bounds > 0, found.bounds / np.maximum(found.norms, 1e-300), -np.inf)
                yield _batch({"vec_id": (ids, pa.int64()), "scaled": (list(data), pa.list_(pa.float64())), "bound": (found.bounds, pa.float64()), "reach": (reach, pa.float64())})

    return apply


def _pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries in order of their reach -> blocks with the least reach in each, and the partition."""
    part = TaskContext.get().partitionId()

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for dim, (ids, data) in of_rows(batch, 0, 1).items():  # bound and reach travel as two more components
            at = np.diff(np.array(batch.column(1).offsets)) == dim
            yield dim, ids, np.c_[data, np.array(batch.column(2))[at], np.array(batch.column(3))[at]]

    for dim, ids, data in held(batches, rows, QUERIES):
        for at in range(0, len(ids), QUERIES):
            i, d = ids[at : at + QUERIES], data[at : at + QUERIES]
            _, q_ids, q_data = _to_block(i, d[:, :dim])
            yield _batch({"q_dim": ([dim], pa.int32()), "q_ids": ([q_ids], pa.binary()), "q_data": ([q_data], pa.binary()), "bounds": ([d[:, dim].tobytes()], pa.binary()), "reach": ([d[:, dim + 1].min()], pa.float64()), "part": ([part], pa.int32())})


def _verify(k: int):  # noqa: ANN202
    """A cell's queries, then its buckets one at a time -> the k best in the cell of each query."""

    def ended(met: dict[int, _Best]) -> Iterator[pa.RecordBatch]:
        for best_of in met.values():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best_of.rows()], ["query_id", "vec_id", "score"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, met = None, {}, {}
        for batch in batches:
            for cell, dim, ids, data, bounds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cell != now:
                    yield from ended(met)
                    now, waiting, met = cell, {}, {}
                if bounds is not None:
                    waiting.setdefault(dim, []).append((*_from_block(dim, ids, data), np.frombuffer(bounds, np.float64)))
                    continue
                if dim in waiting:
                    met[dim] = _Best(*(np.concatenate(x) for x in zip(*waiting.pop(dim), strict=True)), k)
                if dim in met:
                    met[dim].meet(_Bucket(*_from_block(dim, ids, data)))
        yield from ended(met)

    return apply


def _dealt(buckets: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Buckets with their shell and slot and each group that reaches them, blocks with their group and each (q_shell, q_slot) that they reach; both with the number of the cell."""
    n, edges = buckets.agg(F.count("*"), F.percentile_approx("longest", [(i + 1) / SHELLS for i in range(SHELLS)], 4 * SHELLS)).first()
    edges = sorted(set(edges or ()))
    shells = len(edges) + 1  # the last for what is longer than the last edge, if anything is
    slots = max(1, -(-n // (shells * CELL)))
    packed = blocks.groupBy("part").agg(F.sum(F.length("q_ids") * (F.col("q_dim") + 16)), F.min("reach")).collect()  # one row for each partition of blocks
    parts, groups = max((p for p, _, _ in packed), default=0) + 1, max(1, -(-sum(size for _, size, _ in packed) // GROUP))
    least: dict[int, float] = {}
    for p, _, reach in packed:
        least[p * groups // parts] = min(reach * (1 - _SLACK), least.get(p * groups // parts, np.inf))
    blocks = blocks.withColumn("q_group", F.expr(f"int(part * {groups}L div {parts})"))
    shell = sum((F.when(F.col("longest") > e, 1).otherwise(0) for e in edges), F.lit(0))
    sent = F.array_compact(F.array(*(F.when(F.col("longest") >= r, F.lit(g)) for g, r in least.items()))).cast("array<int>")
    left = buckets.withColumn("shell", shell).withColumn("slot", F.pmod(F.xxhash64("ids"), F.lit(slots)).cast("int")).withColumn("group", F.explode(sent))
    reached = F.array_compact(F.array(*(F.when(F.col("reach") * (1 - _SLACK) <= e, F.lit(i)) for i, e in enumerate(edges)), F.lit(len(edges))))
    right = blocks.withColumn("q_shell", F.explode(reached)).withColumn("q_slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    cell = lambda group, shell, slot: ((F.col(group) * shells + F.col(shell)) * slots + F.col(slot)).cast("int")
    left, right = left.withColumn("cell", cell("group", "shell", "slot")), right.withColumn("cell", cell("q_group", "q_shell", "q_slot"))
    left.cells = groups * shells * slots
    return left, right


def search(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score of both tables' (vec_id, embedding) rows."""
    prepare(vectors.sparkSession)
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.floor(x.cast("double") * SCALE).cast("double") * F.floor(x.cast("double") * SCALE).cast("double"))
    fine = materialise(vectors.where(F.col("vec_id").isNotNull() & usable()).select("vec_id", "embedding", (-norm).alias("shortness")))
    asked = queries.where(F.col("vec_id").isNotNull() & usable()).select("vec_id", "embedding")
    n = fine.count()
    sliced = fine.repartitionByRange(max(1, -(-n // (PACKED * BUCKET))), "shortness", "vec_id").sortWithinPartitions("shortness", "vec_id")
    buckets = materialise(sliced.select("vec_id", "embedding").mapInArrow(_pack, BLOCK + ", longest double"))
    longest = fine.orderBy("shortness", "vec_id").limit(HEAD).select("vec_id", "embedding").toArrow().combine_chunks()
    heads: dict[int, _Bucket] = {}
    for batch in longest.to_batches():
        for dim, ids, data in _rows(batch):
            heads[dim] = _Bucket(ids, data)
    asked = materialise(asked.mapInArrow(_bounds(heads, k), "vec_id bigint, scaled array<double>, bound double, reach double"))
    placed = asked.withColumn("place", F.monotonically_increasing_id())  # rows of one reach and id can be parted too
    blocks = placed.repartitionByRange(max(1, -(-asked.count() // QUERIES)), "reach", "vec_id", "place").sortWithinPartitions("reach", "vec_id")
    blocks = materialise(blocks.mapInArrow(_pack_queries, "q_dim int, q_ids binary, q_data binary, bounds binary, reach double, part int"))
    left, right = _dealt(buckets, blocks)
    held_first = right.select("cell", F.lit(0).alias("kind"), F.col("reach").alias("nth"), F.col("q_dim").alias("dim"), F.col("q_ids").alias("ids"), F.col("q_data").alias("data"), "bounds")
    passing = left.select("cell", F.lit(1).alias("kind"), (-F.col("longest")).alias("nth"), "dim", "ids", "data", F.lit(None).cast("binary").alias("bounds"))
    met = held_first.union(passing).repartitionById(left.cells, "cell").sortWithinPartitions("cell", "kind", "nth").select("cell", "dim", "ids", "data", "bounds")
    return ranked(met.mapInArrow(_verify(k), "query_id bigint, vec_id bigint, score bigint"), k)


def op5_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


REGISTERED = {"op5_exact_search": op5_exact_search}

ORACLES = {
    "op5_exact_search": f"""
WITH v AS (
    SELECT vec_id, [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
WHERE rank <= {TOP}"""
}
