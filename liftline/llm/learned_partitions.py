"""Approximate nearest neighbours by learned partitions.

On a bounded sample a neighbour graph is built and cut into balanced parts that
keep neighbours together. A small classifier (one hidden layer) learns, for a
vector, how its neighbours spread over the parts. Every row is indexed under
its most probable part; a query goes to its several most probable parts, as
many as the sample needs for RECALL, and is scored there against every row by
the inner product in double precision.

A part is dealt over as many pieces as its rows need, so neither a popular part
nor many equal vectors land in one task.

Vectors are partners of those of their own dimension. Each dimension of which
the sample holds enough has parts and a router of its own; any other is one
part, which all its queries are scored against.

Defined results: vectors that are null, zero or hold null or non-finite
components, and rows with null id, take no part; rows with the query's vec_id
are not its partners; ties go to the smaller vec_id; an empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftline.llm.common import materialise, prepare, table
from liftline.llm.vectors import best, from_block, held, of_rows, ranked, to_block, usable

TOP, EVERY = 20, 20
#: Rows that the index is fitted on, at most; parts; neighbours in the graph; hidden units; recall sought within the sample.
SAMPLE, PARTS, NEIGHBOURS, HIDDEN, RECALL = 6000, 16, 10, 128, 0.96
#: Rows of a dimension that the sample must hold for a router to be fitted.
FITTED = 128
#: Rows in a piece of a part; queries in a block.
PIECE, QUERIES = 3072, 128


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k nearest other rows."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        out[a : a + 1024] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] else out[a : a + 1024]
    return out


def balanced_parts(graph: np.ndarray, x: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A part for each node, of at most 1.1 times the even share: begun from random directions, then nodes move to where most of their neighbours are, strongest wishes first, while there is room."""
    n = len(graph)
    rng = np.random.default_rng(8)
    room = int(np.ceil(1.1 * n / parts))
    part = np.empty(n, np.int64)
    todo = [(np.arange(n), 0, parts)]
    while todo:  # halve along random directions
        at, low, high = todo.pop()
        if high - low == 1:
            part[at] = low
            continue
        middle = (low + high) // 2
        order = at[np.argsort(x[at] @ rng.standard_normal(x.shape[1]), kind="stable")]
        cut = len(at) * (middle - low) // (high - low)
        todo += [(order[:cut], low, middle), (order[cut:], middle, high)]
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(part, graph.shape[1])), 1)
        gain = votes.max(axis=1) - votes[np.arange(n), part]
        wish, used = votes.argmax(axis=1), np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable").tolist():
            if gain[i] <= 0:
                break
            if used[wish[i]] < room:
                used[part[i]] -= 1
                used[wish[i]] += 1
                part[i] = wish[i]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """Softmax over the parts from one hidden layer of rectified units."""

    def __init__(self, x: np.ndarray, spread: np.ndarray, hidden: int = HIDDEN, steps: int = 600):
        rng = np.random.default_rng(9)
        self.scale = 1 / max(1e-12, float(np.sqrt((x * x).mean())))
        w = [rng.standard_normal((x.shape[1], hidden)) * np.sqrt(2 / x.shape[1]), np.zeros(hidden), rng.standard_normal((hidden, spread.shape[1])) * np.sqrt(1 / hidden), np.zeros(spread.shape[1])]
        first, second = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        for t in range(1, steps + 1):  # Adam
            at = rng.integers(0, len(x), 512)
            inputs = x[at] * self.scale
            raw = inputs @ w[0] + w[1]
            h = np.maximum(raw, 0)
            p = self._softmax(h @ w[2] + w[3])
            d = (p - spread[at]) / len(at)
            back = (d @ w[2].T) * (raw > 0)
            for k, g in enumerate((inputs.T @ back, back.sum(axis=0), h.T @ d, d.sum(axis=0))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = w[k] - 0.003 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        self.w = w

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts by falling probability."""
        z = np.maximum(x * self.scale @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]
        return np.argsort(-z, axis=1, kind="stable")


def fit(x: np.ndarray, parts: int = PARTS, k: int = TOP, recall: float = RECALL) -> tuple[Router, int]:
    """The router, and the number of parts that a query is sent to."""
    parts = max(1, min(parts, len(x) // 8))
    graph = neighbours(x, NEIGHBOURS)
    part = balanced_parts(graph, x, parts)
    spread = np.zeros((len(x), parts))
    np.add.at(spread, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1)
    np.add.at(spread, (np.arange(len(x)), part), 1)
    router = Router(x, spread / spread.sum(axis=1, keepdims=True))
    asked = np.random.default_rng(10).permutation(len(x))[:1000]
    order = router.order(x)
    home, near = order[:, 0], neighbours(x, k)[asked]
    place = np.argsort(order[asked], axis=1)  # of each part in the query's order
    needed = np.take_along_axis(place, home[near], axis=1) + 1
    shares = [(needed <= p).mean() if needed.size else 1.0 for p in range(1, parts + 1)]
    return router, 1 + next(p for p in range(parts) if shares[p] >= recall or p == parts - 1)


def _assign(routers: dict[int, tuple[int, Router, int]], asked: bool):  # noqa: ANN202
    """vec_id, embedding -> vec_id, embedding, parts: the most probable one, or as many as a query asks. routers: by dimension, its first part, router and probes. A dimension without one is the part of its negative."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, (ids, data) in of_rows(batch, 0, 1).items():
                if dim in routers:
                    first, router, probes = routers[dim]
                    chosen = (first + router.order(data)[:, : probes if asked else 1]).astype(np.int32)
                else:
                    chosen = np.full((len(ids), 1), -dim, np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * m.shape[1], pa.int32()), pa.array(np.ascontiguousarray(m).ravel())) for m in (data, chosen)]
                yield pa.RecordBatch.from_arrays([pa.array(ids), *lists], ["vec_id", "embedding", "parts"])

    return apply


def _pack(limit: int):  # noqa: ANN202
    """Rows of (part, piece, vec_id, embedding) -> blocks of one part and piece."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray]]:
        part, piece, size = np.array(batch.column(0)), np.array(batch.column(1)), np.diff(np.array(batch.column(3).offsets))
        for dim, (ids, data) in of_rows(batch, 2, 3).items():
            keys = np.stack([part, piece], axis=1)[size == dim]
            for k in np.unique(keys, axis=0).tolist():
                own = (keys == k).all(axis=1)
                yield tuple(k), ids[own], data[own]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, piece), ids, data in held(batches, rows, limit):
            for at in range(0, len(ids), limit):
                dim, i, d = to_block(ids[at : at + limit], data[at : at + limit])
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([piece], pa.int32()), pa.array([dim], pa.int32()), pa.array([i], pa.binary()), pa.array([d], pa.binary())], ["part", "piece", "dim", "ids", "data"])

    return apply


def _score(k: int):  # noqa: ANN202
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, data, q_dim, q_ids, q_data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, x = from_block(dim, ids, data)
                asked, y = from_block(q_dim, q_ids, q_data)
                scores = y @ x.T
                query, vec, score = [], [], []
                for q, row in zip(asked.tolist(), scores, strict=True):
                    other = own != q
                    i, s = (own, row) if other.all() else (own[other], row[other])
                    chosen = best(s, i, k)
                    query.append(np.full(len(chosen), q))
                    vec.append(i[chosen])
                    score.append(s[chosen])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(query).astype(np.int64)), pa.array(np.concatenate(vec).astype(np.int64)), pa.array(np.concatenate(score).astype(np.float64))], ["query_id", "vec_id", "score"])

    return apply


def search(vectors: DataFrame, queries: DataFrame, k: int = TOP, parts: int = PARTS, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score of both tables' (vec_id, embedding) rows."""
    spark = vectors.sparkSession
    prepare(spark)
    zero = F.exists("embedding", lambda x: x != 0)
    fine, asked = (t.where(F.col("vec_id").isNotNull() & usable() & zero).select("vec_id", "embedding") for t in (vectors, queries))
    sample: dict[int, np.ndarray] = {}
    for batch in fine.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().combine_chunks().to_batches():
        sample = {d: x for d, (_, x) in of_rows(batch, 0, 1).items()}
    routers: dict[int, tuple[int, Router, int]] = {}
    for i, (dim, x) in enumerate(sorted(sample.items())):
        if len(x) >= FITTED:
            routers[dim] = (i * parts, *fit(x, parts, k, recall))
    schema = "vec_id bigint, embedding array<double>, parts array<int>"
    index = materialise(fine.mapInArrow(_assign(routers, False), schema).select("vec_id", "embedding", F.col("parts")[0].alias("part")))
    pieces = index.groupBy("part").count().select("part", F.ceil(F.col("count") / PIECE).cast("int").alias("pieces"))
    pieces = {r["part"]: r["pieces"] for r in pieces.collect()}  # one row for each part: some for each dimension
    if not pieces:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    count = F.element_at(F.create_map(*(F.lit(x) for pair in pieces.items() for x in pair)), F.col("part"))
    n = sum(pieces.values())
    dealt = index.withColumn("piece", F.pmod(F.xxhash64("vec_id"), count).cast("int")).select("part", "piece", "vec_id", "embedding")
    block = "part int, piece int, dim int, ids binary, data binary"
    left = dealt.repartition(n, "part", "piece").mapInArrow(_pack(PIECE), block)
    sent = asked.mapInArrow(_assign(routers, True), schema).select(F.explode("parts").alias("part"), F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // len(pieces)))).cast("int").alias("piece"), "vec_id", "embedding")
    packed = materialise(sent.repartition(n, "part", "piece").mapInArrow(_pack(QUERIES), block))
    right = packed.where(F.col("part").isin(*pieces)).select("part", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"), F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    met = materialise(left).join(right, ["part", "piece"]).select("dim", "ids", "data", "q_dim", "q_ids", "q_data")
    return ranked(met.mapInArrow(_score(k), "query_id bigint, vec_id bigint, score double"), k)


def op8_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


REGISTERED = {"op8_learned_partitions": op8_learned_partitions}
