"""Substring dedup by content-defined chunks.

A gear hash rolls over a text's bytes: it is doubled and the next byte's random
value added, so in 16 bits it covers the last 16 bytes. A chunk ends where the
hash is greater than at the RADIUS bytes before and no less than at the RADIUS
bytes after. A cut thus depends on the bytes near it and on nothing else: an
insertion moves no cut but those beside it, and a passage that repeats is cut
alike wherever it stands. Cuts lie more than RADIUS bytes apart, and near twice
that on average. Where text repeats with a short period no byte is greater than
all before it; such stretches are cut every MAX_BYTES from the last cut, so that
a copy within another text may keep about that much at each end of one. Every
chunk has at least MIN_BYTES, but a text shorter than that is one chunk. Chunks
are compared by a 128-bit digest. The first, by doc_id and place, stays. Later
ones are repeats, and a run of them goes where it has at least MIN_RUN bytes or
is the whole text: a shorter one is a phrase that texts share by chance or
custom, not a copied passage. A passage of n bytes is found as a run of more
than n - 2 (MAX_BYTES + MIN_BYTES) bytes, and of about n - 100 where chunks have
their usual size.

Every task keeps the first of its own equal chunks and sends that one only, in
packed blobs by bucket of the digest, so that a chunk costs its bucket one
entry per task at most however often it repeats.

Defined results: null text is empty; a text under MIN_RUN goes only as a whole; a row with null doc_id keeps all and takes nothing; rows
equal in doc_id and text are one document and keep the same; rows with one
doc_id and other texts are ordered by a hash of the text; an empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftline.llm.common import prepare, row_key, table
from liftline.llm.spans import cut, digest_columns, gather, sizes, whole_blobs

RADIUS = 24
MIN_BYTES = 24
MAX_BYTES = 256
#: The least run of repeated chunks that is removed: two chunks of usual size.
MIN_RUN = 4 * RADIUS
#: Chunks held before they are sent, and text bytes per bucket of digests.
_HELD, _BUCKET_BYTES = 1_000_000, 4 << 20
_GEAR = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 16, 256, dtype=np.uint16)
_CHUNK = np.dtype([("high", np.uint64), ("low", np.uint64), ("doc", np.int64), ("rid", np.int64), ("start", np.int32), ("size", np.int32)])


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: sums over 1, 2, 4, 8, 16 bytes put together."""
    h = _GEAR[data]
    for span in (1, 2, 4, 8):
        h[span:] += h[:-span] << np.uint16(span)
    return h


def boundaries(data: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Where chunks end, the text's end included."""
    n = len(data)
    if n < 2 * radius + 1:
        return np.array([n])
    h = gear(data)
    top, span = h, 1
    while 2 * span <= radius:
        top = np.maximum(top[:-span], top[span:])
        span *= 2
    rest = radius - span
    top = np.maximum(top[: len(top) - rest], top[rest:]) if rest else top  # the greatest of the radius bytes from each on
    own = h[radius : n - radius]
    cuts = np.flatnonzero((own > top[: len(own)]) & (own >= top[radius + 1 :])) + radius + 1
    edges = np.r_[0, cuts, n]
    size = np.diff(edges)
    if size.max() <= MAX_BYTES:
        return edges[1:]
    inner = [np.arange(edges[k] + MAX_BYTES, edges[k + 1] - MIN_BYTES + 1, MAX_BYTES) for k in np.flatnonzero(size > MAX_BYTES)]
    return np.sort(np.concatenate([edges[1:], *inner]))


def _chunks(text: str, doc: int, rid: int) -> list[tuple]:
    data = text.encode("utf-8")
    out, at = [], 0
    for end in boundaries(np.frombuffer(data, np.uint8)).tolist():
        digest = xxhash.xxh3_128_intdigest(data[at:end])
        out.append((digest >> 64, digest & 0xFFFFFFFFFFFFFFFF, doc, rid, at, end - at))
        at = end
    return out


def _firsts(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each digest, and the chunks that go."""
    c = c[np.lexsort((c["start"], c["rid"], c["doc"], c["low"], c["high"]))]
    same = np.r_[False, (c["high"][1:] == c["high"][:-1]) & (c["low"][1:] == c["low"][:-1])]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(c))))
    itself = (c["rid"] == c["rid"][head]) & (c["start"] == c["start"][head]) & (c["doc"] == c["doc"][head])
    return c[~same], c[same & ~itself]


_GONE = ["rid", "doc", "start", "end"]
_SENT = pa.schema([("bucket", pa.int32()), ("chunks", pa.binary()), ("rid", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def _gone(c: np.ndarray, buckets: int = 0) -> pa.RecordBatch:
    start = c["start"]
    columns = [pa.array(c["rid"]), pa.array(c["doc"]), pa.array(start), pa.array(start + c["size"])]
    if not buckets:
        return pa.RecordBatch.from_arrays(columns, _GONE)
    bucket = (c["rid"] % buckets).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(bucket), pa.nulls(len(c), pa.binary()), *columns], schema=_SENT)


def _send(buckets: int):  # noqa: ANN202
    def settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        first, gone = _firsts(np.array(held, _CHUNK))
        if len(gone):
            yield _gone(gone, buckets)
        bucket = (first["low"] % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((first["start"], first["rid"], bucket))  # texts together, which packs better
        first, bucket = first[order], bucket[order]
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        blobs = [b"".join(np.ascontiguousarray(first[f][i:j]).tobytes() for f in _CHUNK.names) for i, j in zip(edge, [*edge[1:], len(first)], strict=True)]
        empty = pa.nulls(len(edge), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(bucket[edge], pa.int32()), pa.array(blobs, pa.binary()), empty, empty, empty.cast(pa.int32()), empty.cast(pa.int32())], schema=_SENT)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for rid, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held += _chunks(text, doc, rid)
                if len(held) >= _HELD:
                    yield from settle(held)
                    held = []
        if held:
            yield from settle(held)

    return apply


def _unpack(blob: bytes) -> np.ndarray:
    n = len(blob) // _CHUNK.itemsize
    out, at = np.empty(n, _CHUNK), 0
    for f in _CHUNK.names:
        kind = _CHUNK[f]
        out[f] = np.frombuffer(blob, kind, n, at)
        at += n * kind.itemsize
    return out


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket -> rid, doc, start, end of the chunks that go. One bucket is held at a time."""
    for rows in whole_blobs(batches):
        settled = [x[1:] for x in rows if x[0] is None]
        if settled:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*settled, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], _GONE)
        blobs = [_unpack(x[0]) for x in rows if x[0] is not None]
        if blobs:
            yield _gone(_firsts(np.concatenate(blobs))[1])


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """rid (row_key), doc (the doc_id), starts, ends: the chunks that stand earlier too, written to the shared folder."""
    prepare(docs.sparkSession)
    keyed = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") > 0)).select(row_key().alias("rid"), "doc_id", "text")
    buckets, parts = sizes(docs, _BUCKET_BYTES)
    sent = keyed.mapInArrow(_send(buckets), "bucket int, chunks binary, rid bigint, doc bigint, start int, end int")
    gone = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_resolve, "rid bigint, doc bigint, start int, end int")
    return gather(gone, parts)


def dedup(docs: DataFrame, keep: list[str], min_run: int = MIN_RUN) -> DataFrame:
    """The kept columns of every row with n_bytes, n_removed, n_spans and the remaining bytes."""
    return cut(docs, repeated_chunks(docs), keep, min_run)


def op2_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]))


QUERIES = {"op2_chunk_dedup": op2_chunk_dedup}
