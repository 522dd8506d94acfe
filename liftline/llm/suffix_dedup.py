"""Exact substring dedup by suffix intervals bounded at a minimum length.

Texts are UTF-8 bytes. A byte is removed if a string of MIN_BYTES bytes that
covers it also starts in a document with a smaller doc_id. Strings are judged
on the input, so removals do not depend on each other.

1. Every window of MIN_BYTES bytes is owned by its least k-gram by hash (its
   anchor, the first on ties), so equal windows have equal anchors. Anchors
   that stand in one document only cannot matter. A task settles those that
   its own documents share; of the rest it sends each hash once, in packed
   blobs by bucket, so that a hash costs a bucket one entry per task at most
   however many documents hold it.
2. The windows of each anchor that matters form a segment of text. Of a task's
   equal segments all documents but the smallest lose theirs at once; the one
   left is sent to its anchor's bucket. There equal segments are merged, many
   anchors to a block of about a quarter of a megabyte.
3. Over each block's suffix order the intervals of common prefixes are
   expanded breadth first: extending the intervals of common length l backward
   over the Burrows-Wheeler transform yields those of l + 1, so common-prefix
   values are found in increasing order, and expansion stops at MIN_BYTES.
   The windows in one interval are equal; the smallest doc_id among its
   segments decides which documents lose them.

Defined results: null text is empty; texts shorter than MIN_BYTES lose
nothing; a null doc_id is neither smaller nor larger than any other, its row
loses nothing and takes nothing; rows with one doc_id do not remove each
other's bytes; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftline.llm.common import discard, materialise, prepare, row_key, table
from liftline.llm.spans import by_text, cut, cut_texts, digest_columns, gather, sizes, whole_blobs, whole_keys

MIN_BYTES = 50
GRAM = 20
#: Bytes of text hashed at once; anchors held before they are sent; text bytes per bucket of anchors; bytes in a block of segments; segments held before they are sent.
_BUFFER, _HELD, _BUCKET_BYTES, _BLOCK, _PLACES = 1 << 19, 800_000, 2 << 20, 1 << 18, 200_000
_POS = np.uint64((1 << 24) - 1)
_LAST = np.iinfo(np.int64).max
_PIECE = 1 << 23  # a longer text is hashed in pieces of so many windows


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each gram, from hashes of 1, 2, 4, ... bytes put together."""
    with np.errstate(over="ignore"):
        power = {1: (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)}
        length = 1
        while 2 * length <= gram:
            h = power[length]
            power[2 * length] = h[:-length] * np.uint64(0xD6E8FEB86659FD93 + 2 * length) + h[length:]
            length *= 2
        out, done = power[length], length
        while done < gram:
            length = 1 << ((gram - done).bit_length() - 1)
            n = len(data) - done - length + 1
            out = out[:n] * np.uint64(0xA0761D6478BD642F) + power[length][done : done + n]
            done += length
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xE7037ED1A0B428DB)
        return out ^ (out >> np.uint64(29))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    out = x
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _anchors(data: np.ndarray, lows: np.ndarray, highs: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """For the texts at [low, high) in data: hash, text number, first window and last window of each run of windows with one anchor."""
    none = (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
    fits = highs - lows >= least
    if not fits.any():
        return none
    hashes = _gram_hashes(data, gram)
    key = (hashes & ~_POS) | np.arange(len(hashes), dtype=np.uint64)
    owner = (_sliding_min(key, least - gram + 1) & _POS).astype(np.int64)
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, lows[fits], 1)
    np.add.at(edge, highs[fits] - least + 1, -1)
    windows = np.flatnonzero(np.cumsum(edge[: len(owner)]) > 0)
    anchor = owner[windows]
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    last = np.r_[first[1:] - 1, len(anchor) - 1]
    start = windows[first]
    return hashes[anchor[first]], np.searchsorted(lows, start, side="right") - 1, start, windows[last]


def _runs(texts: list[str | None], least: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """hash, row, ordinal within the text, first window, last window (offsets in the text), with the bytes they are in and the text's offset there, in groups of rows; a row's runs come in order."""
    pieces: list[bytes] = []
    rows: list[int] = []
    shifts: list[int] = []
    size = 0
    counted: dict[int, int] = {}

    def flush() -> tuple:
        joined = b"".join(pieces)
        data = np.frombuffer(joined, np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        lows = ends - [len(p) for p in pieces]
        h, k, a, b = _anchors(data, lows, ends, least, gram)
        row, shift = np.array(rows)[k], np.array(shifts)[k] - lows[k]
        change = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
        ordinal = np.arange(len(row))
        for i, j in zip(change, [*change[1:], len(row)], strict=True):
            base = counted.get(int(row[i]), 0)
            ordinal[i:j] += base - i
            counted[int(row[i])] = base + int(j - i)
        return h, row, ordinal, a, b, shift, joined

    for i, text in enumerate(texts):
        data = text.encode("utf-8") if text else b""
        if len(data) < least:
            continue
        for at in range(0, len(data) - least + 1, _PIECE):
            piece = data[at : at + _PIECE + least - 1]
            pieces.append(piece)
            rows.append(i)
            shifts.append(at)
            size += len(piece)
            if size >= _BUFFER:
                yield flush()
                pieces.clear(), rows.clear(), shifts.clear()
                size = 0
    if pieces:
        yield flush()


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(33)).astype(np.int64) % buckets


def _tops(h: np.ndarray) -> bytes:
    """The upper 32 bits; that two anchors of a bucket agree in those by chance costs a comparison, not a result."""
    return (h >> np.uint64(32)).astype(np.uint32).tobytes()


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(a.tobytes() for a in arrays), 3)


#: rid and ords: anchors (by ordinal) that matter. Else a bucket's blob: hashes and ordinals, with rids and their runs' lengths, and the hashes already known to be shared.
_SENT = "bucket int, rid bigint, ords array<int>, hashes binary, numbers binary, rids binary, lengths binary, known binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("rid", pa.int64()), ("ords", pa.list_(pa.int32())), *((c, pa.binary()) for c in ("hashes", "numbers", "rids", "lengths", "known"))])


def _send(buckets: int, least: int, gram: int):  # noqa: ANN202
    def settle(h: np.ndarray, rid: np.ndarray, number: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(h, kind="stable")
        hs, rs = h[order], rid[order]
        first = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
        sizes = np.diff(np.r_[first, len(hs)])
        shared = np.minimum.reduceat(rs, first) != np.maximum.reduceat(rs, first)
        known = hs[first[shared]]
        mine = np.zeros(len(h), bool)
        mine[order] = np.repeat(shared, sizes)
        rows: dict[str, list] = {c: [] for c in _SENT_ARROW.names}

        def add(**x: object) -> None:
            for c in rows:
                rows[c].append(x.get(c))

        at = np.flatnonzero(mine)
        if len(at):  # in order of text, so a text's are together
            edge = np.flatnonzero(np.r_[True, rid[at][1:] != rid[at][:-1]])
            for i, j in zip(edge, [*edge[1:], len(at)], strict=True):
                r = int(rid[at[i]])
                add(bucket=r % buckets, rid=r, ords=number[at[i:j]].astype(np.int32))
        at = np.flatnonzero(~mine)
        b, kb = _bucket(h[at], buckets), _bucket(known, buckets)
        order, korder = np.argsort(b, kind="stable"), np.argsort(kb, kind="stable")
        at, b, known, kb = at[order], b[order], known[korder], kb[korder]
        used = np.union1d(b, kb)
        edges = [np.searchsorted(x, used, side) for x in (b, kb) for side in ("left", "right")]
        for k, i, j, ki, kj in zip(used.tolist(), *(e.tolist() for e in edges), strict=True):
            own = at[i:j]
            r = rid[own]
            edge = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.empty(0, np.int64)
            add(bucket=k, hashes=_tops(h[own]), numbers=_pack(number[own].astype(np.int32)), rids=r[edge].tobytes(), lengths=_pack(np.diff(np.r_[edge, len(r)]).astype(np.int32)), known=_tops(known[ki:kj]))
        yield pa.RecordBatch.from_pydict(rows, _SENT_ARROW)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            rids = np.array(batch.column(0), np.int64)
            for h, row, ordinal, *_ in _runs(batch.column(1).to_pylist(), least, gram):
                held.append((h, rids[row], ordinal))
                n += len(h)
                if n >= _HELD:
                    yield from settle(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, n = [], 0
        if n:
            yield from settle(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return apply


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket -> rid, ord: which of the sent anchors other documents hold too. One bucket is held at a time."""
    for rows in whole_blobs(batches):
        settled = [(r, ords) for r, ords, *_ in rows if ords is not None]
        if settled:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([r for r, _ in settled], [len(o) for _, o in settled])), pa.array(np.concatenate([np.array(o, np.int32) for _, o in settled]))], ["rid", "ord"])
        sent = [x[2:] for x in rows if x[1] is None]
        if not sent:
            continue
        h = np.concatenate([np.frombuffer(x[0], np.uint32) for x in sent])
        number = np.concatenate([np.frombuffer(zstandard.decompress(x[1]), np.int32) for x in sent])
        rid = np.concatenate([np.repeat(np.frombuffer(x[2], np.int64), np.frombuffer(zstandard.decompress(x[3]), np.int32)) for x in sent])
        known = np.concatenate([np.frombuffer(x[4], np.uint32) for x in sent])
        if not len(h):
            continue
        order = np.argsort(h, kind="stable")
        hs, rs = h[order], rid[order]
        first = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
        shared = (np.minimum.reduceat(rs, first) != np.maximum.reduceat(rs, first)) | np.isin(hs[first], known)
        at = order[np.repeat(shared, np.diff(np.r_[first, len(hs)]))]
        yield pa.RecordBatch.from_arrays([pa.array(rid[at]), pa.array(number[at])], ["rid", "ord"])


def _as_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of rid, ord, sorted by rid -> rid, bits: a text's anchors that matter as a bit set."""
    for rid, number in whole_keys(batches):
        edge = np.r_[np.flatnonzero(np.r_[True, rid[1:] != rid[:-1]]), len(rid)]
        bits = []
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            flags = np.zeros(int(number[i:j].max()) + 1, np.uint8)
            flags[number[i:j]] = 1
            bits.append(np.packbits(flags).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(rid[edge[:-1]]), pa.array(bits, pa.binary())], ["rid", "bits"])


#: rid, doc, starts, ends: spans of a text that surely go. Else a bucket's blob of segments to compare.
_SEGMENTS = "bucket int, rid bigint, doc bigint, starts array<int>, ends array<int>, blob binary"
_SPAN = ["rid", "doc", "start", "end"]
_SPANS_ARROW = pa.schema([("rid", pa.int64()), ("doc", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
_SEGMENTS_ARROW = pa.schema([("bucket", pa.int32()), *_SPANS_ARROW, ("blob", pa.binary())])
#: Arrays of a blob, then the segments' bytes.
_FIELDS = (("anchor", np.uint64), ("doc", np.int64), ("rid", np.int64), ("start", np.int32), ("size", np.uint8))


def _segments(buckets: int, least: int, gram: int):  # noqa: ANN202
    """Each segment goes to its anchor's bucket once for each task, for the smallest doc_id that the task has it from; the task's other documents lose it at once."""

    def send(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        segs = [joined[p:q] for low, high, joined, *_ in held for p, q in zip(low.tolist(), high.tolist(), strict=True)]
        x, doc, rid, start = (np.concatenate(c) for c in list(zip(*held, strict=True))[3:])
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(s, len(number)) for s in segs])  # equal segments have equal anchors
        size = np.array([len(s) for s in segs])
        lowest = np.full(len(number), _LAST)
        np.minimum.at(lowest, which, doc)
        kept = doc == lowest[which]
        if not kept.all():
            at = np.flatnonzero(~kept)
            spans = by_text(rid[at], doc[at], start[at], start[at] + size[at])
            yield pa.RecordBatch.from_arrays([pa.array([r % buckets for r in spans[0]], pa.int32()), *(pa.array(c, f.type) for c, f in zip(spans, _SPANS_ARROW, strict=True)), pa.nulls(len(spans[0]), pa.binary())], schema=_SEGMENTS_ARROW)
        at = np.flatnonzero(kept)
        bucket = _bucket(x[at], buckets)
        order = np.argsort(bucket, kind="stable")
        at, bucket = at[order], bucket[order]
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        blobs = []
        for i, j in zip(edge, [*edge[1:], len(at)], strict=True):
            own = at[i:j]
            columns = dict(anchor=x, doc=doc, rid=rid, start=start, size=size)
            blobs.append(zstandard.compress(b"".join([np.array([len(own)], np.int64).tobytes(), *(columns[f][own].astype(t).tobytes() for f, t in _FIELDS), *(segs[k] for k in own.tolist())]), 3))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[edge], pa.int32()), *(pa.nulls(len(edge), f.type) for f in _SPANS_ARROW), pa.array(blobs, pa.binary())], schema=_SEGMENTS_ARROW)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for batch in batches:
            bits = batch.column(3).to_pylist()
            rids, ids = (np.array(batch.column(i), np.int64) for i in (0, 1))
            for _hash, row, ordinal, a, b, shift, joined in _runs(batch.column(2).to_pylist(), least, gram):
                pick = np.zeros(len(row), bool)
                edge = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else ()
                for i, j in zip(edge, [*edge[1:], len(row)], strict=True):
                    flags = np.unpackbits(np.frombuffer(bits[row[i]], np.uint8)).astype(bool)[ordinal[i] : ordinal[i] + j - i]
                    pick[i : i + len(flags)] = flags
                if pick.any():
                    r = row[pick]
                    held.append((a[pick], b[pick] + least, joined, _hash[pick], ids[r], rids[r], a[pick] + shift[pick]))
                    n += len(r)
                if n >= _PLACES:
                    yield from send(held)
                    held, n = [], 0
        if held:
            yield from send(held)

    return apply


def suffix_order(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array by the first ``depth`` symbols at least, and its inverse: symbols packed eight at a time, then doubled among those that still tie."""
    n = len(codes)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = codes
    key = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64)
    sa = np.argsort(key).astype(np.int32)
    ks = key[sa]
    new = np.r_[True, ks[1:] != ks[:-1]]
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    length = 8
    while length < depth:
        slots = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if not len(slots):
            break
        own = sa[slots]
        pair = (rank[own].astype(np.int64) << 32) | (rank[np.minimum(own + length, n)] + 1)
        order = np.argsort(pair)
        own, pair = own[order], pair[order]
        sa[slots] = own
        fresh = np.r_[True, pair[1:] != pair[:-1]]
        rank[own] = np.maximum.accumulate(np.where(fresh, slots, 0))
        new[slots] = fresh
        length *= 2
    inverse = np.empty(n + 1, np.int32)
    inverse[sa] = np.arange(n, dtype=np.int32)
    inverse[n] = -1
    return sa, inverse


def bounded_intervals(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array, and the number of the interval of each rank in it: ranks whose suffixes share ``depth`` symbols.

    ``cuts`` marks the ranks at which an interval of common length l begins. A rank j is reached by backward
    extension from rank k, the suffix one symbol shorter: LF(k) = j. Its neighbour j - 1 comes from k'. If they begin
    with one symbol, their common prefix is one longer than that of k' and k, which an interval boundary between k'
    and k bounds. So from the boundaries with common prefixes up to l those of l + 1 follow, in increasing order;
    a rank is settled once and then left alone.
    """
    sa, inverse = suffix_order(codes, depth)
    came = inverse[sa + 1]  # the k of each j; -1 for the last suffix
    symbol = codes[sa]
    cuts = np.r_[True, symbol[1:] != symbol[:-1]]  # common prefix 0
    cuts[1:] |= (came[1:] < 0) | (came[:-1] < 0)
    open_ = np.flatnonzero(~cuts).astype(np.int32)
    low, high = came[open_ - 1], came[open_]
    for _ in range(1, depth):
        interval = np.cumsum(cuts, dtype=np.int32)
        apart = interval[low] != interval[high]
        cuts[open_[apart]] = True
        stay = ~apart
        open_, low, high = open_[stay], low[stay], high[stay]
        if not len(open_):
            break
    return sa, np.cumsum(cuts, dtype=np.int32) - 1


def _owners(segs: list[bytes], lows: np.ndarray, least: int) -> np.ndarray:
    """Of each window of each segment, one segment after the other, the smallest doc_id that has it."""
    sizes = np.array([len(x) for x in segs])
    starts = np.cumsum(sizes + 1) - sizes - 1
    codes = np.frombuffer(b"\xff".join(segs) + b"\xff", np.uint8) + np.uint8(1)  # UTF-8 has no byte 255, which becomes 0, the least
    sa, interval = bounded_intervals(codes, least)
    number = np.empty(len(codes), np.int32)
    number[sa] = interval
    counts = sizes - least + 1
    first = np.cumsum(counts) - counts
    seg_of = np.repeat(np.arange(len(segs)), counts)
    group = number[np.repeat(starts - first, counts) + np.arange(len(seg_of))]
    lowest = np.full(int(interval[-1]) + 1, _LAST)
    np.minimum.at(lowest, group, lows[seg_of])
    return lowest[group]


def _settle(c: dict[str, np.ndarray], texts: list[bytes], least: int) -> tuple[np.ndarray, ...]:
    """rid, doc, start, end of what goes: equal segments are one, and those of some anchors make a block."""
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(seg, len(number)) for seg in texts])  # equal segments have equal anchors
    keys = list(number)
    anchor = np.empty(len(keys), np.uint64)
    anchor[which] = c["anchor"]
    order = np.argsort(anchor, kind="stable")
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    which, segs, anchor = place[which], [keys[i] for i in order.tolist()], anchor[order]
    lows = np.full(len(segs), _LAST)
    np.minimum.at(lows, which, c["doc"])
    ends = np.cumsum([len(x) + 1 for x in segs])
    owners, i = [], 0
    while i < len(segs):  # to the end of the anchor in which a block fills up
        last = min(int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _BLOCK)), len(segs) - 1)
        j = int(np.searchsorted(anchor, anchor[last], side="right"))
        owners.append(_owners(segs[i:j], lows[i:j], least))
        i = j
    owner = np.concatenate(owners)
    counts = np.array([len(x) - least + 1 for x in segs])
    first = np.cumsum(counts) - counts
    n = counts[which]
    entry = np.repeat(np.arange(len(which)), n)
    offset = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)
    lost = np.flatnonzero(owner[first[which][entry] + offset] < c["doc"][entry])
    if not len(lost):
        return (np.empty(0, np.int64),) * 4
    edge = np.flatnonzero(np.r_[True, (np.diff(lost) > 1) | (np.diff(entry[lost]) > 0)])
    low, high = lost[edge], lost[np.r_[edge[1:] - 1, len(lost) - 1]]
    e = entry[low]
    return c["rid"][e], c["doc"][e], c["start"][e] + offset[low], c["start"][e] + offset[high] + least


def _compare(least: int):  # noqa: ANN202
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_blobs(batches):  # sorted by bucket, which is held one at a time
            held: dict[str, list] = {f: [] for f, _ in _FIELDS}
            texts: list[bytes] = []
            settled = [x[:4] for x in rows if x[4] is None]
            if settled:
                n = [len(x[2]) for x in settled]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat([x[k] for x in settled], n)) for k in (0, 1)), *(pa.array(np.concatenate([np.array(x[k], np.int32) for x in settled])) for k in (2, 3))], _SPAN)
            for *_, blob in rows:
                if blob is None:
                    continue
                blob = zstandard.decompress(blob)
                n, at = int(np.frombuffer(blob, np.int64, 1)[0]), 8
                for f, t in _FIELDS:
                    held[f].append(np.frombuffer(blob, t, n, at))
                    at += n * np.dtype(t).itemsize
                for size in held["size"][-1].tolist():
                    texts.append(blob[at : at + size])
                    at += size
            if texts:
                rid, doc, start, end = _settle({f: np.concatenate(x) for f, x in held.items()}, texts, least)
                if len(rid):
                    yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(doc), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], _SPAN)

    return apply


def repeated_spans(docs: DataFrame, least: int = MIN_BYTES, gram: int = GRAM) -> DataFrame:
    """rid (row_key), doc (the doc_id), starts, ends: byte spans that documents with smaller ids have too, written to the shared folder."""
    prepare(docs.sparkSession)
    keyed = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= least)).select(row_key().alias("rid"), "doc_id", "text")
    buckets, parts = sizes(docs, _BUCKET_BYTES)
    sent = keyed.select("rid", "text").mapInArrow(_send(buckets, least, gram), _SENT)
    matter = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_resolve, "rid bigint, ord int")
    matter = materialise(matter.repartition(parts, "rid").sortWithinPartitions("rid").mapInArrow(_as_bits, "rid bigint, bits binary"))
    chosen = keyed.join(matter, "rid")
    segs = chosen.select("rid", "doc_id", "text", "bits").mapInArrow(_segments(buckets, least, gram), _SEGMENTS)
    spans = gather(segs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_compare(least), "rid bigint, doc bigint, start int, end int"), parts)
    discard(matter)
    return spans


def dedup(docs: DataFrame, keep: list[str], least: int = MIN_BYTES) -> DataFrame:
    """The kept columns of every row with n_bytes, n_removed, n_spans and the remaining bytes."""
    return cut(docs, repeated_spans(docs, least), keep)


def dedup_texts(docs: DataFrame, least: int = MIN_BYTES) -> DataFrame:
    """The columns of docs with what is left of each text; rows of which nothing is left go."""
    return cut_texts(docs, repeated_spans(docs, least))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]))


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
