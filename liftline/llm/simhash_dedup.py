"""SimHash near-dedup by anchor-point covering.

A text's fingerprint has 64 bits, each the majority of that bit over the hashes
of its word shingles. The 64 bits are cut into blocks, so many that two
fingerprints within the distance differ by at most one bit in some block. The
anchors of a block are a covering code of radius 1: a Hamming code on its low
bits, times every value of the others. A fingerprint is at home at the one
anchor within the radius and visits all anchors within radius plus one, so two
that match in a block meet at the home of each. At an anchor its home
fingerprints are compared with all its visitors, and only a forest of the
links found there leaves the task, never all pairs. Equal fingerprints are one
class from the start, named by its smallest doc_id.

In ``similar`` a class is a text, not a fingerprint, and links are pairs of
texts whose sets of 5-word shingles (their 64-bit hashes) have a Jaccard
similarity J of 0.8 or more. A fingerprint's bits there are one bit each of
independent min-hashes of that set, so that two differ in a share (1 - J) / 2 of
the bits, wherever a copy was changed. They are cut into bands, and a band is
covered by anchors of a Hamming code as above, each split by whole min-hashes of
the band's own: anchors grow in number with the data. Two texts meet in a band
with probability p = J^2 (q^7 + 7 q^6 (1 - q)), q = (1 + J) / 2, and are missed by
all nine with (1 - p)^9: 0.0009 at 0.8, 0.0001 at 0.85, less above. Those that
meet and differ by at most 16 of 63 bits, which at 0.8 all but 0.0001 do, are
decided by their sets. The sets are made for the texts that have such a link and
travel only to the anchors where it was seen; there a pair that verified links
have not joined yet is decided.

Defined results: null text or text without words has fingerprint zero and is
linked like any other; a text with fewer words than a shingle is one shingle;
a row with null doc_id is linked too, and its component is null only if no
document is in it (in ``similar`` its component is that of documents with its
text, else null); rows that repeat a doc_id are one document; an empty table
gives no rows. Extra columns are ignored. An anchor with many members is dealt
over a grid of pieces of its homes by pieces of its members, so that no task
holds more of one than _HOMES and _VISITORS. Which anchors are so large is told
from a sample of one fingerprint in _SAMPLE; that decides where pairs are
compared, never which.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftline.llm.common import discard, materialise, prepare, table
from liftline.llm.components import stars

SEED, BITS = 42, 64
WORDS, DISTANCE = 4, 4
#: For stages that ask for a similarity: words of a shingle, least similarity, and the bits in which candidates differ at most.
SIMILAR = {"words": 5, "similarity": 0.8, "distance": 16}
#: Bands of a fingerprint of min-hash bits, bits of a band (a Hamming code), whole min-hashes of a band.
BANDS, CODE, WHOLE = 9, 7, 2
_MIX = np.uint64(0x9E3779B97F4A7C15)
_XOR, _TIMES = np.random.Generator(np.random.PCG64(43)).integers(0, 1 << 64, (2, BANDS * (CODE + WHOLE), 1), dtype=np.uint64) | np.array([[[0]], [[1]]], np.uint64)
_PIECE, _PAIRS, _ROWS, _HASHED = 1 << 18, 1 << 21, 200_000, 1 << 12
#: Homes and members of one anchor that a task compares, about; and of how many fingerprints one is counted to find anchors with more.
_HOMES, _VISITORS, _SAMPLE = 1 << 14, 1 << 17, 64
#: Bytes of shingle sets held by a task before it settles, and pairs decided between two looks at what is joined already.
_SET_BYTES, _DECIDED = 32 << 20, 1024


def _shingles(data: bytes, words: int) -> tuple[bytes, list[int], list[int]]:
    """The words joined by spaces, and the start and end of each shingle in that."""
    found = data.lower().split()
    if not found:
        return b"", [], []
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in found), np.int64, len(found))) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(words, len(found))
    return b" ".join(found), starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist()


def _hashes(data: bytes, words: int) -> np.ndarray:
    joined, starts, ends = _shingles(data, words)
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), _PIECE):
        ones += np.unpackbits(hashes[k : k + _PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _node(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(data.lower().split()))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed number), node (what a class is: the fingerprint)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(_hashes(text.encode("utf-8") if text else b"", words)) for text in batch.column(1).to_pylist()]
            signed = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), signed, signed], ["doc_id", "fp", "node"])

    return docs.select("doc_id", "text").mapInArrow(apply, docs.select("doc_id").schema.add("fp", "long").add("node", "long"))


def min_hashes(hashes: np.ndarray) -> tuple[int, bytes]:
    """A fingerprint of one bit of each min-hash, and a key of each band's whole min-hashes."""
    least = np.full(len(_XOR), np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), _HASHED):
        least = np.minimum(least, ((hashes[k : k + _HASHED] ^ _XOR) * _TIMES).min(axis=1))
    bits, whole = least[: BANDS * CODE], least[BANDS * CODE :].tobytes()
    fp = np.packbits(np.r_[(bits * _MIX) >> np.uint64(63), np.zeros(BITS - len(bits), np.uint64)].astype(bool), bitorder="little").view(np.uint64)[0]
    return int(fp), b"".join(xxhash.xxh64_digest(whole[k : k + 8 * WHOLE], k) for k in range(0, len(whole), 8 * WHOLE))


def set_fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, fp (min-hash bits of the set of shingles, as a signed number), node (the text's hash), keys (8 bytes a band)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text.encode("utf-8") if text else b"" for text in batch.column(1).to_pylist()]
            fps, keys = zip(*(min_hashes(_hashes(data, words)) for data in texts), strict=True) if texts else ((), ())
            nodes = np.array([_node(data) for data in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(nodes), pa.array(keys, pa.binary())], ["doc_id", "fp", "node", "keys"])

    return docs.select("doc_id", "text").mapInArrow(apply, docs.select("doc_id").schema.add("fp", "long").add("node", "long").add("keys", "binary"))


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """lead (the doc_id), node, shingles: the sorted hashes of the text's set of shingles."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text.encode("utf-8") if text else b"" for text in batch.column(1).to_pylist()]
            nodes = np.array([_node(data) for data in texts], np.uint64).view(np.int64)
            sets = [np.unique(_hashes(data, words)).tobytes() for data in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes), pa.array(sets, pa.binary())], ["lead", "node", "shingles"])

    return docs.select(F.col("doc_id").alias("lead"), "text").mapInArrow(apply, docs.select(F.col("doc_id").alias("lead")).schema.add("node", "long").add("shingles", "binary"))


def _blocks(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the fewest blocks of which one differs by at most one bit."""
    n = distance // 2 + 1
    edges = [BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def anchors(fps: np.ndarray, block: int, first: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, anchor, whether at home) for fingerprints: every anchor of the block within two bits, the one within one bit being home."""
    checks = 4 if bits >= 15 else 3
    n = (1 << checks) - 1  # bits under the Hamming code; those above are free
    x = (fps >> np.uint64(first)) & np.uint64((1 << bits) - 1)
    syndrome = np.zeros(len(x), np.int64)
    for i in range(n):
        syndrome ^= np.where((x >> np.uint64(i)) & np.uint64(1), i + 1, 0)
    place = np.arange(len(x))
    flip = lambda s: np.where(s > 0, np.uint64(1) << np.maximum(s - 1, 0).astype(np.uint64), np.uint64(0))
    home = x ^ flip(syndrome)
    free = [np.uint64(1 << i) for i in range(n, bits)]
    out = [(place, home, np.ones(len(x), bool))]
    out += [(place, home ^ f, np.zeros(len(x), bool)) for f in free]
    exact = place[syndrome == 0]  # at the anchor itself: two more bits are left
    out += [(exact, home[exact] ^ f ^ g, np.zeros(len(exact), bool)) for i, f in enumerate(free) for g in free[:i]]
    for i in range(1, n + 1):  # two code bits whose numbers make up the syndrome
        j = i ^ syndrome
        two = place[(syndrome > 0) & (j > i)]
        out.append((two, x[two] ^ flip(np.full(len(two), i)) ^ flip(j[two]), np.zeros(len(two), bool)))
    index, anchor, at_home = (np.concatenate(c) for c in zip(*out, strict=True))
    return index, (anchor | np.uint64(block << 32)).astype(np.int64), at_home


_COPIES = "anchor bigint, fp bigint, lead bigint, home boolean"


def _replicate(distance: int):  # noqa: ANN202
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fps, lead = (np.array(batch.column(i).slice(at, 4096)) for i in range(2))
                for k, (first, bits) in enumerate(_blocks(distance)):
                    index, anchor, home = anchors(fps.view(np.uint64), k, first, bits)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[index]), pa.array(lead[index]), pa.array(home)], ["anchor", "fp", "lead", "home"])

    return apply


def _replicate_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            fps, lead = (np.array(part.column(i)) for i in range(2))
            keys = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint64).reshape(-1, BANDS)
            for k in range(BANDS):
                index, anchor, home = anchors(fps.view(np.uint64), k, CODE * k, CODE)
                anchor = (keys[index, k] ^ (anchor.view(np.uint64) * _MIX)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[index]), pa.array(lead[index]), pa.array(home)], ["anchor", "fp", "lead", "home"])


def _pairs(sizes: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (home member, member) of each group in a run of groups, about _PAIRS at a time."""
    starts = np.cumsum(sizes) - sizes
    group = np.repeat(np.arange(len(sizes)), sizes)
    homes = np.flatnonzero(home)
    width = sizes[group[homes]]
    part = (np.cumsum(width) - 1) // _PAIRS
    cuts = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(homes)] if len(homes) else [0]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        h, w = homes[i:j], width[i:j]
        yield np.repeat(h, w), np.repeat(starts[group[h]], w) + np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)


def _hook(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels that agree along the links a-b; each is the least index of its set."""
    while len(a):
        x, y = labels[a], labels[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        apart = low != high
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(labels, high[apart], low[apart])
        while (labels != labels[labels]).any():
            labels = labels[labels]
    return labels


def _grouped(anchor: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by anchor and lead, and the sizes of the anchors in it."""
    order = np.lexsort((lead, anchor))
    anchor = anchor[order]
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    return order, np.diff(np.r_[first, len(anchor)])


def _edges(lead: np.ndarray, labels: np.ndarray) -> pa.RecordBatch:
    moved = lead != lead[labels]
    edges = np.unique(np.stack([lead[moved], lead[labels][moved]], axis=1), axis=0) if moved.any() else np.empty((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(edges[:, 0].copy()), pa.array(edges[:, 1].copy())], ["node", "root"])


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are alike."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.sort(np.concatenate([x, y]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def _by_anchor(settle, width: int):  # noqa: ANN001, ANN202
    """settle(columns) over runs of whole anchors of rows sorted by anchor; the fourth column is of booleans, one from width on of shingle sets."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n, size, least = 0, 0, 1  # least grows while one anchor fills all that is held

        def columns() -> list:
            return [np.concatenate(c) for c in zip(*held, strict=True)]

        for batch in batches:
            if not batch.num_rows:
                continue
            own = [np.array(batch.column(i)) for i in range(3)] + [np.array(batch.column(3).to_pylist(), bool)]
            if width > 4:
                sets = np.empty(batch.num_rows, object)
                sets[:] = batch.column(4).to_pylist()
                size += sum(map(len, sets))
                own.append(sets)
            held.append(tuple(own))
            n += batch.num_rows
            if n >= least * _ROWS or size >= least * _SET_BYTES:
                all_ = columns()
                last = np.searchsorted(all_[0], all_[0][-1])  # the last anchor may go on
                if last:
                    yield settle(*(c[:last] for c in all_))
                    held = [tuple(c[last:] for c in all_)]
                    n, size, least = len(all_[0]) - last, sum(map(len, all_[4][last:])) if width > 4 else 0, 1
                else:
                    held, least = [tuple(all_)], 2 * least
        if held:
            yield settle(*columns())

    return apply


def _compare(distance: int, see_only: bool = False):  # noqa: ANN202
    """Rows sorted by anchor -> forest edges (node, root) of leads; or, to see only, the (anchor, fp, lead, home) that have a link."""

    def settle(anchor: np.ndarray, fp: np.ndarray, lead: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        order, sizes = _grouped(anchor, lead)
        anchor, fp, lead, home = anchor[order], fp[order].view(np.uint64), lead[order], home[order]
        labels, linked = np.arange(len(anchor)), np.zeros(len(anchor), bool)
        for a, b in _pairs(sizes, home):
            near = (np.bitwise_count(fp[a] ^ fp[b]) <= distance) & (lead[a] != lead[b])
            if see_only:
                linked[a[near]] = linked[b[near]] = True
            else:
                labels = _hook(labels, a[near], b[near])
        if see_only:
            return pa.RecordBatch.from_arrays([pa.array(anchor[linked]), pa.array(fp[linked].view(np.int64)), pa.array(lead[linked]), pa.array(home[linked])], ["anchor", "fp", "lead", "home"])
        return _edges(lead, labels)

    return _by_anchor(settle, 4)


def _decide(distance: int, similarity: float):  # noqa: ANN202
    """Rows sorted by anchor, with shingle sets -> forest edges (node, root) of leads over links that hold by the sets."""

    def settle(anchor: np.ndarray, fp: np.ndarray, lead: np.ndarray, home: np.ndarray, sets: np.ndarray) -> pa.RecordBatch:
        order, sizes = _grouped(anchor, lead)
        fp, lead, home, sets = fp[order].view(np.uint64), lead[order], home[order], [np.frombuffer(x, np.uint64) for x in sets[order]]
        labels = np.arange(len(lead))
        for a, b in _pairs(sizes, home):
            near = (np.bitwise_count(fp[a] ^ fp[b]) <= distance) & (lead[a] != lead[b]) & ((a < b) | ~home[b])
            a, b = a[near], b[near]
            for k in range(0, len(a), _DECIDED):
                x, y = a[k : k + _DECIDED], b[k : k + _DECIDED]
                apart = labels[x] != labels[y]
                x, y = x[apart], y[apart]
                fine = np.fromiter((_jaccard(sets[i], sets[j]) >= similarity for i, j in zip(x.tolist(), y.tolist(), strict=True)), bool, len(x))
                labels = _hook(labels, x[fine], y[fine])
        return _edges(lead, labels)

    return _by_anchor(settle, 5)


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("anchor").sortWithinPartitions("anchor")


def _large(led: DataFrame, replicate) -> DataFrame:  # noqa: ANN001
    """anchor, down, across: the anchors with many members, and in how many pieces of homes and of members they are dealt out."""
    some = replicate(led.where(F.pmod(F.xxhash64("lead"), F.lit(_SAMPLE)) == 0))
    size = some.groupBy("anchor").agg((F.sum(F.col("home").cast("long")) * _SAMPLE).alias("homes"), (F.count(F.lit(1)) * _SAMPLE).alias("members"))
    pieces = lambda n, most: F.greatest(F.lit(1), F.ceil(F.col(n) / most)).cast("int")
    return materialise(size.where(F.col("members") > _VISITORS).select("anchor", pieces("homes", _HOMES).alias("down"), pieces("members", _VISITORS).alias("across")))


def _dealt(led: DataFrame, replicate) -> DataFrame:  # noqa: ANN001
    """The replicas, sorted by anchor. Each cell of a large anchor's grid has an anchor of its own; a home stands in the cells of its row, a member in those of its column, so that they meet in one."""
    rows, large = replicate(led), _large(led, replicate)
    if large.isEmpty():
        return _sorted(rows)
    own = lambda n: F.pmod(F.xxhash64("lead", F.lit(n)), F.col(n)).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda d, a, home: F.struct(F.xxhash64("anchor", d, a).alias("anchor"), F.lit(home).alias("home"))
    visits = F.transform(each("down"), lambda d: cell(d, own("across"), False))
    stays = F.transform(each("across"), lambda a: cell(own("down"), a, True))
    cells = F.when(F.col("down").isNull(), F.array(F.struct("anchor", "home"))).when(F.col("home"), F.concat(visits, stays)).otherwise(visits)
    out = rows.join(large, "anchor", "left").select("fp", "lead", F.explode(cells).alias("cell"))
    return _sorted(out.select("cell.anchor", "fp", "lead", "cell.home"))


def _classes(led: DataFrame, edges: DataFrame) -> DataFrame:
    """node, fp, component_id: the least doc_id of every class that the edges between leads reach."""
    found = stars(edges).select(F.col("node").alias("lead"), "root")
    return materialise(led.join(found, "lead", "left").groupBy("node", "fp").agg(F.min(F.coalesce("root", "lead")).alias("component_id")))


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id for every row. Links are between fingerprints, so rows with null doc_id link like others."""
    prepare(docs.sparkSession)
    prints = materialise(fingerprints(docs, words))
    led = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("lead")))
    replicate = lambda prints: prints.select("fp", "lead").mapInArrow(_replicate(distance), _COPIES)
    links = stars(_dealt(led.select("fp", F.col("fp").alias("lead")), replicate).mapInArrow(_compare(distance), "node bigint, root bigint"))
    joined = led.join(links.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "lead", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("lead").alias("component_id"))
    return prints.join(joined.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def similar(docs: DataFrame, settings: dict | None = None) -> DataFrame:
    """doc_id, component_id for every row: links are pairs of texts whose sets of shingles are that similar."""
    s = settings or SIMILAR
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    prints = materialise(set_fingerprints(docs, s["words"]))
    led = materialise(prints.where(F.col("doc_id").isNotNull()).groupBy("node", "fp").agg(F.min("doc_id").alias("lead"), F.min("keys").alias("keys")))
    replicate = lambda prints: prints.select("fp", "lead", "keys").mapInArrow(_replicate_bands, _COPIES)
    seen = materialise(_dealt(led, replicate).mapInArrow(_compare(s["distance"], True), _COPIES))
    asked = docs.join(seen.select(F.col("lead").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = led.join(shingle_sets(asked, s["words"]).dropDuplicates(["lead", "node"]), ["lead", "node"]).select("lead", "fp", "shingles")
    edges = _sorted(seen.join(sets, ["lead", "fp"]).select("anchor", "fp", "lead", "home", "shingles")).mapInArrow(_decide(s["distance"], s["similarity"]), "node bigint, root bigint")
    classes = _classes(led.drop("keys"), edges)
    discard(led, seen)
    return prints.select("doc_id", "node", "fp").join(classes, ["node", "fp"], "left").select("doc_id", "component_id")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash_dedup": op4_simhash_dedup}
