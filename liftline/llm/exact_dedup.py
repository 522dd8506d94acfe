"""Exact dedup by Patricia-trie owners.

Texts are dealt to partitions by length and content hash, and each partition
inserts full byte strings into a compressed radix trie. A terminal node stores
the owner of its text, which is the identifier that stays (the largest, or the
smallest by parameter), so texts are one only if every byte agrees.

A task first puts its own rows into small tries, so that of a text with any
number of copies each task sends one record; documents keep the number of their
record. A partition's trie that outgrows HELD bytes spills by subtree: the
heaviest subtrees below its first fork leave as rows of the shared folder, what
comes for them later follows, and the next round deals them out by subtree,
length and hash; rounds end when nothing is spilled.

Defined results: null text counts as empty; every row gives one row; of equal
texts one row stays, also where rows repeat the doc_id (then one of the equal
rows); a null doc_id is below all others and stays only if the whole group has
none; texts are compared whole, of any length; an empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from liftline.llm.common import discard, materialise, prepare, table

#: Bytes of text of the records that a task combines at once, of a partition of the tries, and those that a trie may hold before it spills.
COMBINED, PARTITION, HELD = 16 << 20, 16 << 20, 64 << 20
_NODE = 200  # bytes that a node counts besides its label


class _Node:
    __slots__ = ("children", "gone", "label", "records")

    def __init__(self, label: bytes):
        self.label, self.children, self.records, self.gone = label, {}, None, None


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """A compressed radix trie over bytes; a terminal has the list of its records."""

    def __init__(self) -> None:
        self.root, self.held = _Node(b""), 0

    def insert(self, text: bytes, record: int) -> int | None:
        """Adds the record to the terminal of the text; returns the number of the subtree instead if that was spilled."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = _Node(text[at:])
                self.held += len(child.label) + _NODE
                node = child
                break
            if child.gone is not None:
                return child.gone
            if not text.startswith(child.label, at):  # fork within the label
                k = _shared(child.label, text[at : at + len(child.label)])
                fork = _Node(child.label[:k])
                child.label = child.label[k:]
                fork.children[child.label[0]] = child
                node.children[text[at]] = child = fork
                self.held += _NODE
            node, at = child, at + len(child.label)
        if node.records is None:
            node.records = []
        node.records.append(record)
        return None

    def _weight(self, node: _Node) -> int:
        total, left = 0, [node]
        while left:
            n = left.pop()
            total += len(n.label) + _NODE
            left.extend(n.children.values())
        return total

    def walk(self, node: _Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, list[int]]]:
        """Every text below the node with its records."""
        left = [(node or self.root, prefix)]
        while left:
            n, path = left.pop()
            path += n.label
            if n.records:
                yield path, n.records
            left.extend((c, path) for c in n.children.values() if c.gone is None)

    def spill(self, most: int) -> Iterator[tuple[int, bytes, list[int]]]:
        """Takes out the heaviest subtrees until at most so many bytes are held: (subtree, text, records). One subtree always stays, so every round gets on."""
        node, path = self.root, b""
        while self.held > most:
            heavy = sorted(((self._weight(c), b) for b, c in node.children.items() if c.gone is None), reverse=True)
            while self.held > most and len(heavy) > 1:
                weight, byte = heavy.pop(0)
                child, stub = node.children[byte], _Node(bytes([byte]))
                stub.gone = int.from_bytes(hashlib.sha256(path + stub.label).digest()[:8], "little", signed=True)
                for text, records in self.walk(child, path):
                    yield stub.gone, text, records
                node.children[byte] = stub
                self.held -= weight
            if not heavy:
                return
            node = node.children[heavy[0][1]]
            path += node.label


def _better(sign: int):  # noqa: ANN202
    """Whether an id goes before another: the larger (or smaller) one, null last."""

    def apply(new: object, old: object) -> bool:
        if new is None or old is None:
            return new is not None and old is None
        return new > old if sign > 0 else new < old

    return apply


_RECORD = ("rep", "doc_id", "first", "text", "length", "hash", "sha", "best", "n")


def _combine(id_type: pa.DataType, sign: int):  # noqa: ANN202
    """Rows -> for every row its record and whether it is the one that the record stands for, and for every record the text, its owner and its rows."""
    types = (pa.int64(), id_type, pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.string(), id_type, pa.int64())
    better = _better(sign)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 36
        trie, ids = Trie(), []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            reps, firsts, records = [0] * len(ids), [False] * len(ids), []
            for text, rows in trie.walk():
                best = rows[0]
                for r in rows:
                    reps[r] = made
                    if better(ids[r], ids[best]):
                        best = r
                firsts[best] = True
                digest = hashlib.sha256(text).digest()
                records.append((made, None, None, text, len(text), int.from_bytes(digest[:8], "little", signed=True), digest.hex(), ids[best], len(rows)))
                made += 1
            empty = [None] * len(ids)
            for columns in ((reps, ids, firsts, *[empty] * 6), tuple(zip(*records, strict=True))):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(_RECORD))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                trie.insert(text, len(ids))
                ids.append(doc_id)
                if trie.held > COMBINED:
                    yield from flush()
                    trie, ids = Trie(), []
        if ids:
            yield from flush()

    return apply


_OWNED = ("rep", "sha", "keep_id", "winner", "group_size", "text", "length", "hash", "best", "n", "subtree")


def _own(id_type: pa.DataType, sign: int, held: int):  # noqa: ANN202
    """Records of a partition -> each with its owner, or again as it came with the subtree that it was spilled with."""
    types = (pa.int64(), pa.string(), id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), id_type, pa.int64(), pa.int64())
    better = _better(sign)

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], list(_OWNED))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, records, out, size = Trie(), [], [], 0

        def away(text: bytes, record: tuple, subtree: int) -> None:
            nonlocal size
            rep, length, hashed, sha, best, n = record
            out.append((rep, sha, None, None, None, text, length, hashed, best, n, subtree))
            size += length

        for batch in batches:
            for text, *record in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                subtree = trie.insert(text, len(records))
                if subtree is None:
                    records.append(record)
                else:
                    away(text, record, subtree)
                if trie.held > held:
                    for gone, path, owned in trie.spill(held // 2):
                        for r in owned:
                            away(path, records[r], gone)
                if size > COMBINED:
                    yield rows(out)
                    out, size = [], 0
        for _, owned in trie.walk():
            winner = records[owned[0]]
            for r in owned:
                new, old = records[r][4], winner[4]
                if better(new, old) or (new == old and records[r][0] < winner[0]):
                    winner = records[r]
            total = sum(records[r][5] for r in owned)
            out.extend((records[r][0], records[r][3], winner[4], winner[0], total, *[None] * 6) for r in owned)
            if len(out) > 10_000:
                yield rows(out)
                out = []
        if out:
            yield rows(out)

    return apply


def exact_classes(docs: DataFrame, keep: str = "largest", held: int = HELD) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of (doc_id, text); ``keep`` says which doc_id owns a text."""
    prepare(docs.sparkSession)
    sign = {"largest": 1, "smallest": -1}[keep]
    id_type = docs.schema["doc_id"].dataType
    name, arrow = id_type.simpleString(), to_arrow_type(id_type)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    combined = materialise(texts.mapInArrow(_combine(arrow, sign), f"rep bigint, doc_id {name}, first boolean, text binary, length bigint, hash bigint, sha string, best {name}, n bigint"))
    waiting = combined.where("n IS NOT NULL").withColumn("subtree", F.lit(0).cast("long"))
    done, old = None, []
    while True:  # a round for what the last one spilled; the first does all, unless a partition is far above its share
        size = waiting.agg(F.sum("length")).first()[0]
        if size is None and done is not None:
            break
        dealt = waiting.repartition(max(1, -(-(size or 0) // PARTITION)), "subtree", "length", "hash")
        found = materialise(dealt.select("text", "rep", "length", "hash", "sha", "best", "n").mapInArrow(_own(arrow, sign, held), f"rep bigint, sha string, keep_id {name}, winner bigint, group_size bigint, text binary, length bigint, hash bigint, best {name}, n bigint, subtree bigint"))
        own = found.where("winner IS NOT NULL").select("rep", "sha", "keep_id", "winner", "group_size")
        done = own if done is None else done.unionByName(own)
        waiting = found.where("subtree IS NOT NULL").drop("keep_id", "winner", "group_size")
        old.append(found)
    rows = combined.where("n IS NULL").select("rep", "doc_id", "first")
    out = rows.join(done, "rep").select("doc_id", "keep_id", "group_size", (F.col("first") & (F.col("winner") == F.col("rep"))).alias("kept"), F.col("sha").alias("text_sha256"))
    out = materialise(out)
    discard(combined, *old)
    return out


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op11_exact_dedup": op11_exact_dedup}

ORACLES = {
    "op11_exact_dedup": """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents"""
}
