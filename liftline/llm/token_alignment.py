"""Cross-tokenizer alignment by hash-set intersection of cumulative ends.

A text is encoded by a byte-level model (A) and a piece model (B). Each side's
tokens have cumulative ends in bytes; a dictionary leads from an end to the
token's index. The ends that both dictionaries have, sorted, cut both id lists
into groups, slice by slice; a slice's link is the pair of its last tokens,
which end together.

How often a pair is linked corpus-wide needs all documents. Texts are taken in
chunks of bounded size; a chunk sends each distinct pair once, with its count,
so a pair that every text has is as many rows as there are chunks. Documents
keep the numbers of their pairs within the chunk, and meet the corpus counts of
the chunk's pairs again by chunk.

Defined results: null and empty texts, and texts that one side's tokens do not
spell (such as ones that hold U+2581), have no tokens, and the digest ''; every
row gives one row, repeated or not, and counts; a null doc_id is kept; texts are
used whole, of any length; an empty table gives no rows. Extra columns are
ignored. Models with an entry of no bytes are refused, so no two tokens of a
side end at one place.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from liftline.llm.bpe_automaton import byte_symbols
from liftline.llm.common import discard, materialise, prepare, table

#: Bytes of text whose pairs are counted together, and what a row counts at least.
CHUNK, LEAST = 8 << 20, 256
#: Characters of texts that are encoded together.
GROUP = 1 << 18
#: How piece models write a space.
SPACE = "▁"
#: Fixed value: how byte-level models split a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Models:
    """Both tokenizers with the bytes of each id. The driver reads the files; a task process loads their contents once."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        import sentencepiece
        import tiktoken
        from sentencepiece import sentencepiece_model_pb2

        self.contents = byte_level, pieces
        spec = json.loads(byte_level)
        byte = {x: b for b, x in enumerate(byte_symbols())}
        special = {x["content"] for x in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        ranks = {bytes(byte[c] for c in entry): i for entry, i in vocab.items() if entry not in special}
        made = [vocab[u + v] for u, v in (x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"])]
        if made != sorted(made):  # the encoder merges by id
            raise ValueError("a byte-level model is needed whose ids ascend with its merges")
        rules = sentencepiece_model_pb2.ModelProto.FromString(pieces)
        plain = rules.normalizer_spec.name == "identity" and rules.normalizer_spec.add_dummy_prefix and not rules.normalizer_spec.remove_extra_whitespaces
        if not plain:
            raise ValueError("a piece model is needed that puts a space before texts and else leaves them as they are")
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for spelled, i in ranks.items():
            self.bytes_a[i] = spelled
        self.bytes_b = [bytes([int(x.piece[3:5], 16)]) if self.b.is_byte(i) else x.piece.replace(SPACE, " ").encode() for i, x in enumerate(rules.pieces)]
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        if not all(ranks) or not self.size_b.all():
            raise ValueError("a model with entries of no bytes cannot be aligned")
        self.inner_a, self.last_a, self.inner_b, self.last_b = (np.array([f"{i}{mark}" for i in range(len(x))], object) for x, mark in ((self.bytes_a, ","), (self.bytes_a, "|"), (self.bytes_b, ","), (self.bytes_b, ";")))

    def __reduce__(self):  # noqa: ANN204
        return loaded, self.contents

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of both sides of each text; none where a side does not spell a space and the text. One model after the other, as each fills the processor's caches."""
        asked = [t if t and SPACE not in t else "" for t in texts]  # B spells that as a space
        found = self.b.encode(asked, num_threads=1)
        found = [b if t and b"".join(map(self.bytes_b.__getitem__, b)) == f" {t}".encode() else [] for t, b in zip(asked, found, strict=True)]
        # A's tokens are slices of the text's bytes, so they always spell it
        pairs = [(self.a.encode_ordinary(f" {t}") if b else [], b) for t, b in zip(asked, found, strict=True)]
        return [(np.fromiter(a, np.int64, len(a)), np.fromiter(b, np.int64, len(b))) for a, b in pairs]

    def cuts(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every common end in order, how many tokens of A, and of B, are before it: A's ends, which ascend, are looked up in the dictionary of B's."""
        ends_a, ends_b = (np.cumsum(size[ids]).tolist() for size, ids in ((self.size_a, a), (self.size_b, b)))
        index_b = dict(zip(ends_b, range(1, len(b) + 1), strict=True))
        found = np.fromiter(map(index_b.get, ends_a, repeat(0)), np.int64, len(a))
        index_a = np.flatnonzero(found)
        return index_a + 1, found[index_a]

    def spelled(self, a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of every group, each with what stands after it."""
        if not len(p):
            return ""
        out = np.empty(len(a) + len(b), object)
        at_a = np.arange(len(a)) + np.repeat(np.r_[0, q[:-1]], np.diff(p, prepend=0))
        at_b = np.arange(len(b)) + np.repeat(p, np.diff(q, prepend=0))
        out[at_a], out[at_b] = self.inner_a[a], self.inner_b[b]
        out[at_a[p - 1]], out[at_b[q - 1]] = self.last_a[a[p - 1]], self.last_b[b[q - 1]]
        return "".join(out.tolist())[:-1]


@lru_cache(maxsize=1)
def loaded(byte_level: bytes, pieces: bytes) -> Models:
    """One pair of models is kept by a process."""
    return Models(byte_level, pieces)


def models_of(byte_level: str, pieces: str) -> Models:
    """The models of two files, a byte-level BPE as JSON and a piece model."""
    with open(byte_level, "rb") as f, open(pieces, "rb") as g:
        return loaded(f.read(), g.read())


def _groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts that are encoded together: about GROUP characters."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t or "")
        if size > GROUP:
            yield some
            some, size = [], 0
    if some:
        yield some


def align(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, ids_a, ids_b, cuts (array of a, b: how many tokens of each side are before a common end); a cut's link is the pair of tokens just before it."""
    prepare(docs.sparkSession)
    pair = pa.struct([("a", pa.int32()), ("b", pa.int32())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for some in _groups(batch.column(1).to_pylist()) for x in models.encode(some)]
            cuts = [[{"a": p, "b": q} for p, q in zip(*map(np.ndarray.tolist, models.cuts(*x)), strict=True)] for x in found]
            arrays = [batch.column(0), *(pa.array([x[k].tolist() for x in found], pa.list_(pa.int32())) for k in (0, 1)), pa.array(cuts, pa.list_(pair))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids_a", "ids_b", "cuts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {kind}, ids_a array<int>, ids_b array<int>, cuts array<struct<a:int,b:int>>")


def _packed(x: np.ndarray) -> bytes:
    return zlib.compress(x.astype(np.uint32).tobytes(), 1)


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), np.uint32).astype(np.int64)


_COLUMNS = ("chunk", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "places", "times", "pairs", "pair_n")


def _linked(models: Models, id_type: pa.DataType, chunk: int):  # noqa: ANN202
    """Rows -> documents with the places of their pairs in the chunk's list, and for every chunk that list with counts."""
    longs = pa.list_(pa.int64())
    types = (pa.int64(), id_type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), longs, longs)
    n_b = len(models.bytes_b)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(_COLUMNS))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 36, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            own = [x[-1] for x in held]
            pairs, place, n = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
            rows, at = [], 0
            for *columns, codes in held:
                mine, times = np.unique(place[at : at + len(codes)], return_counts=True)
                at += len(codes)
                rows.append((number, *columns, _packed(np.diff(mine, prepend=0)), _packed(times), None, None))
            yield batch_of(rows)
            yield batch_of([(number, *[None] * 7, pairs, n)])

        for batch in batches:
            ids = iter(batch.column(0).to_pylist())
            for some in _groups(batch.column(1).to_pylist()):
                for text, (a, b) in zip(some, models.encode(some), strict=True):
                    p, q = models.cuts(a, b)
                    digest = hashlib.sha256(models.spelled(a, b, p, q).encode()).hexdigest() if len(a) else ""
                    held.append((next(ids), len(a), len(b), len(p), digest, a[p - 1] * n_b + b[q - 1]))
                    size += max(LEAST, len(text or ""))
                    if size > chunk:
                        yield from flush()
                        number, held, size = number + 1, [], 0
        if held:
            yield from flush()

    return apply


def corpus_counts(docs: DataFrame, models: Models, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    prepare(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType
    name, n_b = id_type.simpleString(), len(models.bytes_b)
    linked = docs.select("doc_id", "text").mapInArrow(_linked(models, to_arrow_type(id_type), chunk), f"chunk bigint, doc_id {name}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, places binary, times binary, pairs array<bigint>, pair_n array<bigint>")
    linked = materialise(linked)
    lists = linked.where("pairs IS NOT NULL").select(F.col("chunk").alias("own"), F.posexplode(F.arrays_zip("pairs", "pair_n")).alias("place", "x")).select("own", "place", F.col("x.pairs").alias("pair"), F.col("x.pair_n").alias("n"))
    counts = lists.groupBy("pair").agg(F.sum("n").alias("count"))
    counts = materialise(counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(F.col("pair") % n_b))))  # a window holds one B id's pairs, at most A's vocabulary
    known = lists.select("own", "place", "pair").join(counts, "pair").select("own", "place", "count", "best")

    def meet(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        place = pairs.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy()
        n_best, sums = [], []
        for places, times in zip(rows.column("places").to_pylist(), rows.column("times").to_pylist(), strict=True):
            at, n = np.cumsum(_unpacked(places)), _unpacked(times)
            n_best.append(int(n @ best[at]))
            sums.append(int(n @ count[at]))
        return rows.select(["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    rows = linked.where("pairs IS NULL").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "places", "times")
    met = rows.groupBy("chunk").cogroup(known.groupBy("own")).applyInArrow(meet, f"doc_id {name}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, n_best bigint, count_sum bigint")
    out = materialise(met.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256"))
    discard(linked, counts)
    return out


def default_models() -> Models:
    import public_tokenizers

    return models_of(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), default_models())


QUERIES = {"op12_token_alignment": op12_token_alignment}
