"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is bound by
multiplying its letters' vectors, each rotated by its place; a text is the sum
(bundle) of its trigrams; a language's prototype is the bundle of all its
training texts. A text gets the language of the prototype with the highest
cosine, and that cosine, cut to [0, 1], as its score.

Vectors are made from a hash of the code point and sums are whole numbers, so
results do not depend on partitioning or reruns.

Defined results: null text, or text without a letter, is ``und`` with score 0;
so is every text when nothing could be learned; ties between languages fall to
the first by name; texts are used whole (long ones in pieces that overlap by
two letters); null lang rows are not learned from; repeated rows count again;
an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftline.llm.common import prepare, table, unpacked, whole

UNKNOWN = "und"
#: Components of a vector.
DIM = 2048
#: At most about so many labelled rows are learned from, picked by a hash of the text; prototypes gain nothing from more.
TRAIN_ROWS = 100_000
_SPACE, _PIECE, _BATCH, _SLICE = 32, 1 << 18, 1 << 18, 4096
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def letter_vectors(codes: np.ndarray, dim: int = DIM) -> np.ndarray:
    """A row of +1 and -1 for each code point: the bits of a 64-bit mix of the code and the word's number."""
    with np.errstate(over="ignore"):
        x = codes.astype(np.uint64)[:, None] * np.uint64(0xD1342543DE82EF95) + np.arange(1, dim // 64 + 1, dtype=np.uint64)[None, :] * _MIX[0]
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        x ^= x >> np.uint64(31)
    return (np.unpackbits(x.view(np.uint8), axis=1).astype(np.int8) * 2 - 1).reshape(len(codes), dim)


def trigrams(text: str) -> np.ndarray:
    """The letter trigrams of a text as packed code points; runs of other characters count as one space, as do both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = _letters()[codes]
    if not is_letter.any():
        return np.empty(0, np.uint64)
    x = np.full(len(codes) + 2, _SPACE, np.uint64)
    x[1:-1] = np.where(is_letter, codes, _SPACE)
    space = x == _SPACE
    keep = ~space
    keep[0] = True
    keep[1:] |= ~space[:-1]
    x = x[keep]
    return (x[:-2] << np.uint64(42)) | (x[1:-1] << np.uint64(21)) | x[2:]


def bundle(grams: np.ndarray, owner: np.ndarray, n: int, dim: int = DIM) -> np.ndarray:
    """The sums of the trigrams' vectors by owner (0 to n - 1), as whole numbers in float64."""
    distinct, at = np.unique(grams, return_inverse=True)
    counts = np.bincount(owner * len(distinct) + at, minlength=n * len(distinct)).reshape(n, len(distinct)).astype(np.float32)
    out = np.zeros((n, dim))
    low = np.uint64((1 << 21) - 1)
    for k in range(0, len(distinct), _SLICE):
        g = distinct[k : k + _SLICE]
        letters, where = np.unique(np.stack([g >> np.uint64(42), (g >> np.uint64(21)) & low, g & low]), return_inverse=True)
        v = letter_vectors(letters, dim)
        a, b, c = where.reshape(3, -1)
        bound = np.roll(v, 2, axis=1)[a]
        bound *= np.roll(v, 1, axis=1)[b]
        bound *= v[c]
        out += counts[:, k : k + _SLICE] @ bound.astype(np.float32)
    return out


def _groups(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Row numbers, and their trigrams with owners (numbers into those rows), for rows with letters; a long text comes in pieces."""
    rows: list[int] = []
    grams: list[np.ndarray] = []
    size = 0
    for i, text in enumerate(texts):
        g = trigrams(text) if text else np.empty(0, np.uint64)
        for k in range(0, len(g), _PIECE):
            rows.append(i)
            grams.append(g[k : k + _PIECE])
            size += len(grams[-1])
            if size >= _BATCH or len(rows) >= 64:
                yield rows, np.concatenate(grams), np.repeat(np.arange(len(rows)), [len(x) for x in grams])
                rows, grams, size = [], [], 0
    if rows:
        yield rows, np.concatenate(grams), np.repeat(np.arange(len(rows)), [len(x) for x in grams])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text -> one bundle per language of a partition."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for rows, grams, owner in _groups(texts):
            names = sorted({langs[i] for i in rows})
            number = {x: k for k, x in enumerate(names)}
            by_lang = np.array([number[langs[i]] for i in rows])
            for x, v in zip(names, bundle(grams, by_lang[owner], len(names)), strict=True):
                sums[x] = sums.get(x, 0) + v
    if sums:
        yield pa.RecordBatch.from_pydict({"lang": list(sums), "vector": [v.astype(np.int64) for v in sums.values()]}, pa.schema([("lang", pa.string()), ("vector", pa.list_(pa.int64()))]))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bundles of several partitions, by language."""
    sums: dict[str, np.ndarray] = {}
    schema = None
    for batch in batches:
        schema = batch.schema
        for x, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[x] = sums.get(x, 0) + np.array(v, np.int64)
    if schema is not None:
        yield pa.RecordBatch.from_pydict({"lang": list(sums), "vector": list(sums.values())}, schema)


def learn(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    """Prototypes from (lang, text) rows. The driver gets one vector per language and merging task, never rows."""
    prepare(labelled.sparkSession)
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = rows.count()
    if n > train_rows:
        rows = rows.where(F.shiftrightunsigned(F.xxhash64("text"), 11) < F.lit(int(train_rows / n * (1 << 53))))
    partial = rows.select("lang", "text").mapInArrow(_partial, "lang string, vector array<bigint>")
    sums: dict[str, np.ndarray] = {}
    for lang, vector in partial.repartition(8).mapInArrow(_merge, "lang string, vector array<bigint>").collect():
        sums[lang] = sums.get(lang, 0) + np.array(vector, np.float64)
    return {x: v / np.linalg.norm(v) for x, v in sorted(sums.items()) if v.any()}


def judged(docs: DataFrame, prototypes: dict[str, np.ndarray], columns: list[str]) -> DataFrame:
    """kept_row (a struct of the columns), lang_pred and score; the text is the column ``text``."""
    prepare(docs.sparkSession)
    names = list(prototypes)
    matrix = np.array(list(prototypes.values())).T if names else np.zeros((DIM, 0))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            carried: dict[int, np.ndarray] = {}
            for rows, grams, owner in _groups(texts) if names else ():
                vectors = bundle(grams, owner, len(rows))
                for k, i in enumerate(rows):
                    carried[i] = carried[i] + vectors[k] if i in carried else vectors[k]
                last = rows[-1]  # may go on in the next group
                done = [i for i in carried if i != last]
                _judge(done, carried, matrix, names, best, score)
            _judge(list(carried), carried, matrix, names, best, score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score)], ["kept_row", "lang_pred", "score"])

    rows = docs.select(whole(docs, columns).alias("kept_row"), F.col("text").alias("whole_text"))
    return rows.mapInArrow(apply, rows.select("kept_row").schema.add("lang_pred", "string").add("score", "double"))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str]) -> DataFrame:
    """The kept columns with lang_pred and score."""
    return judged(docs, prototypes, keep).select(*unpacked("kept_row", keep), "lang_pred", "score")


def _judge(rows: list[int], carried: dict[int, np.ndarray], matrix: np.ndarray, names: list[str], best: list[str], score: np.ndarray) -> None:
    if not rows:
        return
    v = np.array([carried.pop(i) for i in rows])
    cosine = (v @ matrix) / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
    top = cosine.argmax(axis=1)
    for k, i in enumerate(rows):
        best[i] = names[top[k]]
        score[i] = min(1.0, max(0.0, float(cosine[k, top[k]])))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = docs.withColumn("held_out", held_out)
    return predict(docs, learn(docs.where(~F.col("held_out"))), ["doc_id", "held_out"])


QUERIES = {"op1_language_id": op1_language_id}
