"""Cutting byte spans out of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftline.llm.common import materialise, prepare, row_key, unpacked, whole


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs that half-open spans cover."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1]])
    return list(zip(starts[first].tolist(), np.r_[ends[first[1:] - 1], ends[-1]].tolist(), strict=True)) if len(starts) else []


def cut_rows(docs: DataFrame, spans: DataFrame, columns: list[str], as_text: bool = False, least: int = 0) -> DataFrame:
    """kept_row (a struct of the columns), n_bytes, n_removed, n_spans and kept, for every row of docs; spans: rid, doc, starts, ends (arrays), one row per row_key and doc_id. What is kept is binary, or text without letters that a cut splits. Runs under the least bytes stay, but for whole texts."""
    prepare(docs.sparkSession)
    rows = docs.select(whole(docs, columns).alias("kept_row"), row_key().alias("rid"), F.col("doc_id").alias("doc"), F.col("text").alias("whole_text"))
    joined = rows.join(spans, ["rid", "doc"], "left")  # Spark broadcasts by its own threshold, else shuffles both sides
    kind = pa.string() if as_text else pa.binary()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, count, kept = [], [], [], []
            for text, starts, ends in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                data = (text.as_py() or "").encode("utf-8")
                runs = merged(np.array(starts.values), np.array(ends.values)) if starts.is_valid else []
                runs = [(a, b) for a, b in runs if b - a >= min(least, len(data))]
                at, pieces = 0, []
                for a, b in runs:
                    pieces.append(data[at:a])
                    at = b
                pieces.append(data[at:])
                rest = b"".join(pieces)
                n.append(len(data))
                gone.append(len(data) - len(rest))
                count.append(len(runs))
                kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, kind)], ["kept_row", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = rows.select("kept_row").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "string" if as_text else "binary")
    return joined.select("kept_row", "whole_text", "starts", "ends").mapInArrow(apply, schema)


def cut(docs: DataFrame, spans: DataFrame, keep: list[str], least: int = 0) -> DataFrame:
    """The kept columns with n_bytes, n_removed, n_spans, kept (binary), for every row of docs."""
    return cut_rows(docs, spans, keep, least=least).select(*unpacked("kept_row", keep), "n_bytes", "n_removed", "n_spans", "kept")


def cut_texts(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The columns of docs with what is left of each text, and n_chars, if there, of that; rows of which nothing is left go."""
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return cut_rows(docs, spans, docs.columns, True).where(F.col("kept") != "").select(*(new[c].alias(c) if c in new else F.col(f"kept_row.`{c}`") for c in docs.columns))


def digest_columns(cut_rows: DataFrame) -> DataFrame:
    return cut_rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def by_text(rid: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list, list, list, list]:
    """Spans as one row for each text, merged. A text is known by its key and its doc_id together."""
    order = np.lexsort((doc, rid))
    rid, doc, start, end = rid[order], doc[order], start[order], end[order]
    edge = np.r_[np.flatnonzero(np.r_[True, (rid[1:] != rid[:-1]) | (doc[1:] != doc[:-1])]), len(rid)] if len(rid) else np.zeros(1, np.int64)
    runs = [merged(start[i:j], end[i:j]) for i, j in zip(edge[:-1], edge[1:], strict=True)]
    return rid[edge[:-1]].tolist(), doc[edge[:-1]].tolist(), [[a for a, _ in r] for r in runs], [[b for _, b in r] for r in runs]


def whole_keys(batches: Iterator[pa.RecordBatch], rows: int = 1 << 18) -> Iterator[list[np.ndarray]]:
    """The columns of rows that are sorted by the first, in pieces of about so many rows; no key lies in two pieces."""
    held: list[list[np.ndarray]] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([np.array(c) for c in batch.columns])
        n += batch.num_rows
        if n >= rows and (held[0][0][0] != held[-1][0][-1]):
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            last = int(np.searchsorted(columns[0], columns[0][-1]))
            yield [c[:last] for c in columns]
            held = [[c[last:] for c in columns]]
            n = len(held[0][0])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def whole_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of one key, the first column, at a time; rows are sorted by it. A row is given as the values of its other columns."""
    held: list[tuple] = []
    key = None
    for batch in batches:
        for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and k != key:
                yield held
                held = []
            key = k
            held.append(tuple(row))
    if held:
        yield held


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("rid", pa.int64()), ("doc", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
    for columns in whole_keys(batches):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(by_text(*columns), schema, strict=True)], schema=schema)


def gather(pieces: DataFrame, parts: int) -> DataFrame:
    """Rows of rid, doc, start, end -> rid, doc, starts, ends: one for each text, merged, written to the shared folder. A task takes the spans of its texts in order of rid."""
    return materialise(pieces.repartition(parts, "rid").sortWithinPartitions("rid").mapInArrow(_together, "rid bigint, doc bigint, starts array<int>, ends array<int>"))


#: Text bytes for each partition of what is made of the texts; partitions at most, as a shuffle has so many times the tasks before it pieces.
PART_BYTES, MOST_PARTS = 32 << 20, 50_000


def sizes(docs: DataFrame, bucket_bytes: int) -> tuple[int, int]:
    """How many buckets of so many text bytes, and partitions."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(1, -(-total // bucket_bytes)), min(MOST_PARTS, max(1, -(-total // PART_BYTES)))
