"""The pipeline's stages, each against what a plain computation keeps."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from liftline.llm import suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, small, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "12 -- 34", "en", "src0", 8), (9003, "", "en", None, 0)], docs.schema)
    docs = docs.unionByName(odd)
    out = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs.toPandas())
    return out


def test_columns(steps):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(list(s.columns) == COLUMNS for s in steps[:-1])
    assert list(steps[-1].columns) == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_languages_reject_only_what_has_no_letters(steps):
    assert set(steps[0].doc_id) - set(steps[1].doc_id) == {9001, 9002, 9003}
    assert steps[1].lang.notna().all()


def _shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_near_copies_go_and_others_stay(steps):
    before, after = steps[1], set(steps[2].doc_id)
    first = before.groupby("text").doc_id.min()
    assert not (set(before.doc_id) - set(first)) & after  # exact copies
    sets = {r.doc_id: _shingles(r.text) for r in before.itertuples()}
    ids = sorted(sets)
    close = {}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both:
                s = both / (len(sets[i]) + len(sets[j]) - both)
                close[i] = max(s, close.get(i, 0))
    assert all(i in after for i in ids if close.get(i, 0) < 0.6)
    high = [i for i in ids if 0.9 <= close.get(i, 0)]
    assert np.mean([i not in after for i in high]) > 0.9


def test_repeated_passages_go(spark, steps):
    before, after = steps[2].sort_values("doc_id"), steps[3].set_index("doc_id")
    first = {}
    for r in before.itertuples():
        b = r.text.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - suffix_dedup.MIN_BYTES + 1):
            if first.setdefault(b[i : i + suffix_dedup.MIN_BYTES], r.doc_id) < r.doc_id:
                gone[i : i + suffix_dedup.MIN_BYTES] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        if kept:
            assert after.text[r.doc_id] == kept.decode("utf-8", "ignore") and after.n_chars[r.doc_id] == len(after.text[r.doc_id])
        else:
            assert r.doc_id not in after.index


def test_mix_repeats_whole_documents(steps):
    before, after = steps[3], steps[4]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    copies = after.groupby("doc_id").size()
    assert copies.max() <= 2 and set(after.text) <= set(before.text)
    have, got = before.text.map(size).sum(), after.text.map(size).sum()
    assert abs(got - 1.5 * have) < 0.1 * have


def test_encoding_covers_every_copy(steps):
    assert sorted(steps[5].doc_id) == sorted(steps[4].doc_id) and (steps[5].n_tokens > 0).all()


def test_run_and_empty_tables(spark, small, tmp_path):
    empty = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_null_ids_pass(spark, small):
    docs = spark.createDataFrame([(None, "the cat and the dog " * 20, "en", "a", 1), (1, "the cat and the dog " * 20, "en", "a", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, small)
        assert docs.where(F.col("doc_id").isNull()).count() == 1


CLASHES = ["lang_pred", "score", "kept_row", "kept", "rid", "starts", "ends", "n_bytes", "n_removed", "n_spans", "whole_text", "mix_slope", "mix_before", "mix_id", "target", "taken", "position", "node", "component_id", "bits", "a.b"]


def test_clashing_columns_ties_repeats_and_long_texts(spark, small, tmp_path):
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrst"), 7))
    long = " ".join(word() for _ in range(400_000))  # 3.2 MB
    tied = [" ".join(word() for _ in range(40)) for _ in range(2)]
    rows = [(1, long), (2, long + " and a tail"), (3, tied[0]), (3, tied[0]), (4, tied[1]), (5, tied[1]), (None, tied[1]), (6, None), (7, "")]
    docs = spark.createDataFrame([(d, t, None, None if d == 3 else "s", 0, *["x"] * len(CLASHES)) for d, t in rows], ", ".join(["doc_id bigint", "text string", "lang string", "source string", "n_chars bigint", *(f"`{c}` string" for c in CLASHES)]))
    kept = []
    docs = docs.withColumn("lang", F.when(F.col("doc_id") < 5, "en"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        assert docs.where(" OR ".join(f"`{c}` IS NULL OR `{c}` <> 'x'" for c in CLASHES)).count() == 0
        kept.append(sorted((r.doc_id for r in docs.select("doc_id").collect()), key=str))
    assert kept[0] == [1, 2, 3, 3, 4, 5, None] and kept[1] == kept[2] == [1, 3, 3, 4, None]
    assert {d for d in kept[3]} <= {1, 3, 4, None} and kept[3].count(1) <= 2
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == len(kept[3])
