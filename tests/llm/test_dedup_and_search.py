"""Dedup and search against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from liftline.llm import chunk_dedup, components, exact_search, learned_partitions, registry, simhash_dedup, spans, suffix_dedup

DOCS = "doc_id bigint, text string, rid string, start string, kept string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], DOCS)


def _random_docs(n, seed, alphabet="ab é", passages=6):
    rng = np.random.default_rng(seed)
    word = lambda k: "".join(rng.choice(list(alphabet), k))
    shared = [word(int(k)) for k in rng.integers(40, 160, passages)]
    out = []
    for i in range(n):
        parts = [word(int(rng.integers(0, 70))) + (shared[int(rng.integers(passages))] if rng.random() < 0.7 else "") for _ in range(3)]
        out.append((int(rng.integers(0, 10_000)) if i % 9 else i, "".join(parts)))
    return out


EDGES = [(None, "x" * 200), (1, None), (2, ""), (3, "x" * 200), (3, "x" * 200), (4, "x" * 49), (5, "x" * 50), (5, "y" * 20 + "x" * 60), (-7, "中" * 40), (9, "中" * 40)]


# suffix intervals


def _suffix_brute(rows, least=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - least + 1) if d is not None else ():
            w = b[i : i + least]
            first[w] = min(d, first.get(w, d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - least + 1) if d is not None else ():
            if first[b[i : i + least]] < d:
                gone[i : i + least] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((d, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return out


def _digests(df):
    return sorted(map(tuple, spans.digest_columns(df).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_by_brute_force(spark, seed):
    rows = _random_docs(60, seed) + EDGES
    assert _digests(suffix_dedup.dedup(_docs(spark, rows), ["doc_id"])) == sorted(_suffix_brute(rows), key=str)


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.dedup(_docs(spark, EDGES).limit(0), ["doc_id"]).count() == 0


def test_suffix_query_by_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, registry.QUERIES["op6_suffix_dedup"](spark, small).collect()), key=str)
    assert got == sorted(_suffix_brute(rows), key=str)


def test_intervals_by_brute_force():
    rng = np.random.default_rng(4)
    codes = np.r_[rng.integers(1, 3, 400), 0].astype(np.uint8)
    for depth in (1, 2, 5, 9, 17):
        sa, number = suffix_dedup.bounded_intervals(codes, depth)
        assert sorted(sa) == list(range(len(codes)))
        heads = [codes[i : i + depth].tobytes() for i in sa]
        for k in range(1, len(sa)):
            whole = sa[k] + depth <= len(codes) and sa[k - 1] + depth <= len(codes)
            assert (number[k] == number[k - 1]) == (heads[k] == heads[k - 1] and whole)


# chunks


def _chunk_brute(rows, least=chunk_dedup.MIN_RUN):
    seen, out = {}, {}
    key = lambda r: (r[0], xxhash.xxh64_intdigest((r[1] or "").encode()))
    order = sorted({r for r in rows if r[0] is not None and r[1]}, key=key)
    for d, t in order:
        b, at, h, hashes = t.encode(), 0, 0, []
        for x in b:
            h = ((h << 1) + int(chunk_dedup._GEAR[x])) & 0xFFFF
            hashes.append(h)
        r = chunk_dedup.RADIUS
        cuts = [i + 1 for i in range(r, len(b) - r) if hashes[i] == max(hashes[i - r : i + r + 1])]
        if not cuts or cuts[-1] != len(b):
            cuts.append(len(b))
        runs = []  # repeated or not, bytes
        for e in cuts:
            c = b[at:e]
            again = c in seen
            seen.setdefault(c, d)
            if runs and runs[-1][0] == again:
                runs[-1][1] += c
            else:
                runs.append([again, c])
            at = e
        out[d, t] = b"".join(x for again, x in runs if not again or len(x) < least and x != b)
    return [(d, len((t or "").encode()), hashlib.sha256(out.get((d, t), (t or "").encode())).hexdigest()) for d, t in rows]


def test_chunk_dedup_by_brute_force(spark):
    rows = list({d: (d, t) for d, t in _random_docs(60, 3, "abcdefgh ")}.values()) + [(None, "x" * 200), (20_001, None), (20_002, ""), (20_003, "tail")]
    rows += [rows[5], rows[5]]
    got = sorted(((r.doc_id, r.n_bytes, r.kept_sha256) for r in spans.digest_columns(chunk_dedup.dedup(_docs(spark, rows), ["doc_id"])).collect()), key=str)
    assert got == sorted(_chunk_brute(rows), key=str)
    got = sorted(((r.doc_id, r.n_bytes, r.kept_sha256) for r in spans.digest_columns(chunk_dedup.dedup(_docs(spark, rows), ["doc_id"], 0)).collect()), key=str)
    assert got == sorted(_chunk_brute(rows, 0), key=str)
    assert chunk_dedup.dedup(_docs(spark, rows).limit(0), ["doc_id"]).count() == 0


def test_texts_with_equal_keys_keep_their_own_spans(spark, monkeypatch):
    for module in (chunk_dedup, spans):
        monkeypatch.setattr(module, "row_key", lambda: F.lit(7).cast("long"))
    rows = list({d: (d, t) for d, t in _random_docs(60, 3, "abcdefgh ")}.values())
    got = sorted((r.doc_id, r.n_bytes, r.kept_sha256) for r in spans.digest_columns(chunk_dedup.dedup(_docs(spark, rows), ["doc_id"])).collect())
    assert got == sorted(_chunk_brute(rows))


def test_cuts_resist_insertions():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 123, 5000).astype(np.uint8)
    moved = np.r_[data[:1000], rng.integers(97, 123, 7).astype(np.uint8), data[1000:]]
    a, b = set(chunk_dedup.boundaries(data).tolist()), {x - 7 for x in chunk_dedup.boundaries(moved).tolist() if x > 1100}
    assert {x for x in a if x > 1100} == b
    assert list(chunk_dedup.boundaries(np.zeros(0, np.uint8))) == [0]


def test_long_passages_are_caught(spark):
    rng = np.random.default_rng(6)
    words = lambda k: " ".join("".join(rng.choice(list("abcdefghijklmnop"), int(n))) for n in rng.integers(2, 9, k))
    passage = [words(55) for _ in range(40)]
    rows = [(i, words(40) + " " + passage[i // 2] + " " + words(40)) for i in range(80)] + [(100 + i, words(100)) for i in range(40)]
    out = {r.doc_id: r.n_removed for r in chunk_dedup.dedup(_docs(spark, rows), ["doc_id"]).collect()}
    assert all(out[i] > 0 for i in range(1, 80, 2)) and not any(out[i] for i in range(0, 80, 2)) and not any(out[100 + i] for i in range(40))


def test_copies_of_periodic_and_short_texts_go(spark):
    rng = np.random.default_rng(7)
    word = lambda k: "".join(rng.choice(list("abcdefghijklmnop"), k))
    texts = ["buy now " * 500, "-" * 5000, " " * 3000, "0123456789" * 77, "a" * 49, word(300) + "=" * 2000 + word(300), "tail", "é"]
    rows = [(10 * i + k, t) for i, t in enumerate(texts) for k in range(3)] + [(None, "tail"), (None, "-" * 5000), (1000, "tai"), (1001, word(90) + "tail")]
    out = {r.doc_id: (r.n_removed, r.n_bytes) for r in chunk_dedup.dedup(_docs(spark, rows), ["doc_id"]).where("doc_id IS NOT NULL").collect()}
    assert all(out[10 * i + k] == (len(t.encode()),) * 2 for i, t in enumerate(texts) for k in (1, 2))
    assert out[1000][0] == 0 and out[1001][0] == 0 and out[60][0] == 0 and out[70][0] == 0
    passage = "=" * 3000 + word(200)  # within other texts the passage goes but for its ends
    two = {r.doc_id: r.n_removed for r in chunk_dedup.dedup(_docs(spark, [(i, word(100) + passage + word(100)) for i in range(2)]), ["doc_id"]).collect()}
    assert two[1] > 2400
    for t in texts:
        sizes = np.diff(np.r_[0, chunk_dedup.boundaries(np.frombuffer(t.encode(), np.uint8))])
        assert sizes.sum() == len(t.encode()) and (len(sizes) == 1 or sizes.min() >= chunk_dedup.MIN_BYTES) and sizes.max() < chunk_dedup.MAX_BYTES + chunk_dedup.MIN_BYTES


# SimHash


def _components_brute(fps, distance):
    ids = sorted(fps)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def _fp_brute(text, words=4):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))


def test_simhash_query_by_brute_force(spark, small):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    fps = {d: _fp_brute(t) for d, t in rows.items()}
    want = _components_brute(fps, 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.QUERIES["op4_simhash_dedup"](spark, small).collect()}
    assert got == {d: (f"{fps[d]:016x}", want[d]) for d in rows}


def test_simhash_edges(spark):
    rows = [(None, "a b c d e"), (5, "A b  c d e"), (3, "a b c d e"), (3, "a b c d e"), (8, None), (7, " "), (9, "one"), (None, "nobody else")]
    got = [(r.doc_id, r.fp, r.component_id) for r in simhash_dedup.near_duplicates(_docs(spark, rows)).collect()]
    by = {}
    for d, f, c in got:
        by.setdefault(d, set()).add((f, c))
    assert len(got) == len(rows) and {c for _, c in by[5] | by[3]} == {3} and by[8] == by[7] == {(0, 7)}
    assert {c for _, c in by[None]} == {3, None}
    prints = [(d, b) for d, b in ((9, 0b1), (None, 0b11111), (12, 0b111111111), (None, 0xFFF << 40))]
    was, simhash_dedup.fingerprints = simhash_dedup.fingerprints, lambda docs, words: docs.selectExpr("doc_id", "CAST(text AS bigint) AS fp")
    try:  # a row without an id bridges two documents
        linked = simhash_dedup.near_duplicates(_docs(spark, [(d, str(b)) for d, b in prints])).collect()
    finally:
        simhash_dedup.fingerprints = was
    assert {(r.doc_id, r.fp): r.component_id for r in linked} == {(9, 1): 9, (None, 31): 9, (12, 511): 9, (None, 0xFFF << 40): None}
    assert simhash_dedup.near_duplicates(_docs(spark, rows).limit(0)).count() == 0


def test_large_anchors_are_dealt_over_a_grid(spark, monkeypatch):
    rng = np.random.default_rng(12)
    fps = {}
    for d in range(300):  # many within few bits of each other, so that they share anchors
        base = int(rng.integers(0, 3)) * 0x0123456789ABCDEF % (1 << 63)
        for b in rng.choice(63, int(rng.integers(0, 7)), replace=False):
            base ^= 1 << int(b)
        fps[d] = base
    monkeypatch.setattr(simhash_dedup, "fingerprints", lambda docs, words: docs.selectExpr("doc_id", "CAST(text AS bigint) AS fp"))
    docs = _docs(spark, [(d, str(f)) for d, f in fps.items()])
    want = _components_brute(fps, 4)
    for homes, members in ((1 << 14, 1 << 17), (3, 10)):
        monkeypatch.setattr(simhash_dedup, "_HOMES", homes)
        monkeypatch.setattr(simhash_dedup, "_VISITORS", members)
        monkeypatch.setattr(simhash_dedup, "_SAMPLE", 1)
        assert {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(docs).collect()} == want
    led = docs.selectExpr("CAST(text AS bigint) AS fp", "CAST(text AS bigint) AS lead").distinct()
    replicate = lambda x: x.mapInArrow(simhash_dedup._replicate(4), simhash_dedup._COPIES)
    assert simhash_dedup._large(led, replicate).agg({"across": "max"}).first()[0] > 3
    cells = simhash_dedup._dealt(led, replicate).groupBy("anchor").count().agg({"count": "max"}).first()[0]
    assert cells < replicate(led).groupBy("anchor").count().agg({"count": "max"}).first()[0] / 2


@pytest.mark.parametrize("distance", [4, 9])
def test_anchors_cover(distance):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 300).astype(np.uint64)
    y = x.copy()
    for k in range(len(y)):
        for b in rng.choice(64, distance, replace=False):
            y[k] ^= np.uint64(1) << np.uint64(b)
    met = np.zeros(len(x), bool)
    for k, (first, bits) in enumerate(simhash_dedup._blocks(distance)):
        i, a, home = simhash_dedup.anchors(x, k, first, bits)
        j, b, _ = simhash_dedup.anchors(y, k, first, bits)
        assert len({*zip(i.tolist(), a.tolist(), strict=True)}) == len(i) and home.sum() == len(x)
        homes = dict(zip(i[home].tolist(), a[home].tolist(), strict=True))
        for p, q in zip(j.tolist(), b.tolist(), strict=True):
            met[p] |= homes[p] == q
    assert met.all()


def test_components_by_brute_force(spark):
    rng = np.random.default_rng(7)
    edges = {(int(max(a, b)), int(min(a, b))) for a, b in rng.integers(0, 300, (220, 2)) if a != b} | {(k + 1, k) for k in range(1000, 1060)}
    up = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(up[a], up[b])
            changed |= up[a] != m or up[b] != m
            up[a] = up[b] = m
    got = {r.node: r.root for r in components.stars(spark.createDataFrame(list(edges), "node bigint, root bigint")).collect()}
    assert got == {x: m for x, m in up.items() if x != m}
    assert components.stars(spark.createDataFrame([], "node bigint, root bigint")).count() == 0


def test_pairs_in_pieces(monkeypatch):
    monkeypatch.setattr(simhash_dedup, "_PAIRS", 5)
    sizes, home = np.array([3, 1, 4]), np.array([1, 0, 1, 1, 0, 1, 1, 0], bool)
    got = sorted((int(a), int(b)) for x, y in simhash_dedup._pairs(sizes, home) for a, b in zip(x, y, strict=True))
    want = sorted((a, b) for lo, hi in ((0, 3), (3, 4), (4, 8)) for a in range(lo, hi) if home[a] for b in range(lo, hi))
    assert got == want


def test_similar_documents_are_found(spark):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnoprstu"), int(n))) for n in rng.integers(2, 9, 4000)]
    base = [list(rng.choice(vocabulary, 250)) for _ in range(60)]
    rows = []
    for i, words in enumerate(base):
        rows.append((10 * i, " ".join(words)))
        near = list(words)
        near[int(rng.integers(250))] = "changed"
        near[int(rng.integers(250))] = "altered"
        rows.append((10 * i + 1, " ".join(near)))  # about ten of 246 shingles differ
        rows.append((10 * i + 2, " ".join(rng.permutation(words))))  # the same words in another order are no copy
    got = {r.doc_id: r.component_id for r in simhash_dedup.similar(_docs(spark, rows)).collect()}
    assert np.mean([got[10 * i + 1] == 10 * i for i in range(60)]) > 0.95
    assert all(got[10 * i + 2] == 10 * i + 2 and got[10 * i] == 10 * i for i in range(60))

def _jaccard(a, b, k=5):
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def _copies(rng, low, high, n, kinds=("append", "block", "scatter"), sizes=(60, 400)):
    """Rows of pairs (id, id + 1) of a text and a copy with a similarity from low to high, by appended text, a replaced block or single words."""
    word = lambda k: ["".join(rng.choice(list("abcdefghijklmnopqrst"), 7)) for _ in range(k)]
    rows = []
    while len(rows) < 2 * n:
        w = word(int(rng.integers(*sizes)))
        kind, change = kinds[len(rows) // 2 % len(kinds)], rng.uniform(0.02, 0.35)
        m = max(1, int(change * len(w)))
        if kind == "append":
            c = w + word(m)
        elif kind == "block":
            at = int(rng.integers(0, len(w) - m + 1))
            c = w[:at] + word(m) + w[at + m :]
        else:
            c = list(w)
            for i in rng.choice(len(w), max(1, m // 5), replace=False):
                c[i] = word(1)[0]
        a, b = " ".join(w), " ".join(c)
        if low <= _jaccard(a, b) < high:
            rows += [(len(rows), a), (len(rows) + 1, b)]
    return rows


def test_similarity_is_decided_by_the_sets(spark):
    rng = np.random.default_rng(31)
    rows = _copies(rng, 0.7, 0.8, 150, sizes=(30, 120))
    got = {r.doc_id: r.component_id for r in simhash_dedup.similar(_docs(spark, rows)).collect()}
    assert got == {i: i for i, _ in rows}
    assert simhash_dedup._jaccard(np.arange(4, dtype=np.uint64), np.arange(5, dtype=np.uint64)) == 0.8


@pytest.mark.parametrize("kind", ["append", "block", "scatter"])
def test_copies_from_080_to_090_are_found(spark, kind):
    rows = _copies(np.random.default_rng(32), 0.8, 0.9, 400, (kind,))
    rows += [(i + len(rows), t) for i, t in _copies(np.random.default_rng(33), 0.8, 0.82, 200, (kind,))]
    got = {r.doc_id: r.component_id for r in simhash_dedup.similar(_docs(spark, rows)).collect()}
    assert np.mean([got[i] == i - 1 for i in range(1, len(rows), 2)]) > 0.99
    assert all(got[i] == i for i in range(0, len(rows), 2))


# vectors


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


def _odd_vectors(n=300, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 1 + i % 7, dim))]) for i in range(n)]
    rows += [(n, rows[0][1]), (n + 1, rows[0][1]), (n + 2, [0.0] * dim), (n + 3, None), (n + 4, [float("nan")] * dim), (n + 5, [1.0, None] * (dim // 2)), (n + 6, [float("inf")] * dim), (None, rows[1][1]), (n + 10, []), (n + 11, []), (n + 12, [])]
    return rows


def test_exact_search_by_brute_force(spark):
    rows = _odd_vectors()
    df = _vectors(spark, rows)
    good = [(i, np.floor(256 * np.float64(v)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in good:
        if q % 10 == 0:
            top = sorted(((-int(a @ b), i) for i, b in good if i != q and len(a) == len(b)))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(top)]
    got = sorted(map(tuple, exact_search.search(df, df.where("vec_id % 10 = 0")).collect()))
    assert got == sorted(want)
    few = _vectors(spark, rows[:3])
    assert exact_search.search(few, few.where("vec_id = 0")).count() == 2
    assert exact_search.search(df.limit(0), df.limit(0)).count() == 0
    hollow = _vectors(spark, [(0, []), (5, []), (10, []), (3, None)])
    assert sorted(map(tuple, exact_search.search(hollow, hollow.where("vec_id % 10 = 0")).collect())) == [(0, 1, 5, 0), (0, 2, 10, 0), (10, 1, 0, 0), (10, 2, 5, 0)]


def test_exact_search_sends_blocks_no_further_than_they_reach(spark, monkeypatch):
    rng = np.random.default_rng(13)
    length = 2.0 ** rng.integers(-6, 6, 2000)
    data = rng.normal(0, 1, (2000, 8)) * length[:, None]
    df = _vectors(spark, list(enumerate(data.tolist())))
    monkeypatch.setattr(exact_search, "BUCKET", 50)
    monkeypatch.setattr(exact_search, "HEAD", 200)
    sent = []
    dealt = exact_search._dealt
    monkeypatch.setattr(exact_search, "_dealt", lambda a, b: sent.append((a.count() * b.count(), *dealt(a, b))) or sent[-1][1:])
    got = sorted(map(tuple, exact_search.search(df, df.where("vec_id % 10 = 0")).collect()))
    e = np.floor(256 * data).astype(int)
    want = []
    for q in range(0, 2000, 10):
        s = e @ e[q]
        other = np.delete(np.arange(2000), q)
        top = other[np.lexsort((other, -s[other]))[:5]]
        want += [(q, k + 1, int(i), int(s[i])) for k, i in enumerate(top)]
    assert got == sorted(want)
    full, left, right = sent[0]
    assert left.join(right, (left.shell == right.q_shell) & (left.slot == right.q_slot)).count() < full / 2


def test_exact_search_prunes_without_loss():
    rng = np.random.default_rng(9)
    centre = rng.normal(0, 100, 16)
    data = np.floor(centre + rng.normal(0, 20, (400, 16)))
    bucket, plain = exact_search._Bucket(np.arange(400), data), data
    for q in range(0, 400, 20):
        scores = plain @ plain[q]
        bound = np.sort(np.delete(scores, q))[-5]
        near = bucket.near(plain[q], float(np.sqrt(plain[q] @ plain[q])), float(bound))
        ids, _ = bucket.top(q, plain[q], float(bound), 5)
        other = np.delete(np.arange(400), q)
        assert list(ids) == list(other[np.lexsort((other, -scores[other]))[:5]])
        assert near is None or len(near) <= 400


def test_exact_search_gathers_no_block_for_a_join(spark):
    rng = np.random.default_rng(21)
    df = _vectors(spark, list(enumerate(rng.normal(0, 1, (500, 8)).tolist())))
    plan = exact_search.search(df, df.where("vec_id % 10 = 0"))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan and "MapInArrow" in plan


def test_exact_search_in_many_cells(spark, monkeypatch):
    for name, value in {"BUCKET": 20, "PACKED": 1, "HEAD": 30, "QUERIES": 4, "CELL": 1, "SHELLS": 6, "GROUP": 600}.items():
        monkeypatch.setattr(exact_search, name, value)
    groups, dealt = [], exact_search._dealt
    monkeypatch.setattr(exact_search, "_dealt", lambda a, b: (x := dealt(a, b)) and (groups.append((x[1].select("q_group").distinct().count(), x[1].select("q_slot").distinct().count())) or x))
    rows = _odd_vectors(260)
    rows += [(2000 + i, rows[i % 20][1]) for i in range(60)] + [(3000 + i, [float(i), -1.0, 2.0]) for i in range(40)] + [(10, rows[11][1]), (20, rows[20][1])]
    df = _vectors(spark, rows)
    good = [(i, np.floor(256 * np.float64(v)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    by = {}
    for q, a in good:
        if q % 10 == 0:
            by.setdefault(q, []).extend((-int(a @ b), i) for i, b in good if i != q and len(a) == len(b))
    want = [(q, k + 1, i, -s) for q, found in by.items() for k, (s, i) in enumerate(sorted(found)[:5])]
    assert sorted(map(tuple, exact_search.search(df, df.where("vec_id % 10 = 0")).collect())) == sorted(want)
    assert groups[0][0] > 2 and groups[0][1] > 1


@pytest.mark.parametrize("scale", [1, 100, 10**5, 10**6])
@pytest.mark.parametrize("spread", [0.02, 1.0, 50.0])
def test_exact_search_keeps_the_best_of_all_buckets(scale, spread, monkeypatch):
    monkeypatch.setattr(exact_search, "QUERIES", 16)
    rng = np.random.default_rng(4)
    data = np.floor(scale * (rng.normal(0, 3, 12) + spread * rng.normal(0, 1, (600, 12))))
    data[300:330], data[400:410] = data[7], 0
    ids = rng.permutation(700)[:600]
    ids[550:560] = ids[5]
    data[np.r_[0:60:4], np.r_[0:60:4] % 12] += np.ceil(40 * scale * spread)  # these and their near copies point along one coordinate
    data[500:515] = data[0:60:4] + 1
    asked = np.r_[0:120, 300:310, 400:402, 550:553]
    whole = data.astype(np.int64).astype(object)
    narrow, used = exact_search._Best._narrow, []
    monkeypatch.setattr(exact_search._Best, "_narrow", lambda self, *a: used.append(narrow(self, *a)) or used[-1])
    for first in (-np.inf, None):
        want = []
        bounds = np.full(len(asked), -np.inf)
        for n, q in enumerate(asked.tolist()):
            best = sorted((-int(whole[i] @ whole[q]), int(ids[i])) for i in range(600) if ids[i] != ids[q])[:5]
            want += [(int(ids[q]), i, -s) for s, i in best]
            bounds[n] = -best[-1][0] if first is None else first
        met = exact_search._Best(ids[asked], data[asked], bounds, 5)
        for k in range(0, 600, 150):
            met.meet(exact_search._Bucket(ids[k : k + 150], data[k : k + 150]))
        assert sorted(zip(*(x.tolist() for x in met.rows()), strict=True)) == sorted(want)
    assert spread != 1.0 or scale == 1 or any(few.any() for few, _, _ in used)


def test_learned_partitions_recall(spark, small):
    got = registry.QUERIES["op8_learned_partitions"](spark, small).toPandas()
    v = spark.read.parquet(f"{small}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.array(v.embedding.tolist(), np.float64), v.vec_id.to_numpy()
    found = total = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        other = ids[ids != q]
        best = other[np.lexsort((other, -s[other]))[:20]]
        found, total = found + len(set(best) & set(g.vec_id)), total + 20
        assert np.allclose(g.score, s[g.vec_id], atol=1e-12) and list(g["rank"]) == list(range(1, len(g) + 1))
    assert got.query_id.nunique() == (ids % 20 == 0).sum() and found / total >= 0.9


def test_learned_partitions_edges(spark):
    df = _vectors(spark, _odd_vectors(60))
    got = learned_partitions.search(df, df.where("vec_id % 20 = 0")).toPandas()
    assert not set(got.vec_id) & {62, 63, 64, 65, 66} and not (got.query_id == got.vec_id).any() and got.vec_id.notna().all()
    assert learned_partitions.search(df.limit(0), df.limit(0)).count() == 0
    two = _vectors(spark, [(0, [1.0, 0.0]), (20, [0.5, 0.5])])
    assert [tuple(r) for r in learned_partitions.search(two, two).orderBy("query_id").collect()] == [(0, 1, 20, 0.5), (20, 1, 0, 0.5)]


def test_learned_partitions_of_every_dimension(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 1, d)]) for i, d in enumerate([6] * 400 + [5] * 300 + [2] * 30 + [1] * 1)]
    df = _vectors(spark, rows)
    got = learned_partitions.search(df, df.where("vec_id % 10 = 0"), k=5).toPandas()
    found = total = 0
    for q, v in rows:
        if q % 10 == 0:
            near = sorted((-float(np.float32(v).astype(float) @ np.float32(w).astype(float)), i) for i, w in rows if i != q and len(w) == len(v))[:5]
            own = got[got.query_id == q]
            assert len(own) == len(near)
            found, total = found + len({i for _, i in near} & set(own.vec_id)), total + len(near)
            if len(v) == 2:  # no router: all are compared
                assert [i for _, i in near] == own.sort_values("rank").vec_id.tolist()
    assert found / total >= 0.9


def test_parts_are_balanced():
    x = np.random.default_rng(3).normal(0, 1, (800, 6))
    part = learned_partitions.balanced_parts(learned_partitions.neighbours(x, 8), x, 8)
    assert np.bincount(part, minlength=8).max() <= 111 and len(pd.unique(part)) == 8
