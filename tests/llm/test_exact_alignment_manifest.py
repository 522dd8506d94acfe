"""Exact dedup, token alignment and the manifest against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from liftline.llm import exact_dedup, merkle_manifest, registry, token_alignment

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, rep string, place string, tree string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, n, "clash", "clash", "clash") for i, t, lang, source, n in rows], DOCS)


def _plain(spark, texts, ids=None):
    return _docs(spark, [(i if ids is None else ids[i], t, "en", "s", 1) for i, t in enumerate(texts)])


def _random_texts(n, seed):
    r = random.Random(seed)
    stems = ["ab" * r.randint(1, 40), "中é " * 9, "", "a", "line\n" * 7, "the same long beginning " * 30]
    return [None if i % 17 == 0 else r.choice(stems) + r.choice(stems) * r.randint(0, 2) + r.choice("xyz") * r.randint(0, 2) for i in range(n)]


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op13_merkle_manifest"])
def test_oracles(spark, small, duck, same, name):
    same(registry.QUERIES[name](spark, small).toPandas(), duck.sql(registry.ORACLES[name]).df())


# exact dedup


def _classes_brute(rows, sign=1):
    by_text = defaultdict(list)
    for d, t in rows:
        by_text[t or ""].append(d)
    best = {t: max((x for x in own if x is not None), key=lambda x: sign * x, default=None) for t, own in by_text.items()}
    return sorted(((d, best[t or ""], len(by_text[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows), key=str)


def _check_classes(found, rows, sign=1):
    found = found.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == _classes_brute(rows, sign)
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert kept == dict.fromkeys({r.text_sha256 for r in found}, 1)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


@pytest.mark.parametrize(("keep", "sign"), [("largest", 1), ("smallest", -1)])
def test_one_row_of_equal_texts_stays(spark, keep, sign):
    texts = _random_texts(400, 1)
    r = random.Random(2)
    rows = [(r.choice([None, r.randint(-50, 50)]), t) for t in texts] + [(5, "twice"), (5, "twice"), (None, "no id"), (None, "no id"), (1, "x" * 300_000), (2, "x" * 300_000), (3, "x" * 299_999 + "y"), (4, ""), (6, None)]
    _check_classes(exact_dedup.exact_classes(_docs(spark, [(d, t, None, None, None) for d, t in rows]).repartition(7), keep), rows, sign)


def test_tries_spill_by_subtree(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(_random_texts(600, 3))] + [(1000 + i, f"{i % 90:03d}" + "body " * (i % 90)) for i in range(400)]
    rounds = []
    real = exact_dedup._own
    monkeypatch.setattr(exact_dedup, "_own", lambda *a: rounds.append(1) or real(*a))
    _check_classes(exact_dedup.exact_classes(_docs(spark, [(d, t, None, None, None) for d, t in rows]).repartition(5), held=3000), rows)
    assert len(rounds) > 2


def test_trie_holds_every_text_once():
    r = random.Random(4)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(3000)]
    trie = exact_dedup.Trie()
    for i, t in enumerate(texts):
        assert trie.insert(t, i) is None
    wanted = defaultdict(list)
    for i, t in enumerate(texts):
        wanted[t].append(i)
    assert dict(trie.walk()) == wanted
    gone = defaultdict(list)
    subtree = {}
    for k, t, own in trie.spill(trie.held // 4):
        gone[t].extend(own)
        subtree[t] = k
    kept = dict(trie.walk())
    assert kept and gone and not kept.keys() & gone.keys() and kept | gone == wanted
    assert trie.held <= sum(len(t) + 2 * exact_dedup._NODE for t in kept) + exact_dedup._NODE
    assert all(trie.insert(t, -1) == k for t, k in subtree.items())


def test_no_rows_give_none(spark):
    none = _docs(spark, [])
    assert exact_dedup.exact_classes(none).count() == 0
    assert merkle_manifest.manifest(none).count() == 0
    assert token_alignment.corpus_counts(none, token_alignment.default_models()).count() == 0


# alignment


@pytest.fixture(scope="module")
def models():
    return token_alignment.default_models()


def _tokens_brute(text):
    """Both sides by the libraries, with the ends of every token found one by one."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    if "a" not in _libraries:
        _libraries["a"] = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        _libraries["a"].encode_special_tokens = True
        _libraries["b"] = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
        symbols = token_alignment.byte_symbols()
        _libraries["byte"] = {x: b for b, x in enumerate(symbols)}
    a_side, b_side = _libraries["a"], _libraries["b"]
    if not text:
        return [], []
    a = [(i, bytes(_libraries["byte"][c] for c in a_side.id_to_token(i))) for i in a_side.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()) for i in b_side.encode(text) for p in (b_side.id_to_piece(i),)]
    whole = (" " + text).encode()
    if any(b"".join(x for _, x in side) != whole for side in (a, b)):
        return [], []
    return a, b


_libraries = {}


def _alignment_brute(rows):
    docs, counts = [], Counter()
    for d, t in rows:
        a, b = _tokens_brute(t)
        ends_a, ends_b, n = [], [], 0
        for _, x in a:
            n += len(x)
            ends_a.append(n)
        n = 0
        for _, x in b:
            n += len(x)
            ends_b.append(n)
        groups, links, i, j = [], [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(e, i) + 1, ends_b.index(e, j) + 1
            groups.append(",".join(str(x) for x, _ in a[i:p]) + "|" + ",".join(str(x) for x, _ in b[j:q]))
            links.append((a[p - 1][0], b[q - 1][0]))
            i, j = p, q
        counts.update(links)
        docs.append((d, len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return sorted(((d, na, nb, len(links), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), h) for d, na, nb, links, h in docs), key=str)


COUNTS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [None, "", " ", "  ", "a ", "a  ", "   a   b  ", " a", "\u00a0 x\u3000 ", "a", "▁ held", "<s> <|endoftext|> </s><unk>", "x\x00y\t\r\n\n  z ", "中文 naïve 🙂🙂", "don't  stop" * 50, "=" * 3000, "é" * 999, "<0x41>  ​"]


def test_alignment_of_odd_texts(spark, models):
    rows = list(enumerate(ODD)) + [(None, "same text"), (None, "same text"), (3, "same text")] + [(i, "the same words again") for i in range(40)]
    found = token_alignment.corpus_counts(_docs(spark, [(d, t, None, None, None) for d, t in rows]).repartition(3), models, chunk=2000)
    assert sorted((tuple(r[c] for c in COUNTS) for r in found.collect()), key=str) == _alignment_brute(rows)


def test_alignment_query(spark, small, duck):
    rows = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    found = registry.QUERIES["op12_token_alignment"](spark, small)
    assert sorted((tuple(r[c] for c in COUNTS) for r in found.collect()), key=str) == _alignment_brute(rows)


def test_aligned_slices_spell_the_same_bytes(spark, models):
    for r in token_alignment.align(_plain(spark, ODD), models).collect():
        i = j = 0
        for p, q in r.cuts:
            assert b"".join(models.bytes_a[x] for x in r.ids_a[i:p]) == b"".join(models.bytes_b[x] for x in r.ids_b[j:q])
            i, j = p, q
        assert (i, j) == (len(r.ids_a), len(r.ids_b))


def test_models_are_refused_whose_ids_do_not_follow_the_merges(tmp_path):
    import json

    import public_tokenizers as P

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    path = tmp_path / "turned.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="ascend"):
        token_alignment.models_of(str(path), P.path("piece_bpe_32k.model"))


# manifest


def _h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def _leaf_brute(values):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _tree_brute(digests):
    """The root, and for each leaf its steps (left, right)."""
    steps, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        runs = [level[k : k + 3] for k in range(0, len(level), 3)]
        for i, x in enumerate(at):
            run = runs[x // 3]
            steps[i].append(("".join(run[: x % 3]), "".join(run[x % 3 + 1 :])))
        at, level = [x // 3 for x in at], [_h("".join(r)) for r in runs]
    return level[0], steps


def _manifest_brute(rows, change):
    by = defaultdict(list)
    for d, t, lang, source, n in rows:
        by[source].append((d, _leaf_brute((d, source, lang, n, t)), _leaf_brute((d, source, lang, n, change(d, t)))))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _tree_brute([x[1] for x in sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for s in order}
    root, tops = _tree_brute([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for (d, leaf, tampered), own in zip(sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1])), trees[s][1], strict=True):
            folded = tampered
            for left, right in own + top:
                folded = _h(left + folded + right)
            out.append((d, leaf, trees[s][0], root, _h("".join(a + b for a, b in own + top)), folded, folded == root))
    return sorted(out, key=str)


PROOFS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize(("n", "sources", "levels", "rows_of_range"), [(1, 1, 6, 8192), (2, 1, 6, 8192), (40, 40, 6, 8192), (400, 3, 2, 50), (300, 120, 1, 40), (900, 2, 6, 100)])
def test_manifest_by_brute_force(spark, monkeypatch, n, sources, levels, rows_of_range):
    for name, value in (("LEVELS", levels), ("RANGE", rows_of_range)):
        monkeypatch.setattr(merkle_manifest, name, value)
    monkeypatch.setattr(merkle_manifest, "_tops", _with_levels(merkle_manifest._tops, levels))
    monkeypatch.setattr(merkle_manifest, "_suffixes", _with_levels(merkle_manifest._suffixes, levels))
    monkeypatch.setattr(merkle_manifest, "_prove", _with_levels(merkle_manifest._prove, levels))
    r = random.Random(n)
    texts = _random_texts(n, n)
    rows = [(r.choice([None, i, i // 3]), t, r.choice([None, "en"]), r.choice([None, "é", "a"]) if i % 5 == 0 and n > 2 else f"s{i % sources}", r.choice([None, 7])) for i, t in enumerate(texts)]
    rows += rows[: n // 10]
    text = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    found = merkle_manifest.manifest(_docs(spark, rows), text)
    change = lambda d, t: t + "!" if t is not None and d is not None and d % 2 == 0 else t
    assert sorted((tuple(x[c] for c in PROOFS) for x in found.collect()), key=str) == _manifest_brute(rows, change)


def _with_levels(f, levels):
    """The task function with a smaller block, set where it runs."""

    def apply(batches):
        f.__globals__["LEVELS"] = levels
        f.__globals__["height"].__defaults__ = (levels,)
        yield from f(batches)
        f.__globals__["LEVELS"] = 6
        f.__globals__["height"].__defaults__ = (6,)

    return apply


def test_queue_gives_what_levels_give():
    for n in range(1, 60):
        digests = [_h(str(i)) for i in range(n)]
        found = merkle_manifest.upward(digests, merkle_manifest.height(n, 9))
        root, steps = _tree_brute(digests)
        assert found[-1] == [root]
        suffixes = merkle_manifest.downward(found, "")
        assert [[tuple(x.split(",")) for x in s.split(";")] if s else [] for s in suffixes] == steps
        assert all(merkle_manifest.fold(d, s) == root for d, s in zip(digests, suffixes, strict=True))


def test_unchanged_texts_are_verified(spark):
    found = merkle_manifest.manifest(_plain(spark, _random_texts(100, 9))).toPandas()
    assert found["verified"].all() and (found["folded_root"] == found["root"]).all()
    assert isinstance(found, pd.DataFrame) and found["n_siblings"].min() > 0
