"""Language ID, chat formatting, mixing, license scans and BPE: small cases with defined results, brute force, oracles."""

import hashlib
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from liftline.llm import bpe_automaton, chat_format, language_id, license_scan, registry, source_mixing

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string"


def _docs(spark, texts, **more):
    rows = [(i, t, more.get("lang"), None if i % 5 == 4 else f"s{i % 3}", 0, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = ["", None, " \t\n", "x", "12 34 !!", "the cat " * 3000, "ünïcödé 中文 ß", "the cat", "the cat", "a\u0000b", "\U0001f600"]


@pytest.mark.parametrize("name", ["op3_chat_formatting", "op5_exact_search", "op7_source_mixing"])
def test_oracles(spark, small, duck, same, name):
    same(registry.QUERIES[name](spark, small).toPandas(), duck.sql(registry.ORACLES[name]).df())


def test_registry_has_one_query_for_each_operator():
    numbers = sorted(int(re.match(r"op(\d+)_", q)[1]) for q in registry.QUERIES)
    assert numbers == list(range(1, 11))


# language ID


def test_held_out_accuracy(spark, medium):
    got = registry.QUERIES["op1_language_id"](spark, medium).join(spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 200 and (held.lang_pred == held.lang).mean() > 0.98
    assert got.score.between(0, 1).all() and len(got) == 1000


def test_bundles_by_brute_force():
    text, dim = "Ab, c!", 64
    codes = [32, *map(ord, "ab"), 32, ord("c"), 32]
    v = {c: language_id.letter_vectors(np.array([c]), dim)[0].astype(int) for c in set(codes)}
    want = sum(np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))
    g = language_id.trigrams(text)
    assert (language_id.bundle(g, np.zeros(len(g), int), 1, dim)[0] == want).all()
    assert len(language_id.trigrams("12 !")) == 0 and len(language_id.trigrams("x")) == 1


def test_language_edges(spark, monkeypatch):
    train = _docs(spark, ["the cat and the dog", "der hund und die katze"]).withColumn("lang", F.when(F.col("doc_id") == 0, "en").otherwise("de"))
    model = language_id.learn(train)
    assert list(model) == ["de", "en"]
    out = language_id.predict(_docs(spark, ODD), model, ["doc_id", "source"]).toPandas().sort_values("doc_id")
    assert len(out) == len(ODD)
    assert list(out.lang_pred[:3]) == ["und"] * 3 and out.lang_pred.iloc[4] == "und" and out.lang_pred.iloc[7] == "en"
    assert out.lang_pred.iloc[5] == "en" and out.score.iloc[7] == out.score.iloc[8]
    nothing = language_id.predict(_docs(spark, ["abc"]), language_id.learn(train.limit(0)), ["doc_id"]).toPandas()
    assert list(nothing.lang_pred) == ["und"] and list(nothing.score) == [0.0]
    assert language_id.predict(train.limit(0), model, ["doc_id"]).count() == 0
    monkeypatch.setattr(language_id, "_PIECE", 7)  # a long text in many pieces is bundled as one
    cut, whole = {}, language_id.trigrams("the cat and the dog " * 5)
    for rows, grams, owner in language_id._groups(["the cat and the dog " * 5]):
        for k, i in enumerate(rows):
            cut[i] = cut.get(i, 0) + language_id.bundle(grams[owner == k], np.zeros((owner == k).sum(), int), 1)[0]
    assert (cut[0] == language_id.bundle(whole, np.zeros(len(whole), int), 1)[0]).all()


# chat formatting


def test_parts_become_placeholders(spark):
    part = "struct<type:string,text:string,ref:string,tokens:bigint>"
    rows = [(1, 0, "user", [("text", "see </s> \\ [PART:", None, None), ("image", None, "a.png", 256), ("audio", None, "b.wav", 90)]), (1, 1, "assistant", [("text", "[INST]ok", None, 0)]), (2, 0, None, None), (None, 0, "user", [])]
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{part}>")
    out = {r.conv_id: r for r in chat_format.format_chat(df).collect()}
    assert out[1].formatted == "[INST]user[/INST]see <\\/s> \\\\ [\\PART:[PART:image][PART:audio]</s>[INST]assistant[/INST][\\INST]ok</s>"
    assert [(a.type, a.ref, a.tokens) for a in out[1].attachments] == [("image", "a.png", 256), ("audio", "b.wav", 90)] and out[1].attachment_tokens == 346
    s = out[1].loss_spans[0]
    assert out[1].formatted[s.start : s.end] == "[\\INST]ok"
    assert out[2].formatted == "[INST][/INST]</s>" and out[2].n_turns == 1 and out[None].attachments == []
    assert chat_format.format_chat(df.limit(0)).count() == 0


def test_escaping_is_reversible(spark):
    texts = ["</s>", "[INST]", "\\", "\\\\n", "<\\/s>", "[\\INST] [/INST]", "<", "a\n\\\nb", "[PART:image]", "", "\\</s>"]
    df = spark.createDataFrame([(1, i, "r", t) for i, t in enumerate(texts)], "conv_id bigint, turn bigint, role string, text string")
    out = chat_format.format_chat(df.select("conv_id", "turn", "role", chat_format.text_part(F.col("text")).alias("parts")))
    back = out.select(chat_format.read_turns(F.col("formatted")).alias("t")).first().t
    assert [b.text for b in back] == texts


def test_parts_of_a_text_are_one_text(spark):
    """Every control string cut at every place over two and three parts, and across a placeholder."""
    part = "array<struct<type:string,text:string,ref:string,tokens:bigint>>"
    cuts = [(c[:i], c[i:j], c[j:]) for c in (*(x for pair in chat_format.ESCAPES for x in pair), "[PART:image]", "\\\\") for i in range(len(c)) for j in range(i, len(c) + 1)]
    text = lambda x: ("text", x, None, 0)
    rows = [(1, n, "user", [text(x) for x in own]) for n, own in enumerate(cuts)]
    rows += [(2, n, "user", [text(own[0]), ("image", None, "a.png", 1), text(own[1] + own[2])]) for n, own in enumerate(cuts)]
    rows += [(3, 0, "user", [("a]b[/INST]</s>", None, "x", 1), text("c")])]
    out = {r.conv_id: r for r in chat_format.format_chat(spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts {part}")).select("*", chat_format.read_turns(F.col("formatted")).alias("back")).collect()}
    assert [b.text for b in out[1].back] == ["".join(own) for own in cuts]
    assert chat_format.PART not in out[1].formatted
    assert out[2].formatted.count("[PART:image]") == len(cuts) == len(out[2].back)
    assert [b.text for b in out[2].back] == [own[0] + "[PART:image]" + own[1] + own[2] for own in cuts]
    assert out[3].formatted == "[INST]user[/INST][PART:a\\]b[\\/INST\\]<\\/s>]c</s>"


# mixing


def test_mix_meets_its_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(n)), None, [None, "a", "b", "c"][i % 4], 0, "x") for i, n in enumerate(rng.integers(0, 60, 400))]
    rows += [(400, None, None, "a", 0, "x"), (401, " \n", None, "zero", 0, "x"), (3, "w w", None, "a", 0, "x")]
    df = spark.createDataFrame(rows, DOCS).withColumn("target", F.lit("clash"))
    out = source_mixing.mix(df).toPandas()
    assert len(out) == len(rows) and (out.taken <= 2 * out.mix_size).all()
    by = out.groupby(out.source.fillna("~")).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"), own=("mix_size", "sum"))
    assert (by.own == by["size"]).all() and (by.taken == np.floor(by.target)).all() and (by.target <= 2 * by["size"] + 1e-9).all()
    assert by.target.sum() == pytest.approx(1.5 * by["size"].sum())
    pos = out.position.dropna()
    assert pos.is_monotonic_increasing and pos.between(0, 1).all() and out.position.isna().sum() == (out.taken == 0).sum()
    again = source_mixing.mix(df.repartition(7)).toPandas()
    assert out.sort_values(["doc_id", "mix_size"])[["doc_id", "taken", "position"]].reset_index(drop=True).equals(again.sort_values(["doc_id", "mix_size"])[["doc_id", "taken", "position"]].reset_index(drop=True))
    assert source_mixing.mix(df.limit(0)).count() == 0


def test_schedule_inverse(spark):
    df = spark.range(101).select((F.col("id") / 100).alias("y"))
    for a in (-0.8, 0.0, 0.8):
        for r in df.select("y", source_mixing.position(F.col("y"), F.lit(a)).alias("t")).collect():
            assert r.t + a * (r.t * r.t - r.t) == pytest.approx(r.y, abs=1e-9)


# licenses


_RULES = license_scan.rules()


def _license_brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    starts = {}
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                starts.setdefault(label, []).append(i)
    hits = []
    for i, w in enumerate(words):
        own = _RULES.get(w, [])
        near = " ".join(words[i : i + license_scan._CONTEXT]) + " " if own else ""
        for label, rx, priority in own:
            if m := re.match(rx, near):
                hits.append((i, i + m[0].count(" "), priority, label))
    kept = [h for h in hits if not any(o is not h and o[0] <= h[0] and o[1] >= h[1] and o[2] >= h[2] and (o[0], -o[1], -o[2], o[3]) < (h[0], -h[1], -h[2], h[3]) for o in hits)]
    every = [x for s in starts.values() for x in s]
    labels = sorted(set(starts) | {h[3] for h in kept if h[3]})
    return len(words), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(starts)), ",".join(labels)


LICENSED = ["Released under the MIT License. mit license, MIT-license", "licensed under the Apache License, Version 2.0; gnu GENERAL public   license", "SPDX-License-Identifier: BSD 3 Clause", "under the terms of the GNU Lesser General Public License version 3", "ÄMIT license mitlicense mit  licenses", "x" * 50 + " mit license", "cc by nc 4.0 licensed under CC BY-NC 4.0.", "mozilla public license v2 mozilla public licence", *[t for t in ODD if t is None or len(t) < 100]]


def test_license_scan_by_brute_force(spark, small):
    texts = LICENSED + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    out = license_scan.scan(_docs(spark, texts)).toPandas().sort_values("doc_id")
    for r, t in zip(out.itertuples(), texts, strict=True):
        one = lambda x: None if pd.isna(x) else int(x)
        assert (r.n_words, r.n_base, one(r.first_word), one(r.last_word), r.base_labels, r.labels) == _license_brute(t), t
        assert 0 <= r.score <= 1
    assert out.labels.iloc[1] == "apache,gpl" and out.labels.iloc[2] == "bsd" and "lgpl" in out.labels.iloc[3]
    assert license_scan.scan(_docs(spark, ["a"]).limit(0)).count() == 0


def test_rules_are_hundreds_and_ordered():
    every = [r for own in license_scan.rules().values() for r in own]
    assert len(every) > 300 and {p for *_, p in every} == {1, 2, 3}
    for word, own in license_scan.rules().items():
        assert all(re.compile(rx) and rx.startswith(f"^{word[:3]}") for _, rx, _ in own)


def _most_words(regex):
    """An upper bound of the words that a rule matches."""
    regex = re.sub(r"\(\?[!<][^)]*\)", "", regex)
    while m := re.search(r"\(\?:([^()]*)\)(\{\d+,(\d+)\}\??|\?)?", regex):
        most = max((part.replace("\\S+", "x") for part in m[1].split("|")), key=lambda x: x.count(" "))
        regex = regex[: m.start()] + most * int(m[3] or 1) + regex[m.end() :]
    assert not re.search(r"[*(]|(?<!\\S)(?<!\\d)\+", regex), regex
    return regex.count(" ")


def test_no_rule_matches_more_than_its_context(spark):
    assert max(_most_words(rx) for own in license_scan.rules().values() for _, rx, _ in own) <= license_scan._CONTEXT
    texts = ["licensed under the bsd license and mit\u2028 x", "mit\u0085", "unauthorized copying " + "w " * 12 + "is strictly prohibited", "x" * 3_000_000 + " mit license " + "w " * 200_000 + "GPLv3"]
    got = license_scan.scan(_docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.labels for r in got] == ["bsd", "", "proprietary", "gpl,mit"]
    assert got[2].score == 1.0 and (got[3].first_word, got[3].n_words) == (1, 200_004)


HEADERS = [
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("ncsa", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal with the Software without restriction'),
    ("bsl", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("ofl", "Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software, to use, study"),
    ("upl", "permission is hereby granted, free of charge, to any person obtaining a copy of this software, associated documentation and/or data"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above"),
    ("bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("public-domain", "The author has placed this file in the public domain; it is dedicated to the public domain."),
    ("proprietary", "Unauthorized copying of this file, via any medium is strictly prohibited. Proprietary and confidential."),
    ("artistic", "it under the same terms as Perl itself."), ("ruby", "under the same terms as Ruby."),
    ("wtfpl", "0. You just DO WHAT THE FUCK YOU WANT TO."), ("w3c", "W3C Software Notice and License"),
    *[(label, t) for label, own in {
        "gpl": ["GPLv3", "licensed under GPLv3", "gplv2+", "GPL-2.0-or-later"], "lgpl": ["LGPLv2.1", "LGPL-3.0-only"], "agpl": ["AGPLv3", "AGPL-3.0"], "apache": ["Apache-2.0"],
        "bsd": ["BSD-3-Clause", "0BSD"], "mpl": ["MPL-2.0", "MPLv2.0"], "epl": ["EPL-2.0"], "cddl": ["CDDL-1.0"], "cc0": ["CC0-1.0"], "cc-by": ["CC-BY-4.0"], "cc-by-nc": ["CC-BY-NC-4.0"],
        "cc-by-nc-nd": ["CC-BY-NC-ND-4.0"], "cc-by-nc-sa": ["CC-BY-NC-SA-3.0"], "cc-by-nd": ["CC-BY-ND-4.0"], "cc-by-sa": ["CC-BY-SA-4.0"], "cecill": ["CECILL-2.1"], "cpl": ["CPL-1.0"],
        "ecl": ["ECL-2.0"], "elastic": ["Elastic-2.0"], "eupl": ["EUPL-1.2"], "fdl": ["GFDL-1.3"], "lppl": ["LPPL-1.3c"], "ms-pl": ["MS-PL"], "ms-rl": ["MS-RL"], "osl": ["OSL-3.0"],
        "psf": ["PSF-2.0"], "qpl": ["QPL-1.0"], "sspl": ["SSPL-1.0"], "zpl": ["ZPL-2.1"], "afl": ["AFL-3.0"], "apsl": ["APSL-2.0"], "busl": ["BUSL-1.1"],
    }.items() for t in own],
    ("cc-by,creative-commons", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 3.0 Unported"), ("cc-by-nc-nd", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International"), ("creative-commons,share-alike", "you must give appropriate credit, provide a link to the license; you must distribute your contributions under the same license"),
    ("gnu", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."), ("gnu", "This program is distributed in the hope that it will be useful"),
    ("as-is", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND'), ("all-rights-reserved", "All rights reserved."), ("as-is", "IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR CONTRIBUTORS BE LIABLE"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies"), ("isc", "the above copyright notice and this permission notice appear in all copies"),
    ("apache", "you may not use this file except in compliance with the License."), ("apache", "See the License for the specific language governing permissions and limitations under the License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file"), ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("gpl", "You should have received a copy of the GNU General Public License"), ("gpl,lgpl", "You should have received a copy of the GNU Lesser General Public License"), ("agpl,gpl", "You should have received a copy of the GNU Affero General Public License"),
    ("gpl-exception", "with the Classpath Exception"), ("zlib", "3. This notice may not be removed or altered from any source distribution."), ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("eula", "This software is licensed, not sold. You may not reverse engineer, decompile, or disassemble it."), ("proprietary", "No part of this publication may be reproduced"), ("noncommercial", "for non-commercial use only"),
    ("ofl", "with Reserved Font Name Foo"), ("json", "The Software shall be used for Good, not Evil."), ("beerware", "you can buy me a beer in return"), ("blue-oak", "BlueOak-1.0.0"), ("commons-clause", "Commons Clause License Condition v1.0"), ("curl", "curl license"),
    ("edl", "EDL-1.0"), ("freetype", "The FreeType Project LICENSE"), ("hippocratic", "Hippocratic License"), ("hpnd", "Permission to use, copy, modify, distribute, and sell this software and its documentation for any purpose is hereby granted"), ("ibm-pl", "IBM Public License"), ("icu", "ICU License"),
    ("imagemagick", "ImageMagick License"), ("libtiff", "Permission to use, copy, modify, distribute, and sell this software and its documentation for any purpose is hereby granted without fee, provided that (i)"), ("mulan", "Mulan PSL v2"), ("odbl", "Open Database License"), ("odc-by", "ODC-By-1.0"), ("ogl", "Open Government Licence"),
    ("openrail", "OpenRAIL-M"), ("openssl", "OpenSSL License"), ("oracle-bcl", "Oracle Binary Code License"), ("pddl", "PDDL-1.0"), ("php", "PHP License"), ("polyform", "PolyForm Noncommercial"), ("rsa-md", "RSA Data Security, Inc. MD5 Message-Digest Algorithm"), ("sgi", "SGI Free Software License"),
    ("sleepycat", "Sleepycat License"), ("source-available", "Source Available License"), ("tcl", "Tcl/Tk License"), ("unicode", "Unicode License"), ("vim", "Vim License"), ("xfree86", "XFree86 License"), ("zend", "Zend Engine License"),
    # negative rules; a base phrase stays
    ("mit", "an MIT license plate"), ("", "a BSD license plate, and some artistic license"), ("", "It was not released into the public domain."), ("", "not licensed under the GPL license"),
    ("", "permission to leave, version nine, released on bail; a public square, subject to delay, the same terms"),
]


def test_headers_of_every_license(spark):
    assert {x for label, _ in HEADERS for x in label.split(",") if x} == (set(license_scan.NAMES) | set(license_scan.WORDINGS) | set(license_scan.BODIES)) - {""}
    got = license_scan.scan(_docs(spark, [t for _, t in HEADERS])).orderBy("doc_id").collect()
    assert [r.labels for r in got] == [label for label, _ in HEADERS]
    assert [r.labels for r in got] == [_license_brute(t)[-1] for _, t in HEADERS]


# BPE


@pytest.fixture(scope="module")
def tools():
    path = bpe_automaton.default_path()
    return bpe_automaton.Encoder(path), Tokenizer.from_file(path)


def _agree(tools, texts):
    ours, library = tools
    for text, ids in zip(texts, ours.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == want, text[:80]
        assert ours.decode(ids) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aeinrst'lldve <|endoftext|>ÉßİΣς\u0301\x85\u2028😀中½\U00012550"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=4))
def test_bpe_agrees_with_the_library(tools, texts):
    _agree(tools, texts)


def test_every_code_point_is_of_the_splitters_kind(tools):
    ours, library = tools
    split = library.pre_tokenizer.pre_tokenize_str
    for low in range(0, 0x110000, 0x10000):
        codes = [c for c in range(low, low + 0x10000) if not 0xD800 <= c < 0xE000]
        with_letter = {a for _, (a, b) in split("".join(f"a{chr(c)} " for c in codes)) if b - a == 2}
        pieces = split("".join(f"{chr(c)}{chr(c)} " for c in codes))
        doubled, some = {a for _, (a, b) in pieces if b - a == 2}, {a for _, (a, b) in pieces if b - a == 1}
        for k, c in enumerate(codes):
            want = bpe_automaton.LETTER if 3 * k in with_letter else bpe_automaton.OTHER if 3 * k in doubled else bpe_automaton.NUMBER if 3 * k in some else bpe_automaton.SPACE
            assert ours.kind[c] & 3 == want, hex(c)


def test_every_code_point_is_normalized_as_the_library_does(tools):
    ours, library = tools
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and not 0x40000 <= c < 0xE0000:
            x = chr(c)
            assert "".join(ours.normalize(f"a{x}").split()) == "".join(library.normalizer.normalize_str(f"a{x}").split()), hex(c)


def test_words_long_and_short_and_texts_in_groups(tools, monkeypatch):
    ours, _ = tools
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("aeiouthnrslédc中"), n)) for n in (1, 3, 700, 513, 200, 40, 5000)]
    for w in words:
        b = w.encode()
        assert ours.automaton.path(b, ours.automaton.tables()) == ours.automaton.paths([b])[0].tolist()
    _agree(tools, [*words, "x" * 3000, " ".join(words)])
    many = ["".join(rng.choice(list("aeiouthnrslédc中"), n)) for n in rng.integers(500, 1100, 60)]
    _agree(tools, [*many, *many[:5], " ".join(many)])
    assert sum(map(len, ours.long)) <= bpe_automaton.LONG_KEPT
    monkeypatch.setattr(bpe_automaton, "LONG_KEPT", 3000)
    _agree(tools, [*many[:9], *many[:9]])
    assert sum(map(len, ours.long)) <= 3000
    monkeypatch.setattr(bpe_automaton, "GROUP", 50)
    monkeypatch.setattr(bpe_automaton, "WORDS_KEPT", 20)
    _agree(tools, [" ".join(words[:2] * 40), "", " \u0301 a\u0301 " * 60, "don't 's'll''s !'s '", "a <|endoftext|> b " * 20])


def test_automaton_of_a_small_model():
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "aa")]
    arcs = bpe_automaton.Arcs(merges, ["a", "b"])
    number = {x: i for i, x in enumerate(arcs.made)}
    auto = bpe_automaton.Automaton.compile(arcs, number, {x: x.encode() for x in number}, set(), True)

    def plain(word):
        parts = list(word)
        for u, v in merges:
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == (u, v):
                    out.append(u + v)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    words = ["".join("ab"[(k >> i) & 1] for i in range(n)) for n in range(1, 11) for k in range(1 << n)]
    tokens, counts = auto.paths([w.encode() for w in words])
    names, at = list(number), 0
    for w, n in zip(words, counts, strict=True):
        assert [names[i] for i in tokens[at : at + n]] == plain(w) == [names[i] for i in auto.path(w.encode(), auto.tables())], w
        at += n


def test_bpe_query_and_round_trip(spark, small, tools):
    texts = ODD + ["<|endoftext|>a<|startoftext|>", "o'll", *[r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(40).collect()]]
    docs, library = _docs(spark, texts), tools[1]
    path = bpe_automaton.default_path()
    out = bpe_automaton.digests(docs, path).toPandas().sort_values("doc_id")
    for r, t in zip(out.itertuples(), texts, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe_automaton.decode(bpe_automaton.encode(docs, path), path).toPandas().sort_values("doc_id")
    assert list(back.text) == [library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for t in texts]
    assert bpe_automaton.digests(docs.limit(0), path).count() == 0
