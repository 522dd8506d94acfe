"""License scans by ordered signature rules, in DataFrame functions only.

A text is lower-cased (A-Z) and cut into words. Rules are regexes over the
words that follow a keyword, gated by that keyword: only texts that hold a
license term at all (the gate) are cut up, only words that start some rule are tried, and
only with the rules of that word. Each hit is an interval of words. A hit that
lies within another hit of the same or a higher priority is suppressed; what
remains gives the labels. Three base phrases are located apart from the rules
and never suppressed.

Defined results: null text counts as empty (no words, no labels, score 0);
every row gives one row, repeated or not; a null doc_id is kept; an empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftline.llm.common import table
from liftline.llm.license_rules import BODIES

#: ASCII characters outside words, one by one: Java looks such a class up in a table, a union of ranges it tries in turn. Capitals count as word characters in the text as it is.
_OTHERS = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
_RAW_WORD, _RAW_GAP = f"[^{_OTHERS}]+", f"[{_OTHERS}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Label by base phrase.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label: names as regexes over words, each starting with a plain word.
NAMES = {
    "afl": ["academic free"],
    "agpl": ["gnu affero general public", "affero general public", "agpl"],
    "apache": ["apache", "apache software"],
    "apsl": ["apple public source"],
    "artistic": ["artistic", "perl artistic"],
    "bsd": ["bsd", "bsd [234] clause", "berkeley software distribution"],
    "bsl": ["boost software", "boost"],
    "busl": ["business source"],
    "cc0": ["cc0", "creative commons zero", "creative commons cc0"],
    "cc-by": ["cc by", "creative commons attribution"],
    "cc-by-nc": ["cc by nc", "creative commons attribution non ?commercial"],
    "cc-by-nc-nd": ["cc by nc nd", "creative commons attribution non ?commercial no ?derivatives"],
    "cc-by-nc-sa": ["cc by nc sa", "creative commons attribution non ?commercial share ?alike"],
    "cc-by-nd": ["cc by nd", "creative commons attribution no ?derivatives"],
    "cc-by-sa": ["cc by sa", "creative commons attribution share ?alike"],
    "cddl": ["cddl", "common development and distribution"],
    "cecill": ["cecill", "cecill [abc]"],
    "cpl": ["common public"],
    "ecl": ["educational community"],
    "elastic": ["elastic"],
    "epl": ["epl", "eclipse public"],
    "eupl": ["eupl", "european union public"],
    "fdl": ["gnu free documentation", "gfdl"],
    "gpl": ["gnu general public", "gpl", "gnu gpl", "general public"],
    "isc": ["isc", "internet systems consortium"],
    "lgpl": ["gnu lesser general public", "gnu library general public", "lesser general public", "lgpl", "gnu lgpl"],
    "lppl": ["latex project public", "lppl"],
    "mit": ["mit", "mit x11", "expat"],
    "mpl": ["mozilla public", "mpl"],
    "ms-pl": ["microsoft public"],
    "ms-rl": ["microsoft reciprocal"],
    "ncsa": ["university of illinois ncsa open source", "ncsa open source"],
    "ofl": ["sil open font", "ofl"],
    "osl": ["open software"],
    "postgresql": ["postgresql"],
    "psf": ["python software foundation", "psf"],
    "qpl": ["q public", "qpl"],
    "ruby": ["ruby"],
    "sspl": ["server side public", "sspl"],
    "unlicense": ["unlicense"],
    "upl": ["universal permissive"],
    "w3c": ["w3c software"],
    "wtfpl": ["wtfpl", "do what the f\\S+ you want to public"],
    "zlib": ["zlib", "zlib libpng"],
    "zpl": ["zope public"],
}
#: label: wordings of notices, SPDX identifiers and names with a glued version, each a rule of its own; the first word is plain.
_LATER = "(?: only| or later)?"
_TO_ANY = "hereby granted free of charge to any person"
WORDINGS = {
    "afl": ["afl (?:1 [12]|2 [01]|3 0)", "aflv3(?: 0)?"],
    "agpl": ["agpl [13] 0" + _LATER, "agplv3(?: 0)?" + _LATER, "agpl3" + _LATER],
    "apache": ["apache (?:1 [01]|2 0)", "apachev2(?: 0)?", "asl 2 0", "aslv2(?: 0)?"],
    "apsl": ["apsl (?:1 [012]|2 0)", "subject to the apple public source licen[cs]e"],
    "artistic": ["artistic (?:1 0|2 0)(?: perl| cl8)?", "same terms as perl itself", "same terms as the perl 5 programming language"],
    "bsd": [
        "redistribution and use in source and binary forms",
        "redistribution and use of this software in source and binary forms",
        "redistributions of source code must retain the above copyright notice",
        "redistributions in binary form must reproduce the above copyright notice",
        "neither the name of (?:\\S+ ){1,12}may be used to endorse or promote products",
        "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted(?! provided)",
        "bsd [234] clause(?: clear| patent| uc| views)?",
        "0bsd",
    ],
    "bsl": ["bsl 1 0", _TO_ANY + " or organization obtaining a copy of the software"],
    "busl": ["busl 1 1", "bsl 1 1"],
    "cc0": ["cc0 1 0(?: universal)?", "cc0 public domain dedication"],
    "cc-by": ["cc by [1234] [05]"],
    "cc-by-nc": ["cc by nc [1234] [05]"],
    "cc-by-nc-nd": ["cc by nc nd [1234] [05]"],
    "cc-by-nc-sa": ["cc by nc sa [1234] [05]"],
    "cc-by-nd": ["cc by nd [1234] [05]"],
    "cc-by-sa": ["cc by sa [1234] [05]"],
    "cddl": ["cddl 1 [01]", "cddlv1(?: [01])?"],
    "cecill": ["cecill (?:1 [01]|2 [01]|[bc])"],
    "cpl": ["cpl 1 0", "cplv1(?: 0)?"],
    "ecl": ["ecl [12] 0"],
    "elastic": ["elastic 2 0", "elv2"],
    "epl": ["epl [12] 0", "eplv1(?: 0)?", "eplv2(?: 0)?"],
    "eupl": ["eupl 1 [012]", "euplv1(?: [012])?"],
    "fdl": ["gfdl 1 [123]" + _LATER, "fdl 1 [123]", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation"],
    "gpl": [
        "gpl [123](?: 0)?" + _LATER, "gplv1" + _LATER, "gplv2(?: 0)?" + _LATER, "gplv3(?: 0)?" + _LATER, "gpl2" + _LATER, "gpl3" + _LATER,
        "redistribute it and or modify it under the terms of the gnu general public",
    ],
    "isc": ["permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided"],
    "lgpl": [
        "lgpl (?:2 [01]|3 0|[23])" + _LATER, "lgplv2(?: [01])?" + _LATER, "lgplv3(?: 0)?" + _LATER, "lgpl2(?: 1)?" + _LATER, "lgpl3" + _LATER,
        "redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public",
    ],
    "lppl": ["lppl 1 (?:[012]|3[ac]?)", "conditions of the latex project public"],
    "mit": [_TO_ANY + " obtaining a copy of this software and associated documentation files(?! the software to deal with)", "deal in the software without restriction"],
    "mpl": ["mpl (?:1 [01]|2 0)", "mplv1(?: [01])?", "mplv2(?: 0)?", "mpl2", "subject to the (?:terms of the )?mozilla public"],
    "ms-pl": ["ms pl"],
    "ms-rl": ["ms rl"],
    "ncsa": [_TO_ANY + " obtaining a copy of this software and associated documentation files the software to deal with", "deal with the software without restriction"],
    "ofl": ["ofl 1 [01](?: rfn| no rfn)?", _TO_ANY + " obtaining a copy of the font software"],
    "osl": ["osl (?:1 [01]|2 [01]|3 0)"],
    "postgresql": ["permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"],
    "proprietary": [
        "proprietary and confidential", "confidential and proprietary", "proprietary licen[cs]e", "proprietary information of",
        "unauthorized (?:copying|use|reproduction|distribution|duplication|disclosure)(?: \\S+){0,12}? (?:is|are) (?:strictly )?prohibited",
        "unauthorised (?:copying|use|reproduction|distribution|duplication|disclosure)(?: \\S+){0,12}? (?:is|are) (?:strictly )?prohibited",
    ],
    "psf": ["psf 2 0", "python 2 0 1"],
    "public-domain": ["released (?:in|to|into) the public domain", "placed (?:in|into) the public domain", "dedicated to the public domain", "public domain dedication", "public domain software", "public domain work"],
    "qpl": ["qpl 1 0"],
    "ruby": ["same terms as ruby(?: itself)?"],
    "sspl": ["sspl 1 0", "ssplv1"],
    "unlicense": ["unencumbered software released into the public domain"],
    "upl": ["upl 1 0", _TO_ANY + " obtaining a copy of this software associated documentation"],
    "w3c": ["w3c software notice", "w3c 2015(?:0513)?", "w3c 19980720"],
    "wtfpl": ["wtfpl", "just do what the f\\S+ you want to"],
    "zlib": ["permission is granted to anyone to use this software for any purpose including commercial applications", "altered source versions must be plainly marked as such"],
    "zpl": ["zpl (?:1 1|2 [01])"],
}
#: A version has at most four numbers, so that every rule is of bounded length.
_VERSION = "(?: v?(?:version )?v?\\d+(?: \\d+){0,3})"
_LICENSE = "licen[cs]e"
#: priority, regex around a name. A higher priority suppresses what lies within its interval.
TEMPLATES = (
    (1, "{name} " + _LICENSE),
    (2, "{name}(?: " + _LICENSE + ")? (?:version |v)\\d+(?: \\d+){0,3}"),
    (3, "licen[cs]ed under (?:the |a |an )?{name}(?: " + _LICENSE + ")?" + _VERSION + "?"),
    (3, "released under (?:the |a |an )?{name}(?: " + _LICENSE + ")?" + _VERSION + "?"),
    (3, "distributed under (?:the )?(?:terms of )?(?:the |a |an )?{name}(?: " + _LICENSE + ")?" + _VERSION + "?"),
    (3, "under the terms of (?:the |a |an )?{name} " + _LICENSE + _VERSION + "?"),
    (3, "spdx licen[cs]e identifier {name}(?: \\d+){0,3}(?: only| or later)?"),
)
_PRIORITIES = (1, 2, 3)


def rules() -> dict[str, list[tuple[str, str, int]]]:
    """keyword: (label, anchored regex, priority), from every name in every template and from every wording."""
    found: dict[str, list[tuple[str, str, int]]] = defaultdict(list)
    for label, names in NAMES.items():
        for name in names:
            for priority, template in TEMPLATES:
                regex = template.replace("{name}", name)
                words = ["licensed", "licenced"] if regex.startswith("licen[cs]ed") else [regex.split(" ")[0].split("(")[0]]
                for word in words:
                    found[word].append((label, f"^{regex} ", priority))
    for label, wordings in (*WORDINGS.items(), *BODIES.items()):
        for regex in wordings:
            found[regex.split(" ")[0].split("(")[0]].append((label, f"^{regex} ", 3 if regex.count(" ") > 4 or not label else 2))
    return dict(found)


#: Words of context that a rule sees; no rule can match more.
_CONTEXT = 32


#: What stands after a word.
_END = r"(?![a-z0-9])"


def _gate() -> str:
    """A regex that every lower-case text with a hit or a base phrase matches, at the start of a word; put together by first letters.

    It asks for the plain words that a rule begins with, three at most. A name of one word, such as mit, counts only
    where a template has it: before license or a version, or after a template's own beginning.
    """
    heads = {"(?:licensed|licenced|released|distributed)" + _RAW_GAP + "under", "under" + _RAW_GAP + "the" + _RAW_GAP + "terms", "spdx"}
    heads = {h + _END for h in heads}

    def add(regex: str, name: bool) -> None:
        words = regex.split(" ")
        plain = words[: min(3, next((k for k, w in enumerate(words) if not w.isalnum()), len(words)))] or [words[0].split("(")[0]]
        if len(plain) == 1 and name:
            heads.add(plain[0] + _RAW_GAP + r"(?:licen[cs]e|version|v?\d)" if regex == plain[0] else plain[0] + _END)
        elif len(plain) == 1 and len(words) > 1 and words[1].startswith("licen[cs]e"):
            heads.add(plain[0] + _RAW_GAP + "licen[cs]e")
        elif len(plain) == 1 and len(words) > 1 and words[0] == plain[0] and words[1].lstrip("(?:[")[:1].isdigit():
            heads.add(plain[0] + _RAW_GAP + r"\d")
        else:
            heads.add(_RAW_GAP.join(plain) + _END)

    for own in NAMES.values():
        for name in own:
            add(name, True)
    for rules in (WORDINGS, BODIES):
        for own in rules.values():
            for wording in own:
                add(wording, False)
    by_letters: dict[str, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
    for head in sorted(heads):
        plain = head[:2].isalnum()
        by_letters[head[0] if plain else ""][head[1] if plain else ""].append(head[2:] if plain else head)
    letters = ("{}(?:{})".format(a, "|".join("{}(?:{})".format(b, "|".join(own)) for b, own in seconds.items())) for a, seconds in by_letters.items())
    return r"(?<![a-z0-9])(?:" + "|".join(letters) + ")"


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def keyed(by_word: dict[str, list[tuple[str, str, int]]]) -> dict[str, list[tuple[str, str, int]]]:
    """The rules by what is looked up: the first two words where both are plain, else the first."""
    found: dict[str, list[tuple[str, str, int]]] = defaultdict(list)
    for word, own in by_word.items():
        for rule in own:
            second = rule[1].split(" ")[1]
            found[f"{word} {second}" if second.isalnum() else word].append(rule)
    return dict(found)


def _hits(words: Column, by_key: dict[str, list[tuple[str, str, int]]]) -> Column:
    """The (start, -end, -priority, label) of each rule at each word that starts one, sorted."""
    table_of = F.create_map(*(x for key, own in by_key.items() for x in (F.lit(key), F.array(*(F.struct(F.lit(a).alias("label"), F.lit(b).alias("regex"), F.lit(c).alias("priority")) for a, b, c in own)))))
    firsts = {key.split(" ")[0] for key in by_key}
    begun = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: x["word"].isin(*firsts))

    def looked_up(x: Column) -> Column:
        pair = F.concat(x["word"], F.lit(" "), F.coalesce(F.get(words, x["at"] + 1), F.lit("")))
        return F.filter(F.array(x, F.struct(x["at"].alias("at"), pair.alias("word"))), lambda y: y["word"].isin(*by_key))

    starts = F.flatten(F.transform(begun, looked_up))

    def at(x: Column) -> Column:
        near = F.concat(F.array_join(F.slice(words, x["at"] + 1, F.lit(_CONTEXT)), " "), F.lit(" "))
        tried = F.transform(F.element_at(table_of, x["word"]), lambda r: F.struct(r["label"].alias("label"), r["priority"].alias("priority"), F.regexp_substr(near, r["regex"]).alias("text")))
        return F.transform(F.filter(tried, lambda r: r["text"].isNotNull()), lambda r: F.struct(x["at"].alias("start"), (-(x["at"] + _spaces(r["text"]))).alias("end"), (-r["priority"]).alias("priority"), r["label"].alias("label")))

    return F.array_sort(F.flatten(F.transform(starts, at)))


def _kept(hits: Column) -> Column:
    """(labels, words): of the hits that no earlier hit of the same or a higher priority holds. By start, longest first, what holds a hit comes before it."""
    start = F.struct(*(F.lit(0).alias(f"e{p}") for p in _PRIORITIES), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("words"))

    def step(s: Column, h: Column) -> Column:
        end, priority = -h["end"], -h["priority"]
        held = F.greatest(*(F.when(priority <= p, s[f"e{p}"]).otherwise(F.lit(0)) for p in _PRIORITIES)) >= end
        ends = (F.when(priority == p, F.greatest(s[f"e{p}"], end)).otherwise(s[f"e{p}"]).alias(f"e{p}") for p in _PRIORITIES)
        held = held | (h["label"] == "")  # a negative rule holds others and gives nothing
        return F.struct(*ends, F.when(held, s["labels"]).otherwise(F.array_union(s["labels"], F.array(h["label"]))).alias("labels"), (s["words"] + F.when(held, F.lit(0)).otherwise(end - h["start"])).alias("words"))

    return F.aggregate(hits, start, step, lambda s: F.struct(s["labels"].alias("labels"), s["words"].alias("words")))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one narrow pass, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lower = F.translate(text, _UPPER, _LOWER)
    cut = docs.select(
        "doc_id",
        F.regexp_count(text, F.lit(_RAW_WORD)).cast("long").alias("n_words"),
        F.when(F.lower(text).rlike(_gate()), F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, _RAW_GAP, " ")), F.lit(" "))).alias("norm"),
    )
    norm = F.col("norm")
    found = cut.select("*", F.when(norm.isNotNull(), _kept(_hits(F.split(F.trim(norm), " "), keyed(rules())))).alias("kept"), *(F.when(norm.contains(f" {p} "), F.split(norm, f"(?<= ){p}(?= )")).alias(f"p{i}") for i, p in enumerate(BASE)))
    firsts = [_spaces(F.col(f"p{i}")[0]) - 1 for i in range(len(BASE))]
    lasts = [_spaces(norm) - _spaces(F.element_at(f"p{i}", -1)) - len(p.split()) for i, p in enumerate(BASE)]
    base = F.filter(F.array(*(F.when(F.col(f"p{i}").isNotNull(), label) for i, label in enumerate(BASE.values()))), lambda x: x.isNotNull())
    return found.select(
        "doc_id",
        "n_words",
        sum((F.coalesce(F.size(f"p{i}") - 1, F.lit(0)) for i in range(len(BASE))), F.lit(0)).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce(F.col("kept.labels"), F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_words") > 0, F.least(F.lit(1.0), F.coalesce(F.col("kept.words"), F.lit(0)) / F.col("n_words"))).otherwise(F.lit(0.0)).alias("score"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op9_license_scan": op9_license_scan}
