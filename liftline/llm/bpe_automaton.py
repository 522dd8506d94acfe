"""BPE encoding and decoding with a tokenization automaton.

The automaton reads tokens: its paths from the start are exactly the token
sequences that the merges can leave. It is built merge by merge. Before any
merge one state has an arc to itself for every base symbol. The gadget for a
merge (u, v) -> w: where u can be followed by v, the state after u becomes a
copy that lacks the arc v, and w is added beside every arc u, leading where v
led. All arcs of one token lead to one state, so states are held by token, with
the arcs they lost and what they are a copy of; whether a state has some arc
follows from those.

The driver compiles the automaton once into arrays: a trie of the tokens' bytes,
and for every token its making, its parts and the arcs that gadgets took from
it. The arrays are bounded by the model file and go to the tasks. A pre-split
word is encoded by transitions over those arrays, many words at once: the
longest arc from a place is tried first, then shorter ones, and a place from
which none goes on is left for good, as at most one path reaches a place. The
decoder emits the labels of the ids.

Defined results: null text counts as empty (no tokens, empty text); every row
gives one row, repeated or not; texts are used whole; a null doc_id is kept;
an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from liftline.llm.common import prepare, table

#: Words whose encoding a task process keeps, the longest such word, and characters of text whose words are encoded together.
WORDS_KEPT, WORD_KEPT, GROUP = 100_000, 64, 1 << 21
#: Bytes of a word from which on it is encoded among words of its own size, how many such there must be (fewer are encoded alone), and characters of long words that a task process keeps.
LONG, TOGETHER, LONG_KEPT = 512, 24, 1 << 20
#: Bits of the slots of the table of pairs.
PAIR_BITS = 18
#: Kinds of characters: white space is dropped, letters and others run on, a number stands alone; NEW is unknown to Python's tables.
SPACE, LETTER, NUMBER, OTHER, NEW = 0, 1, 2, 3, 4


class Arcs:
    """States come in families, one for each token: (u, k) is where the arcs of u lead after the first k gadgets.

    ``lacks`` has, for (u, v), the gadget that took the arc v from the family of u; ``made`` the gadget that made a
    token; ``parts`` what it joins. A family begins as a copy of the state that its right part's arcs led to then.
    """

    def __init__(self, merges: Iterable[tuple[str, str]], base: Iterable[str]):
        self.made = dict.fromkeys(base, 0)
        self.parts: dict[str, tuple[str, str]] = {}
        self.lacks: dict[tuple[str, str], int] = {}
        for k, (u, v) in enumerate(merges, 1):
            if u in self.made and v in self.made and self._has(u, v, k - 1):
                self.lacks[u, v] = k
                if u + v not in self.made:
                    self.made[u + v], self.parts[u + v] = k, (u, v)

    def _has(self, family: str, token: str, k: int) -> bool:
        """Whether state (family, k) has an arc of the token. Copies made after the token had it if their original had; at its making it went beside the arcs of its left part."""
        while True:
            born = self.made[token]
            while k > born:
                if born < self.lacks.get((family, token), 0) <= k:
                    return False
                begun = self.made[family]
                if begun <= born:  # the older states of this family
                    k = born
                    break
                k, family = min(k, begun - 1), self.parts[family][1]
            if token not in self.parts:
                return True
            token = self.parts[token][0]


class Automaton(NamedTuple):
    """The compiled arcs. Tokens are numbers; trie nodes are numbered from the root, 0; -1 stands for none."""

    children: np.ndarray  # node * 256 + byte, sorted
    child: np.ndarray  # the node of each of those
    inner: np.ndarray  # by node: the token that ends here within a word
    final: np.ndarray  # by node: the token that ends here with the word
    shorter: np.ndarray  # by node: the nearest node before it with an inner token
    node: np.ndarray  # by token, and so are the next four
    length: np.ndarray  # in bytes
    made: np.ndarray
    left: np.ndarray
    right: np.ndarray
    lost: np.ndarray  # family * n + token of the arcs that gadgets took, sorted
    taker: np.ndarray  # the gadget of each of those

    @classmethod
    def compile(cls, arcs: Arcs, number: dict[str, int], spelled: dict[str, bytes], ended: set[str], no_end: bool) -> Automaton:
        n = max(number.values()) + 1
        made, left, right, node, length = (np.full(n, -1, np.int32) for _ in range(5))
        children: dict[int, int] = {}
        inner, final, shorter = [-1], [-1], [-1]
        for token in sorted(arcs.made, key=lambda x: len(spelled[x])):
            i, at, last = number[token], 0, -1
            for byte in spelled[token]:
                if inner[at] >= 0:
                    last = at
                key = at * 256 + byte
                if key not in children:
                    children[key] = len(inner)
                    inner.append(-1), final.append(-1), shorter.append(-1)
                at = children[key]
                shorter[at] = last
            node[i], length[i], made[i] = at, len(spelled[token]), arcs.made[token]
            if token in ended or no_end:
                final[at] = i
            if token not in ended:
                inner[at] = i
            if token in arcs.parts:
                left[i], right[i] = (number[x] for x in arcs.parts[token])
        keys = np.array(sorted(children), np.int64)
        lost = {number[u] * n + number[v]: k for (u, v), k in arcs.lacks.items()}
        lost_keys = np.array(sorted(lost), np.int64)
        return cls(
            keys, np.array([children[k] for k in keys.tolist()], np.int32), *(np.array(x, np.int32) for x in (inner, final, shorter)),
            node, length, made, left, right, lost_keys, np.array([lost[k] for k in lost_keys.tolist()], np.int32),
        )

    def has(self, after: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each token can follow another, once all merges are in: as Arcs._has, for many at once."""
        out = np.ones(len(token), bool)
        place, family, gadget = np.arange(len(token)), after.astype(np.int64), np.full(len(token), np.iinfo(np.int32).max)
        token = token.astype(np.int64)
        n = len(self.made)
        while len(place):
            born, begun = self.made[token], self.made[family]
            older = gadget > born
            taken = _look(self.lost, self.taker, family * n + token)
            gone = older & (born < taken) & (taken <= gadget)
            out[place[gone]] = False
            copied = older & (begun > born)
            gadget = np.where(copied, np.minimum(gadget, begun - 1), np.where(older, born, gadget))
            family = np.where(copied, self.right[family], family)
            token = np.where(copied, token, self.left[token])
            stay = ~gone & (token >= 0)
            place, family, token, gadget = place[stay], family[stay], token[stay], gadget[stay]
        return out

    def longest(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The longest token that stands at each start; one that reaches stop is a final one."""
        best, node, live = np.full(len(start), -1, np.int32), np.zeros(len(start), np.int64), np.flatnonzero(start < stop)
        at = start.copy()
        while len(live):
            found = _look(self.children, self.child, node[live] * 256 + data[at[live]])
            live, found = live[found >= 0], found[found >= 0]
            node[live] = found
            at[live] += 1
            whole = at[live] == stop[live]
            token = np.where(whole, self.final[found], self.inner[found])
            best[live] = np.where(token >= 0, token, best[live])
            live = live[~whole]
        return best

    def paths(self, words: list[bytes], pairs: Pairs | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words, one after the other, and each word's number of tokens. Words are not empty."""
        has = (pairs or self).has
        data = np.frombuffer(b"".join(words), np.uint8)
        stops = np.cumsum([len(w) for w in words], dtype=np.int64)
        begins = np.r_[0, stops[:-1]]
        token_at, before = np.full(len(data) + 1, -1, np.int32), np.full(len(data), -1, np.int64)  # by place: the token from here, and where the token before it begins
        dead = np.zeros(len(data) + 1, bool)
        word, place, last = np.arange(len(words)), begins.copy(), np.full(len(words), -1, np.int64)  # last: where the path's last token begins
        token = self.longest(data, place, stops)
        while len(word):
            stop = stops[word]
            some = token >= 0
            end = place + np.where(some, self.length[token], 0)
            done = some & (end == stop)
            fine = some & (done | ~dead[end])
            asked = np.flatnonzero(fine & (last >= 0))
            fine[asked] = has(token_at[last[asked]], token[asked])
            token_at[place[fine]], before[place[fine]] = token[fine], last[fine]
            back = ~some  # nothing goes on from here: its last token is tried shorter
            dead[place[back]] = True
            from_ = last[back]
            lost = from_ < 0  # a word that the model cannot spell
            popped = token_at[from_]
            last = np.where(fine, place, last)
            last[back] = np.where(lost, -1, before[from_])
            token_at[from_[~lost]] = -1
            place = np.where(fine, end, place)
            place[back] = np.where(lost, place[back], from_)
            tried = token.copy()
            tried[back] = popped
            shorter = self.shorter[self.node[tried]]
            token = np.where(shorter >= 0, self.inner[shorter], -1).astype(np.int32)
            go = np.flatnonzero(fine & ~done)
            token[go] = self.longest(data, place[go], stop[go])
            keep = ~(fine & done)
            keep[np.flatnonzero(back)[lost]] = False
            word, place, last, token = word[keep], place[keep], last[keep], token[keep]
        token_at = token_at[:-1]
        ends = np.r_[0, np.cumsum(token_at >= 0)]
        return token_at[token_at >= 0], ends[stops] - ends[begins]

    def tables(self) -> tuple:
        """The arrays as dicts and lists, for ``path``."""
        child, lost = (dict(zip(k.tolist(), v.tolist(), strict=True)) for k, v in ((self.children, self.child), (self.lost, self.taker)))
        return child, lost, *(x.tolist() for x in (self.inner, self.final, self.shorter, self.node, self.length, self.made, self.left, self.right))

    def path(self, word: bytes, tables: tuple) -> list[int]:
        """The tokens of one long word, as ``paths`` finds them: a place at a time, over the tables."""
        child, lost, inner, final, shorter, node, length, made, left, right = tables
        n, size = len(made), len(word)

        def has(family: int, token: int) -> bool:
            gadget = 1 << 40
            while token >= 0:
                born = made[token]
                if gadget > born:
                    if born < lost.get(family * n + token, -1) <= gadget:
                        return False
                    if made[family] > born:
                        gadget, family = min(gadget, made[family] - 1), right[family]
                        continue
                    gadget = born
                token = left[token]
            return True

        def longest(at: int) -> int:
            best, k = -1, 0
            while at < size and (k := child.get(k * 256 + word[at], -1)) >= 0:
                at += 1
                token = final[k] if at == size else inner[k]
                best = token if token >= 0 else best
            return best

        path: list[int] = []
        dead = bytearray(size + 1)
        at, token = 0, longest(0)
        while at < size:
            if token < 0:
                if not path:
                    return []
                dead[at] = 1
                token = path.pop()
                at -= length[token]
            elif not dead[at + length[token]] and (not path or has(path[-1], token)):
                path.append(token)
                at += length[token]
                token = longest(at)
                continue
            k = shorter[node[token]]
            token = inner[k] if k >= 0 else -1
        return path


class Pairs:
    """A transition table of the pairs that occurred: by slot, a pair and whether its right token can follow its left one. A pair that meets another's slot takes it."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.code, self.fine = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)

    def has(self, after: np.ndarray, token: np.ndarray) -> np.ndarray:
        code = after.astype(np.int64) * len(self.automaton.made) + token
        slot = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.fine[slot]
        new = np.flatnonzero(self.code[slot] != code)
        if len(new):
            out[new] = self.automaton.has(after[new], token[new])
            self.code[slot[new]], self.fine[slot[new]] = code[new], out[new]
        return out


def _look(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.full(len(asked), -1, np.int32)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], -1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable Latin-1, else the next from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def kinds(path: str) -> np.ndarray:
    """The kind of every code point to the library's splitter: by Python's tables, and for those they lack, of which newer tables may say more, by asking it."""
    from tokenizers import Tokenizer

    of = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((NEW + OTHER if (c := unicodedata.category(chr(i))) == "Cn" else of.get(c[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    for m in regex.finditer(r"\p{White_Space}", "".join(map(chr, range(0x3100)))):
        out[m.start()] = SPACE
    asked = np.flatnonzero(out >= NEW)
    asked = asked[(asked < 0x40000) | (asked >= 0xE0000)]  # the planes between are empty in every version
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    with_letter = {a for _, (a, b) in split("".join(f"a{chr(c)} " for c in asked)) if b - a == 2}
    doubled = {a for _, (a, b) in split("".join(f"{chr(c)}{chr(c)} " for c in asked)) if b - a == 2}
    for k, c in enumerate(asked.tolist()):
        out[c] = NEW + (LETTER if 3 * k in with_letter else OTHER if 3 * k in doubled else NUMBER)
    return out


class Encoder:
    """The model file's automaton, normalizer, splitter and special tokens, which are those of its kind: NFC, white space to one space, lower case by character, words by pattern. The driver makes it; tasks get it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end = model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        base = {x: bytes([b]) for b in range(256) for x in (symbols[b], symbols[b] + end) if x in model["vocab"]}
        arcs = Arcs(merges, base)
        byte = {x: b for b, x in enumerate(symbols)}
        ended = {x for x in arcs.made if end and x.endswith(end)}
        spelled = {x: bytes(byte[c] for c in (x[: -len(end)] if x in ended else x)) for x in arcs.made}
        self.automaton = Automaton.compile(arcs, model["vocab"], spelled, ended, not end)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.kind = kinds(path)
        labels = {i: x for x, i in model["vocab"].items()} | {i: x for x, i in self.special.items()}
        self.labels = [labels.get(i, "") for i in range(max(labels) + 1)]
        self.normalizer = json.dumps(spec["normalizer"])
        self._begin()

    def _begin(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}
        self.long: dict[str, None] = {}  # the long words among them, oldest first
        self.tables: tuple | None = None
        self.pairs = Pairs(self.automaton)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.numerals = list(map(str, range(len(self.labels))))

    def __getstate__(self) -> dict:
        runs = np.flatnonzero(np.r_[True, self.kind[1:] != self.kind[:-1]])  # a few thousand
        own = {k: v for k, v in self.__dict__.items() if k not in ("known", "long", "tables", "pairs", "special_split", "numerals")}
        return own | {"kind": (runs.astype(np.int32), self.kind[runs])}

    def __setstate__(self, state: dict) -> None:
        runs, kind = state["kind"]
        self.__dict__ |= state | {"kind": np.repeat(kind, np.diff(np.r_[runs, 0x110000]))}
        self._begin()

    @lru_cache(maxsize=1)  # noqa: B019
    def _library(self):  # noqa: ANN202
        from tokenizers import Tokenizer, models

        whole = Tokenizer(models.BPE()).to_str()
        return Tokenizer.from_str(json.dumps(json.loads(whole) | {"normalizer": json.loads(self.normalizer)})).normalizer

    def normalize(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if (self.kind[_codes(text)] >= NEW).any():  # characters newer than Python's tables
            return self._library().normalize_str(text)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def find(self, text: str) -> list[str]:
        """The words of a normalized text: runs of letters, single numbers, runs of others, and contractions where a run of others is an apostrophe."""
        if not text:
            return []
        kind = self.kind[_codes(text)] & 3
        begins = np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)]
        if "'" in text:
            starts = np.flatnonzero(begins)
            ends = np.r_[starts[1:], len(text)]
            alone = starts[(kind[starts] == OTHER) & (ends == starts + 1)]
            for i in alone.tolist():
                if text[i] == "'":
                    size = 2 if text[i + 1 : i + 2] in ("s", "t", "m", "d") and i + 1 < len(text) else 3 if text[i + 1 : i + 3] in ("re", "ve", "ll") else 0
                    if size:
                        begins[i + 1 : i + size] = False
                        if i + size < len(text):
                            begins[i + size] = True
        starts = np.flatnonzero(begins)
        ends = np.r_[starts[1:], len(text)]
        real = kind[starts] != SPACE
        return [text[a:b] for a, b in zip(starts[real].tolist(), ends[real].tolist(), strict=True)]

    def pieces(self, text: str) -> list[int | list[str]]:
        """The pre-split words of what lies between special tokens, and the ids of those."""
        if not any(s in text for s in self.special):
            return [self.find(self.normalize(text))]
        return [self.special[x] if x in self.special else self.find(self.normalize(x)) for x in self.special_split.split(text) if x]

    def _learn(self, words: set[str]) -> None:
        """Encode the words that are not known yet. Long words of one size go together where there are many."""
        new = sorted(words.difference(self.known))
        if not new:
            return
        if len(self.known) + len(new) > WORDS_KEPT:
            for w in list(islice(self.known, len(self.known) // 2)):
                if w not in words:
                    del self.known[w]
        spelled = {w: w.encode("utf-8") for w in new}
        sizes: dict[int, list[str]] = {}
        for w, b in spelled.items():
            sizes.setdefault(0 if len(b) <= LONG else len(b).bit_length(), []).append(w)
        for size, own in sizes.items():
            if size and len(own) < TOGETHER:
                self.tables = self.tables or self.automaton.tables()
                self.known |= {w: tuple(self.automaton.path(spelled[w], self.tables)) for w in own}
                continue
            tokens, counts = self.automaton.paths([spelled[w] for w in own], self.pairs)
            tokens, ends = tokens.tolist(), np.cumsum(counts)
            for w, b, n in zip(own, ends.tolist(), counts.tolist(), strict=True):
                self.known[w] = tuple(tokens[b - n : b])
        self.long |= dict.fromkeys(w for w in new if len(w) > WORD_KEPT)

    def _forget(self) -> None:
        """The oldest long words go until LONG_KEPT characters of them are left."""
        over = sum(map(len, self.long)) - LONG_KEPT
        for w in list(self.long):
            if over <= 0:
                break
            over -= len(w)
            del self.long[w]
            self.known.pop(w, None)

    def _groups(self, texts: list[str | None]) -> Iterator[list[tuple[list, bool]]]:
        """Pieces of about GROUP characters of text, and whether they end a text. A longer text is cut before a space; no word or composed letter goes across one."""
        held: list[tuple[list, bool]] = []
        size = 0
        for text in texts:
            at, n = 0, len(text or "")
            while True:
                end = n if n - at <= GROUP else text.find(" ", at + GROUP)
                end = n if end < 0 else end
                held.append((self.pieces(text[at:end]) if n else [], end == n))
                size += end - at
                if size >= GROUP:
                    yield held
                    held, size = [], 0
                if end == n:
                    break
                at = end
        if held:
            yield held

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each text; the words of a group are encoded together."""
        ids: list[int] = []
        for held in self._groups(texts):
            self._learn({w for own, _ in held for p in own if isinstance(p, list) for w in p})
            for own, ends in held:
                for p in own:
                    ids.extend(chain.from_iterable(map(self.known.__getitem__, p)) if isinstance(p, list) else (p,))
                if ends:
                    yield ids
                    ids = []
            self._forget()

    def decode(self, ids: list[int]) -> str:
        """The labels of the ids. Without a decoder in the model file, they are joined by spaces."""
        return " ".join(map(self.labels.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """Compiled once by the driver."""
    return Encoder(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>."""
    prepare(docs.sparkSession)
    e = encoder(path)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(e.encode(batch.column(1).to_pylist())), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(apply, docs.select("doc_id").schema.add("ids", ArrayType(IntegerType())))


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, text: the labels of the ids."""
    prepare(tokens.sparkSession)
    e = encoder(path)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([e.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(apply, tokens.select("doc_id").schema.add("text", "string"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: a text is encoded to ids, these are decoded, and both are hashed in one pass."""
    prepare(docs.sparkSession)
    e = encoder(path)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for ids in e.encode(batch.column(1).to_pylist()):
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(" ".join(map(e.numerals.__getitem__, ids)).encode()).hexdigest())
                text_hash.append(hashlib.sha256(e.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(apply, docs.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", F.col("text")), default_path())


QUERIES = {"op10_bpe_automaton": op10_bpe_automaton}


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
