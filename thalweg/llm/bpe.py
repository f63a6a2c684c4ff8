"""Byte-level BPE by an automaton over tokens.

The automaton starts with one state that accepts every sequence of bytes.  Each
merge ``a b -> c`` adds a gadget: where ``a`` leads, ``b`` is cut from then on,
and an arc ``c`` goes from where ``a`` started to where ``b`` ended.  A state
depends only on the last arc's label, so the automaton is a table of which
token may follow which: the gadgets are kept in merge order with the time at
which each cut arises, and a row of the table is filled in when it is first
asked for.  The one path through it that spells a word is its encoding; its arc
labels spell the text again.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ids_and_texts, map_texts

NEVER = 1 << 60
#: Words whose encoding a Python worker remembers.
HELD_WORDS = 800_000


def byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files write bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Automaton:
    """The tokenization automaton of a vocabulary and its merges in order."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.ids = tokens
        self.label = {i: b for b, i in tokens.items()}
        self.born = dict.fromkeys(self.label, -1)
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.cut: dict[tuple[int, int], int] = {}
        for time, (a, b) in enumerate(merges):
            self._add_gadget(time, tokens[a], tokens[b], tokens[a + b])
        self.barred: dict[tuple[int, int], int] = {}
        #: transitions: behind each token, whether another may follow; entries are made when first needed
        self.rows: dict[int, dict[int, bool]] = {i: {} for i in self.label}
        #: longest arc by its first four bytes; other arcs are shorter
        self.reach: dict[bytes, int] = {}
        for b in tokens:
            if len(b) >= 4:
                self.reach[b[:4]] = max(self.reach.get(b[:4], 0), len(b))
        #: for each token the longest shorter one that it begins with; filled in when first needed
        self.shorter: dict[int, int] = {}

    def _add_gadget(self, time: int, a: int, b: int, c: int) -> None:
        self.cut.setdefault((a, b), time)
        if c not in self.left:
            self.born[c], self.left[c], self.right[c] = time, a, b

    def barred_from(self, a: int, b: int) -> int:
        """The merge from which on no arc ``b`` leaves the state behind ``a``."""
        key = (a, b)
        known = self.barred.get(key)
        if known is not None:
            return known
        time = self.cut.get(key, NEVER)
        born_a, born_b = self.born[a], self.born[b]
        if born_b >= born_a and born_b >= 0:
            # arc b was laid along its left part; without that there was none to follow
            if self.barred_from(a, self.left[b]) <= born_b:
                time = min(time, born_b)
        if born_a > born_b:
            # the state behind a was the state behind its right part, as it was before the gadget's cut
            if self.barred_from(self.right[a], b) < born_a:
                time = min(time, born_a)
        self.barred[key] = time
        return time

    def longest(self, word: bytes, at: int) -> int:
        """The longest arc that spells the word from a place on; -1 if there is none."""
        find = self.ids.get
        for size in range(min(self.reach.get(word[at : at + 4], 3), len(word) - at), 0, -1):
            token = find(word[at : at + size])
            if token is not None:
                return token
        return -1

    def prefix(self, token: int) -> int:
        found = self.shorter.get(token)
        if found is None:
            label = self.label[token]
            found = self.shorter[token] = next((self.ids[label[:n]] for n in range(len(label) - 1, 0, -1) if label[:n] in self.ids), -1)
        return found

    def encode(self, word: bytes) -> tuple[int, ...]:
        """Labels of the one path that spells the word.

        Transitions are tried from the longest arc on.  A place that no path
        goes on from is not entered again, so the work is linear in the word.
        """
        n = len(word)
        if not n:
            return ()
        rows, label, dead = self.rows, self.label, set()
        path: list[int] = []
        at, token = 0, self.longest(word, 0)
        while at < n:
            if token < 0:
                if not path:
                    raise ValueError("the vocabulary has no token for a byte")
                dead.add(at)
                token = path.pop()
                at -= len(label[token])
                token = self.prefix(token)
                continue
            end = at + len(label[token])
            if path:
                row = rows[path[-1]]
                follows = row.get(token)
                if follows is None:
                    follows = row[token] = self.barred_from(path[-1], token) == NEVER
            else:
                follows = True
            if follows and end not in dead:
                path.append(token)
                at = end
                token = self.longest(word, at) if at < n else -1
            else:
                token = self.prefix(token)
        return tuple(path)


def _runs(codes: list[int]) -> str:
    """Code points as the inside of a character class."""
    out, start = [], None
    for i, c in enumerate(codes):
        start = c if start is None else start
        if i + 1 == len(codes) or codes[i + 1] != c + 1:
            out.append(f"\\U{start:08x}-\\U{c:08x}")
            start = None
    return "".join(out)


def unlike_letters() -> str:
    """Code points that are letters or numbers to ``regex`` but not yet to the tokenizers library, as class ranges."""
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    letter = regex.compile(r"[\p{L}\p{N}]")
    codes = [c for c in chain(range(128, 0xD800), range(0xE000, 0x110000)) if letter.match(chr(c))]
    return _runs([c for c in codes if len(split("!" + chr(c))) == 1])


class Splitter:
    """Cuts a text into the words that are encoded one by one."""

    def __init__(self, odd: str):
        self.plain = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.exact = self.plain
        if odd:
            self.exact = regex.compile(
                rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{odd}]]+| ?[\p{{N}}--[{odd}]]+| ?[[^\s\p{{L}}\p{{N}}]||[{odd}]]+|\s+(?!\S)|\s+"
            )

    def pattern(self, text: str):
        try:
            text.encode("latin-1")
            return self.plain
        except UnicodeEncodeError:
            return self.exact


class Words(dict):
    """Encodings of the words met so far."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= HELD_WORDS:
            self.clear()
        found = self[word] = self.automaton.encode(word.encode("utf-8"))
        return found


class Coder:
    """Encodes and decodes texts; lives in a Python worker."""

    def __init__(self, content: str, odd: str):
        file = json.loads(content)
        letters = byte_letters()
        spelled = {t: bytes(letters[c] for c in t) for t in file["model"]["vocab"]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        self.automaton = Automaton(
            {spelled[t]: i for t, i in file["model"]["vocab"].items()}, [(spelled[a], spelled[b]) for a, b in pairs]
        )
        self.splitter = Splitter(odd)
        self.added = {a["content"]: a["id"] for a in file["added_tokens"]}
        names = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.label = self.automaton.label | {i: t.encode() for t, i in self.added.items()}
        self.digits = {i: str(i) for i in self.label}
        self.known = Words(self.automaton)

    def ordinary(self, text: str) -> list[int]:
        """Ids of a text whose special tokens are plain text."""
        return list(chain.from_iterable(map(self.known.__getitem__, self.splitter.pattern(text).findall(text))))

    def encode(self, text: str) -> list[int]:
        if self.special is None or not any(name in text for name in self.added):
            return self.ordinary(text)
        ids: list[int] = []
        for i, part in enumerate(self.special.split(text)):
            ids += [self.added[part]] if i % 2 else self.ordinary(part)
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace")


class Source:
    """What a coder is made from; a worker makes it once and keeps it with the broadcast for its later tasks."""

    def __init__(self, content: str, odd: str):
        self.parts, self.made = (content, odd), None

    def coder(self) -> Coder:
        if self.made is None:
            self.made = Coder(*self.parts)
        return self.made


def coder_factory(docs: DataFrame, vocabulary: str):
    """A function that gives a task its coder; the file is read once, on the driver, and broadcast."""
    with open(vocabulary, encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast(Source(file.read(), unlike_letters()))
    return lambda: sent.value.coder()


def encoded(docs: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add ``ids``, the token ids of each whole text; a null text has none."""
    fields = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return map_texts(docs, lambda texts, coder: {"ids": [coder.encode(t or "") for t in texts]}, fields, keep, coder_factory(docs, vocabulary))


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, and digests of the ids and of the text decoded from them, for every document.

    Ids are those of the whole text, a special token's string being that token.
    Null and empty texts have no tokens and decode to the empty text; repeated
    rows and null ids are kept; an empty table gives no rows.  Only id and text
    are read.
    """

    def function(texts, coder):
        made = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in texts:
            ids = coder.encode(text)
            made["n_tokens"].append(len(ids))
            made["ids_sha256"].append(hashlib.sha256(",".join(map(coder.digits.__getitem__, ids)).encode()).hexdigest())
            made["decoded_sha256"].append(hashlib.sha256(coder.decode(ids).encode("utf-8")).hexdigest())
        return made

    fields = T.StructType(
        [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    )
    return map_texts(ids_and_texts(docs), function, fields, setup=coder_factory(docs, vocabulary))
