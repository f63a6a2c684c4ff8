"""Personal data in texts, also where it is disguised.

Disguises are undone by transducers that keep, for every character they write,
where in the source it came from; identifiers are then looked for in the plain
text and their spans mapped back.  Spans are in code points.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ids_and_texts, map_texts
from .endings import ENDINGS

KINDS = ("email", "ip", "card", "phone")

#: The forms that are always looked for.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# Only the start of a run of digits can begin an address, so long runs are passed over once.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеѕіјорсухԛԝӏʟɡΑΒΕΖΗΙΚΜΝΟΡΤΥΧοıℓ∂",
        "ABESIJKMHOPCTYXaesijopcyxqwllgABEZHIKMNOPTYXoild",
    )
)
#: Characters without width, which are dropped.
INVISIBLE = set("­᠎​‌‍⁠﻿")
#: Digits written as words, and words for how often one counts.
SPELLED = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0", "plus": "+"}
TIMES = {"double": 2, "triple": 3}
#: Words before "at" that make it speech where nothing else of an address is disguised ("look at example.com").
SPEECH = set(
    """a about all and are arrive arrived available back be been being book booked bought browse buy call check chat click come contact
    details directly down everything find for found free get go going good happen have he help her here him home hosted i info
    information is it join just learn less listed live located look looked looking looks me meet more most mostly new not now of off
    offered on online only or order orders out over page pages point pointed pointing points post posted published purchase read
    register registered residing reside see seen she shop sign site sold staff stay still store subscribe support team that the them
    there these they this those today us up view visit was watch we website were while who work worked working works you""".split()
)

_WORDS = "|".join(SPELLED)
#: Between single words: up to three blanks.
_GAP = r"[ \t]{1,3}"
#: A sign in brackets takes the blanks around it with it.
_BRACKETED = r"(?<![ \t])[ \t]*[\[({{<][ \t]*{}[ \t]*[\])}}>][ \t]*"
_UNIT = rf"(?:(?:{'|'.join(TIMES)}){_GAP})?(?:{_WORDS})"
_SPELLED_DOT = rf"\.|{_GAP}dot{_GAP}|{_BRACKETED.format(r'(?:dot|[.])')}"
_RUN = re.compile(rf"\b{_UNIT}(?:(?:{_SPELLED_DOT}|[ \t,-]+)(?:{_UNIT}|[0-9]+))+\b", re.IGNORECASE)
_ONE = re.compile(rf"(?:({'|'.join(TIMES)}){_GAP})?({_WORDS}|[0-9]+)", re.IGNORECASE)
_SIGN = re.compile(_BRACKETED.format("(at|dot|[@.])"), re.IGNORECASE)
#: Signs of an address in any form, plain ones last; ``(a)`` is as weak a sign as a spoken one.
_AT = re.compile(
    rf"{_BRACKETED.format('(?:at|@)')}|(?P<weak>{_BRACKETED.format('a')})|(?P<spoken>{_GAP}at{_GAP})|(?P<plain>@)", re.IGNORECASE
)
_DOT = re.compile(rf"{_BRACKETED.format('(?:dot|[.])')}|(?P<spoken>{_GAP}dot{_GAP})|(?P<plain>\.)", re.IGNORECASE)
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_SPOKEN_IP = re.compile(rf"(?<![A-Za-z0-9_])[0-9]{{1,3}}(?:(?:{_GAP}dot{_GAP}|\.)[0-9]{{1,3}}){{3}}(?![A-Za-z0-9_])", re.IGNORECASE)
_SPOKEN_DOT = re.compile(rf"{_GAP}dot{_GAP}", re.IGNORECASE)
_SPOKEN_AT = re.compile(rf"[A-Za-z0-9._%+-]{_GAP}at{_GAP}[A-Za-z0-9-]+\.", re.IGNORECASE)


def emails(text: str):
    """Leftmost matches of a name, ``@`` and a domain, found from each ``@`` outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def identifiers(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, in order; matches that fail their kind's test are dropped."""
    found = {kind: [] for kind in KINDS}
    if "@" in text:
        found["email"] = list(emails(text))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found["ip"].append(m.span())
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found["phone"].append(m.span())
    return found


class Tape:
    """A text with the span in the source of each of its characters."""

    def __init__(self, text: str):
        self.text = text
        self.first = np.arange(len(text), dtype=np.int32)
        self.last = self.first + 1

    def rewrite(self, spans: list[tuple[int, int, str]]) -> None:
        """Replace spans, given in order; what is written stands for the whole span it replaces."""
        if not spans:
            return
        texts, firsts, lasts, done = [], [], [], 0
        for start, stop, new in spans:
            texts += [self.text[done:start], new]
            firsts += [self.first[done:start], np.full(len(new), self.first[start], np.int32)]
            lasts += [self.last[done:start], np.full(len(new), self.last[stop - 1], np.int32)]
            done = stop
        self.text = "".join(texts) + self.text[done:]
        self.first = np.concatenate([*firsts, self.first[done:]])
        self.last = np.concatenate([*lasts, self.last[done:]])


def letter(c: str) -> str:
    """A character without its disguise: look-alikes, wide and styled forms, digits of other scripts."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in INVISIBLE:
        return ""
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    plain = unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and plain.isascii() and plain.isprintable() and plain != " " else c


def letters(tape: Tape) -> None:
    if tape.text.isascii():
        return
    changed = {c: new for c in set(tape.text) if ord(c) > 127 and (new := letter(c)) != c}
    if changed:
        tape.rewrite([(i, i + 1, changed[c]) for i, c in enumerate(tape.text) if c in changed])


def spelled_digits(tape: Tape) -> None:
    """Runs of four digits in words or more, also over the dots of an address; the dots stay for ``signs``."""
    spans = []
    for run in _RUN.finditer(tape.text):
        parts = list(_ONE.finditer(tape.text, *run.span()))
        if len(parts) < 4:
            continue
        for here, after in zip(parts, [*parts[1:], None]):
            stop = after.start() if after else here.end()
            if _DOT.search(tape.text, here.end(), stop):
                stop = here.end()
            digit = SPELLED.get(here[2].lower(), here[2])
            spans.append((here.start(), stop, digit * TIMES.get((here[1] or "").lower(), 1)))
    tape.rewrite(spans)


def _domain(text: str, at: re.Match) -> list[re.Match]:
    """The signs within the domain after an at sign; none if there is no domain or nothing to undo in it.

    After a spoken at sign, or ``(a)``, the domain needs an ending in use, or a
    dot in brackets before the last label.  After another at sign a spoken dot
    may have any ending, but one in use goes before: what follows it is speech.
    """
    dots, known, bracketed, disguised = [], 0, 0, False
    label = _LABEL.match(text, at.end())
    while label and (dot := _DOT.match(text, label.end())):
        label = _LABEL.match(text, dot.end())
        if not label:
            break
        dots.append(dot)
        disguised = disguised or not dot["plain"]
        if (disguised or at["spoken"]) and label[0].lower() in ENDINGS:
            known = len(dots)
        if not dot["plain"] and not dot["spoken"]:
            bracketed = len(dots)
    if known:
        return dots[:known]
    if at["spoken"] or at["weak"]:
        return dots[:bracketed]
    return dots if dots and dots[0]["spoken"] else []


def _spoken_signs(text: str) -> list[tuple[int, int, str]]:
    """The spoken signs of whole addresses, whose other signs may be plain or in brackets."""
    before = {m.end(): m for m in _DOT.finditer(text) if not m["plain"]}
    spans, done = [], 0
    for at in _AT.finditer(text):
        dots = _domain(text, at)
        if not dots:
            continue
        start, left = at.start(), []
        while True:
            stop = start
            while start > done and LOCAL.match(text[start - 1]):
                start -= 1
            if start == stop:
                break
            dot = before.get(start)
            if not dot or dot.start() <= done or not LOCAL.match(text[dot.start() - 1]):
                break
            left.append(dot)
            start = dot.start()
        if start == at.start():
            continue
        if at["spoken"] and not left and all(m["plain"] for m in dots) and text[start : at.start()].lower() in SPEECH:
            continue
        weak = at["spoken"] or at["weak"]
        spans += [(*m.span(), ".") for m in reversed(left) if m["spoken"]]
        spans += [(*at.span(), "@")] if weak else []
        spans += [(*m.span(), ".") for m in dots if m["spoken"]]
        done = dots[-1].end()
    return spans


def signs(tape: Tape) -> None:
    """``[at]``, ``(dot)``, ``{@}``, ``[.]`` and, in an address, spoken signs and ``(a)``, in any mix."""
    low = tape.text.lower()
    if "at" in low or "dot" in low or _SIGN.search(tape.text):
        tape.rewrite(_spoken_signs(tape.text))
        tape.rewrite([(*m.span(), "@" if m[1].lower() in ("at", "@") else ".") for m in _SIGN.finditer(tape.text)])
    if "dot" in low:
        tape.rewrite([(*m.span(), ".") for whole in _SPOKEN_IP.finditer(tape.text) for m in _SPOKEN_DOT.finditer(tape.text, *whole.span())])


def undisguised(text: str) -> Tape:
    tape = Tape(text)
    for transducer in (letters, spelled_digits, signs):
        transducer(tape)
    return tape


def _disguised(text: str) -> bool:
    """May a transducer change the text?  Cheap, and never wrongly no."""
    if not text.isascii():
        try:
            if not set(text.encode("latin-1")).isdisjoint((0xAD, 0xB2, 0xB3, 0xB9, 0xAA, 0xBA)):
                return True
        except UnicodeEncodeError:
            return True
    return any(bool(form.search(text)) for form in (_SPOKEN_DOT, _SPOKEN_AT, _SIGN, _RUN))


def find(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Spans of the plain forms, and all spans with those of disguised ones."""
    base = identifiers(text)
    everything = {kind: list(spans) for kind, spans in base.items()}
    if _disguised(text):
        tape = undisguised(text)
        if tape.text != text:
            for kind, spans in identifiers(tape.text).items():
                for start, stop in spans:
                    a, b = int(tape.first[start]), int(tape.last[stop - 1])
                    if text[a:b] != tape.text[start:stop] and not any(x < b and a < y for x, y in everything[kind]):
                        everything[kind].append((a, b))
                everything[kind].sort()
    return base, everything


def _listed(found: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in found[kind])


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts and spans of personal data for every document: the plain forms, and those that disguises hide.

    In an address every sign may be plain, in brackets (``[at]``, ``{@}``,
    ``(a)``, ``[.]``) or spoken between up to three blanks, in any mix and with
    any number of labels.  Speech is told from addresses by an ending in use
    (``endings``), or by another sign that is plain or in brackets; where "at"
    alone is spoken, the word before it must not be one that goes before "at"
    in speech (``SPEECH``).  Digits in words count from four on, also over the
    dots of an address and with ``double`` and ``triple``.  An added span covers
    the disguised characters and never overlaps a plain one of its kind.  Null
    texts count as empty, long ones are read whole; repeated rows and null ids
    are kept; an empty table gives no rows.  Only id and text are read.
    """

    def function(texts):
        made = {name: [] for name in [f"n_{k}" for k in KINDS] + ["base_sha256", "spans"]}
        for text in texts:
            base, everything = find(text)
            for kind in KINDS:
                made[f"n_{kind}"].append(len(base[kind]))
            made["base_sha256"].append(hashlib.sha256(_listed(base).encode()).hexdigest())
            made["spans"].append(_listed(everything))
        return made

    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    fields += [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    return map_texts(ids_and_texts(docs), function, T.StructType(fields))
