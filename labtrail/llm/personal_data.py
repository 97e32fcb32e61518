"""Personal data in whole texts, disguised identifiers included, with offsets in the source text.

The base rules find plain e-mail addresses, IP addresses, card numbers and
phone numbers.  Then transducers rewrite the text and keep, for each character
they write, the source characters it stands for:

* *characters*: full-width forms and look-alike letters of other scripts become
  ASCII, digits of any script become 0-9, invisible characters vanish;
* *digits*: runs of spelled digits ("four two oh") become figures;
* *separators*: "(at)", "[dot]" and the like become ``@`` and ``.`` first, then
  bare "at" and "dot" do in a chain such as "name at host dot org", whichever
  of its marks are bare, were rewritten or stood there as ``@`` and ``.``.

The same rules run on the rewritten text and their spans are mapped back.  A
span is added only if it holds a rewritten character and doesn't overlap a base
span; base spans are never changed.

Texts without a character, digit run or chain that a transducer would rewrite
skip the second search, whose result would be empty.  Every expression runs in
time linear in the text.  All work is per row: no shuffle.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from labtrail.llm.common import arrow_schema, row_batches

KINDS = ["email", "ip", "card", "phone"]
SPANS = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
    "n_added long, entities array<struct<kind:string,start:long,end:long,added:boolean,value:string>>"
)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a run of digits that doesn't begin a match can't begin one further on either
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_TWO_DIGITS = re.compile(r"[0-9][\x20-]?[0-9]").search


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping.  Each match holds one ``@``: go from one to the next."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        host = _HOST.match(text, at + 1) if begin < at else None
        if host:
            found.append((begin, host.end()))
        # characters before a later @ can't be part of two matches, nor be looked at again
        free = host.end() if host else at + 1
        at = text.find("@", free)
    return found


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) by the base rules, in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    # a phone number's digits may be any number of separators apart
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    if not _TWO_DIGITS(text) and "." not in text:
        return sorted(out)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NO_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    return sorted(out)


# fixed values: look-alikes of Latin letters, by script
LOOK_ALIKES = dict(zip("абсԁеһіјкӏмոорԛѕтԝхуАВСЕНІЈКМОРЅТХУαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abcdehijklmnopqstwxyABCEHIJKMOPSTXYaeiknoptuxABEZHIKMNOPTYX"))
# fixed values: spelled digits
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
# fixed values: characters without width
INVISIBLE = "­​‌‍⁠﻿"


def _character(c: str) -> str:
    """What a character becomes: itself, an ASCII character, or nothing."""
    if c in INVISIBLE:
        return ""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    digit = unicodedata.decimal(c, None)
    return c if digit is None else str(digit)


#: Characters that the first transducer may rewrite: all but ASCII and the Latin letters above it.
_STRANGE = re.compile(r"[^\x00-\x7fÀ-ɏ]+")
_WORD = "|".join(SPELLED)
_CHAIN = re.compile(rf"(?<![A-Za-z])(?:{_WORD})(?:[\x20-](?:{_WORD}))++(?![A-Za-z])", re.I)
_SPELLED_WORD = re.compile(r"[A-Za-z]+")
_HUSHED = re.compile(r"\x20?(?:[\[({<]\x20?(at|dot)\x20?[\])}>])\x20?", re.I)
_ANY_AT, _BARE_DOT = re.compile(r"@|\x20at\x20", re.I), re.compile(r"\x20dot\x20", re.I)
_ANY_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\.|\x20dot\x20)[0-9]{1,3}){3}(?![0-9])", re.I)
#: Lower-case strings of which a text must hold one before a chain of spelled digits, or a disguised separator, can be in it.
_DIGIT_SIGNS = [w for w in SPELLED if w not in ("one", "oh")] + [f"{a}{s}{b}" for a in ("one", "oh") for s in " -" for b in ("one", "oh")]
_BARE_SIGNS = [" at ", " dot "]
_SEPARATOR_SIGNS = [f"{w}{s}{c}" for w in ("at", "dot") for s in ("", " ") for c in "])}>"]
_NAME_BEFORE = re.compile(r"[A-Za-z0-9._%+-]")
_ANY_HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\x20dot\x20)[A-Za-z0-9-]++)+", re.I)
#: The last part of a host name.  After a bare "at", a figure such as 10.30 is no host.
_TOP = re.compile(r"\.[A-Za-z]{2,}\Z")


class _Mapped:
    """A text being rewritten.  ``cuts`` maps places: character ``k`` came from source[begin[k]:end[k]]."""

    def __init__(self, text: str):
        self.text, self.begin, self.end, self.touched = text, None, None, None

    def rewrite(self, changes: list[tuple[int, int, str]]) -> None:
        """Replace text[start:end]; in order, not overlapping."""
        if not changes:
            return
        if self.begin is None:
            n = len(self.text)
            self.begin, self.end, self.touched = list(range(n)), list(range(1, n + 1)), bytearray(n)
        text, begin, end, touched, at = [], [], [], bytearray(), 0
        for start, stop, new in changes:
            text += self.text[at:start], new
            begin += self.begin[at:start]
            end += self.end[at:start]
            touched += self.touched[at:start]
            same = len(new) == stop - start
            for k in range(len(new)):
                begin.append(self.begin[start + k] if same else self.begin[start])
                end.append(self.end[start + k] if same else self.end[stop - 1])
                touched.append(1)
            at = stop
        text.append(self.text[at:])
        begin += self.begin[at:]
        end += self.end[at:]
        touched += self.touched[at:]
        self.text, self.begin, self.end, self.touched = "".join(text), begin, end, touched


def _spelled_changes(text: str) -> list[tuple[int, int, str]]:
    # word by word, so that figures keep the places of their words
    return [
        (m.start() + w.start(), m.start() + w.end(), SPELLED[w.group().lower()])
        for m in _CHAIN.finditer(text)
        for w in _SPELLED_WORD.finditer(m.group())
    ]


def _hushed_changes(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "@" if m.group(1).lower() == "at" else ".") for m in _HUSHED.finditer(text)]


def _bare_changes(text: str) -> list[tuple[int, int, str]]:
    changes, free = [], 0
    for m in _ANY_AT.finditer(text):
        if m.start() < free or not m.start() or not _NAME_BEFORE.match(text[m.start() - 1]):
            continue
        host = _ANY_HOST.match(text, m.end())
        if not host:
            continue
        if m.group() != "@" and not _BARE_DOT.search(host.group()) and not _TOP.search(host.group()):
            continue
        # "first dot last at ...": dots on the left, one short word before another
        left, name = m.start(), []
        while True:
            word = left
            while word > free and text[word - 1] in _LOCAL:
                word -= 1
            if word == left or not word - 5 >= free or text[word - 5 : word].lower() != " dot ":
                break
            name.append((word - 5, word, "."))
            left = word - 5
        changes += name if m.group() == "@" else [*name, (m.start(), m.end(), "@")]
        changes += [(d.start(), d.end(), ".") for d in _BARE_DOT.finditer(text, m.end(), host.end())]
        free = host.end()
    for m in _ANY_IP.finditer(text):
        changes += [(d.start(), d.end(), ".") for d in _BARE_DOT.finditer(text, m.start(), m.end())]
    out, free = [], 0
    for start, stop, new in sorted(set(changes)):
        if start >= free:
            out.append((start, stop, new))
            free = stop
    return out


def deobfuscated(text: str) -> _Mapped:
    """The rewritten text and the source characters of each of its characters."""
    out = _Mapped(text)
    strange = [] if text.isascii() else [
        (m.start() + k, m.start() + k + 1, new)
        for m in _STRANGE.finditer(text)
        for k, c in enumerate(m.group())
        if (new := _character(c)) != c
    ]
    out.rewrite(strange)
    lower = out.text.lower()
    if any(sign in lower for sign in _DIGIT_SIGNS):
        out.rewrite(_spelled_changes(out.text))
    if any(sign in lower for sign in _SEPARATOR_SIGNS):
        out.rewrite(_hushed_changes(out.text))
        lower = out.text.lower()
    if any(sign in lower for sign in _BARE_SIGNS):
        out.rewrite(_bare_changes(out.text))
    return out


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the source that the base rules find only in the rewritten text."""
    mapped = deobfuscated(text)
    if mapped.begin is None:
        return []
    out, starts = [], [s for s, _, _ in base]
    longest = max((e - s for s, _, e in base), default=0)
    for s, kind, e in plain_spans(mapped.text):
        start, end = mapped.begin[s], mapped.end[e - 1]
        if end - start == e - s and not any(mapped.touched[s:e]):
            continue  # stands in the source as it is
        near = base[bisect_left(starts, start - longest) : bisect_left(starts, end)]
        if not any(b < end and start < c for b, _, c in near):
            out.append((start, kind, end))
    return sorted(set(out))


def _shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts and digest of the base spans, all spans, and each span's text.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  The
    counts and ``base_sha256`` are those of the base rules; ``spans`` has base
    and added spans by start, then kind; ``n_added`` counts the added ones and
    ``entities`` has all with their source text.  A null or empty text has
    none.  Repeated rows give repeated rows; an empty table gives none.
    """
    out = arrow_schema(SPANS)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                base = plain_spans(text)
                added = added_spans(text, base)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(4)]
                spans = sorted([(s, k, e, False) for s, k, e in base] + [(s, k, e, True) for s, k, e in added])
                found = [{"kind": KINDS[k], "start": s, "end": e, "added": new, "value": text[s:e]} for s, k, e, new in spans]
                digest = hashlib.sha256(_shown(base).encode()).hexdigest()
                rows.append((doc_id, *counts, digest, _shown([x[:3] for x in spans]), len(added), found))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return docs.select("doc_id", "text").mapInArrow(search, SPANS)
