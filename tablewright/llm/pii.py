"""Personal data in text, disguised forms included, with places in the source.

Plain identifiers are found in the text as it is. A text with signs of disguise also passes
a chain of transducers, each of which rewrites characters and keeps, for every character it
puts out, the stretch of source that it stands for: look-alike characters to ASCII, spelled
digits to digits, at/dot disguises to ``@`` and ``.``. The same detectors run over the
outcome, and spans that came from rewritten characters are mapped back to the source.

Kinds and their rules: ``email``; ``ip`` (four parts of at most 255); ``card`` (12 to 19
digits that pass Luhn's check); ``phone`` (``+`` and 9 to 15 digits). Matches are the
leftmost ones of each kind and do not overlap; a match that fails its check is dropped.
All scans take time in proportion to the text.

Defined cases: a null text counts as empty and has no spans; start and end count code
points, the end is exclusive; a disguised span that overlaps a plain one of its kind is
dropped; equal rows give equal spans; other columns pass through.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.common import quoted

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DIGIT = re.compile("[0-9]")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def emails(text: str):
    """Spans of ``[A-Za-z0-9._%+-]+@`` and a dotted domain, found from each ``@``."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def ips(text: str):
    """Four dotted numbers at a time, from the left of each dotted chain."""
    for chain in _CHAIN.finditer(text):
        parts, at = chain.group().split("."), chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield at, at + size
            at += size + 1


def cards(text: str):
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str):
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                yield m.span()


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all plain identifiers, sorted."""
    found = [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for kind, scan in ((1, ips), (2, cards), (3, phones)):
            found += [(a, kind, b) for a, b in scan(text)]
    return sorted(found)


#: Letters of other scripts that look like ASCII ones.
LOOKALIKES = dict(zip(
    "аАВсСеЕНіІјЈкКмМоОрРѕЅТуУхХԁԛԝ" "αΑΒεΕΗιΙκΚΜνΝοΟρΡτΤυΥχΧΖ" "ıɑɡ",
    "aABcCeEHiIjJkKmMoOpPsSTyYxXdqw" "aABeEHiIkKMvNoOpPtTuYxXZ" "iag"))
#: Dashes and invisible characters.
DASHES = "‐‑‒–—−"
INVISIBLE = "­​‌‍⁠﻿"
#: Names of the digits, and top-level domains that make a bare "at" an address.
DIGIT_NAMES = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
               "six": "6", "seven": "7", "eight": "8", "nine": "9"}
TOP_LEVEL = "com org net edu gov info io co de fr es uk eu".split()

_ODD = re.compile("[ ­ıɐ-￿\U00010000-\U0010ffff]")
_PUT = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789@.+-_%() ")
#: Between the parts of a disguise stand three white characters at most (scans stay linear).
_AT = r"(?:\s{0,3}[\[({<]\s{0,3}(?:at|@)\s{0,3}[\])}>]\s{0,3})"
_DOT = r"(?:\s{0,3}[\[({<]\s{0,3}(?:dot|punkt|punto|point|\.)\s{0,3}[\])}>]\s{0,3}|\s{1,3}dot\s{1,3})"
_DIGIT_WORD = r"(?:" + "|".join(DIGIT_NAMES) + r")"
_SPELLED = re.compile(
    rf"(?:\bplus\s{{1,3}}|\+\s{{0,3}})?\b(?:{_DIGIT_WORD}|[0-9]+)\b(?:(?:[\s,-]{{1,3}}|{_DOT}|\.)\b(?:{_DIGIT_WORD}|[0-9]+)\b){{3,}}", re.I)
_SPELLED_PART = re.compile(rf"(\bplus\s{{1,3}}|\+\s{{0,3}})|({_DOT}|\.)|({_DIGIT_WORD})|([0-9])|[\s,-]{{1,3}}", re.I)
_DISGUISE = re.compile(
    rf"({_AT}|(?<=[A-Za-z0-9])\s{{1,3}}(?:at|@)\s{{1,3}}(?=[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+|\.(?:{'|'.join(TOP_LEVEL)})\b))"
    rf"|(?<=[A-Za-z0-9])\s{{1,3}}@\s{{0,3}}(?=[A-Za-z0-9])|@\s{{1,3}}(?=[A-Za-z0-9-]+\.[A-Za-z0-9]))|({_DOT}(?=[A-Za-z0-9]))", re.I)
#: Each match of _DISGUISE holds an "@" or a match of one of these, which are quicker to search.
_BRACKETED = re.compile(r"[\[({<]\s{0,3}(?:at|@|dot|punkt|punto|point|\.)\s{0,3}[\])}>]", re.I)
_BARE = re.compile(r"\s(?:at|dot)\s", re.I)


class Tape:
    """Characters and the stretch of source that each stands for."""

    def __init__(self, chars, starts, ends):
        self.chars, self.starts, self.ends = chars, starts, ends

    @classmethod
    def of(cls, text: str) -> "Tape":
        n = len(text)
        return cls(list(text), list(range(n)), list(range(1, n + 1)))

    def text(self) -> str:
        return "".join(self.chars)

    def rewrite(self, edits) -> "Tape":
        """``edits``: (start, end, replacement) in order, over the present characters. Each
        character of a replacement stands for all of the stretch; an empty one removes it."""
        out, at = Tape([], [], []), 0
        for a, b, new in edits:
            out._copy(self, at, a)
            for ch in new:
                out.chars.append(ch)
                out.starts.append(self.starts[a])
                out.ends.append(self.ends[b - 1])
            at = b
        out._copy(self, at, len(self.chars))
        return out

    def _copy(self, other, a, b):
        for mine, theirs in ((self.chars, other.chars), (self.starts, other.starts), (self.ends, other.ends)):
            mine += theirs[a:b]


def _plain_char(ch: str) -> str | None:
    """The ASCII stand-in of a character, '' to drop it, None to leave it."""
    if ch in INVISIBLE:
        return ""
    if ch in DASHES:
        return "-"
    if ch in LOOKALIKES:
        return LOOKALIKES[ch]
    flat = unicodedata.normalize("NFKC", ch)
    if flat in DASHES:
        return "-"
    return flat if flat != ch and len(flat) == 1 and flat in _PUT else None


def homoglyph_edits(text: str):
    for m in _ODD.finditer(text):
        new = _plain_char(m.group())
        if new is not None:
            yield m.start(), m.end(), new


def digit_edits(text: str):
    """Chains of four and more digit words and numbers with at least three words."""
    for m in _SPELLED.finditer(text):
        parts = list(_SPELLED_PART.finditer(text, m.start(), m.end()))
        if sum(p.lastindex == 3 for p in parts) < 3:
            continue
        for p in parts:
            if p.lastindex == 1:
                yield *p.span(), "+"
            elif p.lastindex == 2 and p.group() != ".":
                yield *p.span(), "."
            elif p.lastindex == 3:
                yield *p.span(), DIGIT_NAMES[p.group().lower()]
            elif p.lastindex is None:
                yield *p.span(), ""


def disguise_edits(text: str):
    for m in _DISGUISE.finditer(text):
        yield *m.span(), "@" if m.lastindex == 1 else "."


def signs(text: str) -> tuple[bool, bool, bool]:
    """Whether look-alikes, spelled digits, and at/dot disguises may occur."""
    odd = not text.isascii() and _ODD.search(text) is not None
    low = text.lower()
    digits = sum(low.count(w) for w in DIGIT_NAMES) > 2
    marks = ("@" in text or _BRACKETED.search(text) or _BARE.search(text)) and _DISGUISE.search(text)
    return odd, digits, bool(marks)


def disguised(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in the source of identifiers that some rewriting has revealed."""
    odd, digits, marks = signs(text)
    tape = Tape.of(text) if odd or digits or marks else None
    if tape is None:
        return []
    edited = False
    for step in ([homoglyph_edits] if odd else []) + [digit_edits, disguise_edits]:
        if step is homoglyph_edits or digits or marks or edited:
            found = list(step(tape.text()))
            if found:
                tape, edited = tape.rewrite(found), True
    if not edited:
        return []
    clear = tape.text()
    places = [(tape.starts[a], kind, tape.ends[b - 1], clear[a:b]) for a, kind, b in detect(clear)]
    return [(a, kind, b) for a, kind, b, read in places if text[a:b] != read]


def spans_of(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, disguised), sorted by start and kind."""
    base = detect(text)
    out = [(a, k, b, False) for a, k, b in base]
    for a, k, b in disguised(text):
        if not any(k == k2 and a < b2 and a2 < b for a2, k2, b2 in base):
            out.append((a, k, b, True))
    return sorted(set(out))


def find_spans(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """``docs`` with the spans of each whole text, sorted by start and kind."""
    @F.arrow_udf("array<struct<kind: string, start: int, end: int, disguised: boolean>>")
    def run(text: pa.Array) -> pa.Array:
        out = [[{"kind": KINDS[k], "start": a, "end": b, "disguised": d} for a, k, b, d in spans_of(t.as_py() or "")]
               for t in text]
        return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                                 ("disguised", pa.bool_())])))

    return docs.withColumn(spans_col, run(quoted(docs, text_col).cast("string")))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str) -> str:
    """``text`` with each stretch of personal data replaced by the name of its kind."""
    out, at = [], 0
    for a, k, b, _ in spans_of(text):
        if b > at:
            out.append(text[at:max(a, at)] + f"<{KINDS[k]}>" if a >= at else "")
            at = b
    return "".join(out) + text[at:]


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in its text (a null text stays null)."""
    @F.arrow_udf("string")
    def run(text: pa.Array) -> pa.Array:
        return pa.array([None if t.as_py() is None else masked(t.as_py()) for t in text], pa.string())

    return docs.withColumn(text_col, run(quoted(docs, text_col).cast("string")))
