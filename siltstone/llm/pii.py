"""Personal data with offset-preserving deobfuscation.

Base patterns run on the source text.  Then a chain of transducers rewrites it:
characters (look-alikes, full-width and other compatibility forms, digits of
other scripts, zero-width characters, entities), spelled digits, and at/dot disguises.
Each keeps for every character written the source offsets it stands for, so
what the same patterns find in the rewritten text maps back to source spans.
Spans that a rewriting changed and that no base span contains are added.
Digits are spelled in four languages, in runs of at least ``RUN``; a local part
before a spelled at-sign is sought within ``LOCAL_REACH`` code points.

Defined results: a null text counts as empty; every row gives one row; rows
that repeat give equal rows; extra columns are ignored; an empty table gives no
rows.  All scans are linear in the text (possessive runs, no retries).
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def emails(text: str) -> list[Span]:
    """Leftmost matches: the local part is the whole run before an @ that a dotted host follows."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        start = at
        if m:
            while start > done and _LOCAL.match(text, start - 1):
                start -= 1
            if start < at:
                out.append((start, m.end()))
                done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def ips(text: str) -> list[Span]:
    """Each four groups of a dotted run are one match; a part over 255 drops it."""
    out = []
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        groups, at = m.group().split("."), m.start()
        for k in range(0, len(groups) - 3, 4):
            four = groups[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or "0") <= 255 for g in four):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m.group())) <= 15] if "+" in text else []


FINDERS: dict[str, Callable[[str], list[Span]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}

# Letters that look like a Latin one.
_LOOKALIKES = dict(zip("аАвВсСԁеЕһНіІјЈкКмМоОрРԛѕЅтТԝхХуУαΑΒεΕΖΗιΙκΚΜνΝοΟρΡτΤυΥΧγ", "aABBcCdeEhHiIjJkKmMoOpPqsStTwxXyYaABeEZHiIkKMvNoOpPtTuYXy", strict=True))
# Dashes, dots and spaces, and characters that show nothing.
_PUNCTUATION = {**dict.fromkeys("‐‑‒–—−", "-"), **dict.fromkeys("․。｡", "."), **dict.fromkeys("   ", " "), **dict.fromkeys("​‌‍⁠﻿­", "")}
# Digits spelled in English, German, French and Spanish.
_SPELLED = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
#: Digits or groups of digits, one of them spelled, that must follow each other to count as digits.
RUN = 3
#: Code points before a spelled at-sign in which the local part is sought, and in which a word may announce an address.
LOCAL_REACH, CUE_REACH = 160, 40
# Spelled signs in those languages, and top-level names that a disguised address ends in, beside all of two letters.
_AT_WORDS, _DOT_WORDS = "at|arroba", "dot|point|punkt|punto"
_TOP = frozenset("com org net edu gov mil int info biz name pro app dev xyz site online shop store tech cloud blog".split())
# Words that announce an address, and words that often stand before a plain "at" and are no local part.
_CUES = "e-?mail|mail|contact|write to|reach|address|correo|courriel|kontakt|adresse|escribe a"
_NO_LOCAL = frozenset("look looks looking looked meet see seen arrive arrived be is was are were stay shop buy bought available found find hosted live work works working here there us me them it visit check read more call".split())

# Two-letter top-level names that are words of prose; a plain "at" before them says little.
_WORDY = frozenset("it is me to in so no be at my as us am do".split())


def _character_map() -> dict[str, str]:
    out = {**_LOOKALIKES, **_PUNCTUATION}
    for cp in [*range(0xA1, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F170)]:
        c = chr(cp)
        if c in out:
            continue
        plain = unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and " " < plain < "\x7f":
            out[c] = plain
        elif (d := unicodedata.decimal(c, None)) is not None:
            out[c] = str(d)
    return out


_CHARACTERS = _character_map()
_DIGIT_WORDS = [dict(zip(words.split(), "0123456789", strict=True)) for words in _SPELLED]
_SPELLED_RUNS = [re.compile(rf"(?i)(?:\bplus[ -])?(?<!\w)(?:{'|'.join(w)}|[0-9]+)\b(?:(?:[ -]|, ?|\.| (?:{_DOT_WORDS}) )(?:{'|'.join(w)}|[0-9]+)\b){{{RUN - 1},}}") for w in _DIGIT_WORDS]
_PIECE = re.compile(rf"plus[ -]|\w+|, ?| (?:{_DOT_WORDS}) |[ .-]", re.IGNORECASE)

# A sign in brackets, between dashes, or spelled as a word; a dot may also stand alone, and between spaces.
_STRONG_AT = rf"\s?[\[({{<]\s?(?:{_AT_WORDS}|@)\s?[\])}}>]\s?|\s?[-_*]{{1,3}}(?:{_AT_WORDS})[-_*]{{1,3}}\s?"
_STRONG_DOT = rf"\s?[\[({{<]\s?(?:{_DOT_WORDS}|\.)\s?[\])}}>]\s?|\s?[-_*]{{1,3}}(?:{_DOT_WORDS})[-_*]{{1,3}}\s?|\s(?:{_DOT_WORDS})\s"
_AT = re.compile(rf"(?i)(?P<strong>{_STRONG_AT})|(?P<open>\s@\s?|@\s)|(?P<word>\s(?:{_AT_WORDS})\s)")
_LABEL = re.compile(rf"(?i)[a-z0-9]+(?:-(?!(?:{_DOT_WORDS})-)[a-z0-9]+)*")
_DOT = re.compile(rf"(?i)(?P<strong>{_STRONG_DOT})|(?P<open>\s\.\s|\s\.|\.\s)|\.")
_LOCAL_DOT = re.compile(rf"(?i){_STRONG_DOT}")
_LOCAL_PART = re.compile(rf"(?i)(?:(?<![a-z0-9])(?:[a-z0-9]\s){{2,}}[a-z0-9]|(?:[a-z0-9%+_-]+(?:\.|{_STRONG_DOT}))*[a-z0-9._%+-]+)\Z")
_EDGES = frozenset(["", *"\n\t:;,<>()[]\"'!?"])
_CUE = re.compile(rf"(?i)\b(?:{_CUES})\b")
_IP = re.compile(rf"(?i)\b[0-9]{{1,3}}(?:(?:{_STRONG_DOT}|\s\.\s|\.)[0-9]{{1,3}}){{3}}\b")
_IP_DOT = re.compile(rf"(?i){_STRONG_DOT}|\s\.\s")
_SPACED_DOT = re.compile(r"[\[({<]\s?\.|\s\.\s")
_TOKEN = re.compile(r"\w+")
_ENTITY = re.compile(r"&(?:#0*+([0-9]{2,3})|#[xX]0*+([0-9a-fA-F]{2})|(commat)|(period));")
_CAPITAL_AT = re.compile(r"(?<=[a-z0-9])AT(?=[a-z0-9])")
_CAPITAL_DOMAIN = re.compile(r"[a-z0-9-]++(?:DOT[a-z0-9-]++)++")


class Text:
    """A rewritten text; character i stands for source characters starts[i] to ends[i]."""

    def __init__(self, text: str):
        self.text = text
        self.starts = np.arange(len(text), dtype=np.int64)
        self.ends = self.starts + 1
        self.changed = False

    def rewrite(self, found: list[tuple[int, int, str]]) -> None:
        """Replace (start, end, new) spans, given in order; new characters share the span's source."""
        if not found:
            return
        text, starts, ends, at = [], [], [], 0
        for s, e, new in found:
            text += [self.text[at:s], new]
            starts += [self.starts[at:s], np.full(len(new), self.starts[s])]
            ends += [self.ends[at:s], np.full(len(new), self.ends[e - 1])]
            at = e
        text.append(self.text[at:])
        self.text = "".join(text)
        self.starts = np.concatenate([*starts, self.starts[at:]])
        self.ends = np.concatenate([*ends, self.ends[at:]])
        self.changed = True


def _characters(t: Text) -> None:
    if not t.text.isascii() and (present := _CHARACTERS.keys() & set(t.text)):
        t.rewrite([(m.start(), m.end(), _CHARACTERS[m.group()]) for m in re.finditer("[" + "".join(map(re.escape, present)) + "]", t.text)])


def _entities(t: Text) -> None:
    """Printable ASCII characters written as entities."""
    found = []
    for m in _ENTITY.finditer(t.text) if "&" in t.text else ():
        code = int(m[1]) if m[1] else int(m[2], 16) if m[2] else ord("@" if m[3] else ".")
        if 32 < code < 127:
            found.append((m.start(), m.end(), chr(code)))
    t.rewrite(found)


def _capitals(t: Text) -> None:
    """Signs as capitals between small letters: nameATexampleDOTcom."""
    found: list[tuple[int, int, str]] = []
    for m in _CAPITAL_AT.finditer(t.text) if "DOT" in t.text else ():
        d = _CAPITAL_DOMAIN.match(t.text, m.end())
        name = d.group().rpartition("DOT")[2] if d else ""
        if name in _TOP or (len(name) == 2 and name.isalpha()):
            found.append((m.start(), m.end(), "@"))
            found += [(x.start(), x.end(), ".") for x in re.compile("DOT").finditer(t.text, d.start(), d.end())]
    t.rewrite(found)


def _spelled(t: Text) -> None:
    present = set(_TOKEN.findall(t.text.lower()))  # a spelled digit of a run is a token of its own
    for words, run in zip(_DIGIT_WORDS, _SPELLED_RUNS, strict=True):
        if present.isdisjoint(words):
            continue
        found = []
        for m in run.finditer(t.text):
            pieces = [(p.start(), p.end(), p.group().lower()) for p in _PIECE.finditer(t.text, m.start(), m.end())]
            if not any(p in words for _, _, p in pieces):
                continue
            dotted = any(len(p) > 2 and p[0] == " " for _, _, p in pieces)  # then digits of one group stand together
            for s, e, p in pieces:
                if p in (" ", "-"):
                    new = "" if dotted else None
                elif p[:4] == "plus":
                    new = "+"
                else:
                    new = words.get(p, " " if p[0] == "," else "." if p[0] == " " else None)
                if new is not None:
                    found.append((s, e, new))
        t.rewrite(found)


def _domain(text: str, at: int) -> tuple[list[re.Match], bool]:
    """(dots, whether one is disguised) of the longest domain from ``at`` on that ends in a top-level name; no dots where there is none."""
    dots: list[re.Match] = []
    whole = 0
    label = _LABEL.match(text, at)
    while label and (dot := _DOT.match(text, label.end())) and (label := _LABEL.match(text, dot.end())):
        dots.append(dot)
        name = label.group().lower()
        if name in _TOP or (len(name) == 2 and name.isalpha()):
            whole = len(dots)
    return dots[:whole], any(d.lastgroup == "strong" for d in dots[:whole])


def _may_spell(text: str) -> tuple[bool, bool]:
    """Whether a text has what a disguised address needs, and what a dotted number with a disguised dot does."""
    lower = text.lower()
    present = set(_TOKEN.findall(lower))
    at, dot = (not present.isdisjoint(words) or any(f"_{w}_" in lower for w in words) for words in (_AT_WORDS.split("|"), _DOT_WORDS.split("|")))
    plain = any(part[:1].isalnum() for part in lower.split(".")[1:])
    sign = " . " in text or any(f"{c}{s}." in text for c in "[({<" for s in ("", " "))
    return "@" in text or (at and (dot or plain or sign)), dot or sign or bool(_SPACED_DOT.search(text) if "." in text else None)


def _believed(text: str, at: re.Match, local: re.Match, last: re.Match, dotted: bool) -> bool:
    """Whether an unmarked at-sign makes an address; dotted: a dot after it is disguised too.

    With plain dots only what is announced, looks like a local part or stands
    alone counts.  Before a plain "at", words of prose on either side must be
    outweighed: by the shape of the local part, or by a cue or blanks around.
    """
    said, before, after = local.group(), text[max(0, local.start() - CUE_REACH) : local.start()].rstrip(" "), text[last.end() : last.end() + CUE_REACH].lstrip(" .")
    prose = at.lastgroup == "word"
    if re.search(r"[0-9._+]|^\w\s", said) and (not prose or any(c.isalpha() for c in said)):
        return True
    if prose and said.lower() in _NO_LOCAL:
        return False
    ended = after[:1] in _EDGES
    wordy = prose and (last.group().lower() in _WORDY or _LABEL.match(text, at.end()).group().isdigit())
    alone = before[-1:] in _EDGES and said.lower() not in _NO_LOCAL and (ended or not prose)
    if dotted:
        return not wordy or alone or bool(_CUE.search(before))
    return (bool(_CUE.search(before)) and (ended or not wordy)) or (alone and not wordy)


def _at_dot(t: Text) -> None:
    """Write @ and . where an address or a dotted number is spelled out."""
    text, found, done = t.text, [], 0
    address, number = _may_spell(text)
    for m in _AT.finditer(text) if address else ():
        dots, spelled = _domain(text, m.end())
        if m.lastgroup != "open" and (cut := next((i for i, d in enumerate(dots) if d.lastgroup == "open"), None)) is not None:
            dots = dots[:cut]
            if dots and not (name := _LABEL.match(text, dots[-1].end()).group().lower()) in _TOP and not (len(name) == 2 and name.isalpha()):
                dots = []
        floor = max(done, m.start() - LOCAL_REACH)
        local = _LOCAL_PART.search(text, floor, m.start()) if dots else None
        if local is None:
            continue
        last = _LABEL.match(text, dots[-1].end())
        if m.lastgroup != "strong" and not _believed(text, m, local, last, spelled or any(d.lastgroup == "open" for d in dots)):
            continue
        if re.fullmatch(r"(?:\w\s)+\w", local.group()):
            found += [(i, i + 1, "") for i in range(local.start() + 1, local.end(), 2)]
        else:
            found += [(d.start(), d.end(), ".") for d in _LOCAL_DOT.finditer(text, local.start(), local.end())]
        found.append((m.start(), m.end(), "@"))
        found += [(d.start(), d.end(), ".") for d in dots if d.lastgroup]
        done = last.end()
    t.rewrite(found)
    if number:
        t.rewrite([(p.start(), p.end(), ".") for m in _IP.finditer(t.text) for p in _IP_DOT.finditer(t.text, m.start(), m.end())])


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    return sorted(((s, e, k) for k in KINDS for s, e in FINDERS[k](text)), key=lambda x: (x[0], KINDS.index(x[2])))


def added_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that only the rewritten text shows."""
    t = Text(text)
    for transducer in (_characters, _entities, _spelled, _capitals, _at_dot):
        transducer(t)
    if not t.changed:
        return []
    starts = [s for s, _, _ in base]
    reach = list(accumulate((e for _, e, _ in base), max))  # the furthest end of the base spans up to each
    out: list[tuple[int, int, str]] = []  # apart from each other, in order
    for kind in KINDS:
        taken, new, last = [s for s, _, _ in out], [], 0
        for s, e in FINDERS[kind](t.text):
            start, end = int(t.starts[s]), int(t.ends[e - 1])
            i, k = bisect_right(starts, start), bisect_left(taken, end)
            if text[start:end] == t.text[s:e] or (i and reach[i - 1] >= end) or (k and out[k - 1][1] > start) or start < last:
                continue
            new.append((start, end, kind))
            last = end
        out = sorted(out + new)
    return out


def _join(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def analyse(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, added spans) of a whole text."""
    base = base_spans(text or "")
    return base, added_spans(text or "", base)


def redact(text: str | None) -> str:
    """The text with each span written as <KIND>."""
    base, added = analyse(text)
    out, at, source = [], 0, text or ""
    for s, e, k in sorted(base + added):
        if s >= at:
            out += [source[at:s], f"<{k.upper()}>"]
        at = max(at, e)
    return "".join(out) + source[at:]


_RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, base_sha256, spans (base and added), n_added."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base, added = analyse(text)
                rows.append((*(sum(x[2] == k for x in base) for k in KINDS), hashlib.sha256(_join(base).encode()).hexdigest(), _join(base + added), len(added)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return in_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, _RESULT)
