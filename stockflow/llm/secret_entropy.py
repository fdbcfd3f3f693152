"""Secrets in texts: known forms, and strings of high Shannon entropy.

Entropy is taken over a sliding window of every candidate string, for each class of characters by itself.
The counts of the window's characters are kept up as it moves, so a step costs the same at any window size.
Candidates are cut at the separators of paths, labels and names; an allow-list suppresses the parts that are
words, numbers or written as examples, and what is left between them must look random as it stands.
"""

from __future__ import annotations

import hashlib
import math
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_text

KINDS = ("assign", "access", "hex", "entropy")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


# The names in either case, of ASCII letters alone.
_NAMES = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token", "api"))
_ASSIGN = re.compile(
    rf"""(?:{_NAMES}_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")


class CharClass(NamedTuple):
    """Candidate strings of a class, and its windows with the bits per character from which one is random.

    The longest window that a string has room for is used. ``changes`` is the least share of neighbours in a random
    string that are of different kinds: lower case, upper case, digit.
    """

    candidates: re.Pattern
    windows: tuple[tuple[int, float], ...]
    changes: float = 0.0

    def window(self, size: int) -> tuple[int, float] | None:
        return next((w for w in self.windows if w[0] <= size), None)


# A window of distinct hex digits has 4 bits at most; one of 24 distinct characters 4.6, one of 16 has 4.
HEX = CharClass(re.compile(r"[0-9A-F]{32,}|[0-9a-f]{32,}"), ((32, 3.1),))
TOKENS = CharClass(re.compile(r"[A-Za-z0-9+/_=-]{16,}"), ((24, 3.5), (16, 3.3)), 0.22)
SHORTEST = 16
#: What a window of hex digits alone lacks in bits.
FEWER_BITS = 0.45
_HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: Harmless strings as a whole: identifiers written for people.
ALLOWED = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: What stands between the parts of a path, a label or a name; keys may hold these characters, too.
_PARTS = re.compile(r"[^/=_-]+")
#: Harmless parts: numbered words and numbers with a unit.
_NUMBERED = re.compile(r"[A-Za-z]+[0-9]{1,4}|[0-9]{1,4}[a-z]{1,8}")
_HUMPS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Characters for each word or number in names that are written without separators; random strings have fewer.
HUMP = 3.2
#: A string of parts with one of these, by itself no word, was written as an example.
PLACEHOLDERS = re.compile(r"(?i)example|placeholder|changeme|abcdefgh|01234567|12345678|xxxxxx")
_CLOGC = [0.0, *(c * math.log2(c) for c in range(1, 65))]


def random_parts(text: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Spans of a string covered by windows of at least so many bits per character."""
    counts: dict[str, int] = {}
    total, found = 0.0, []
    # The entropy of counts c that add up to w is log2 w - sum(c log2 c) / w.
    most = (math.log2(window) - bits) * window + 1e-9
    for at, char in enumerate(text):
        count = counts.get(char, 0)
        counts[char] = count + 1
        total += _CLOGC[count + 1] - _CLOGC[count]
        if at >= window:
            old = text[at - window]
            count = counts[old]
            counts[old] = count - 1
            total += _CLOGC[count - 1] - _CLOGC[count]
        if at >= window - 1 and total <= most:
            start = at - window + 1
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], at + 1)
            else:
                found.append((start, at + 1))
    return found


def changes(text: str) -> float:
    """The share of neighbours that are of different kinds."""
    kinds = text.translate(_KINDS)
    return sum(map(str.__ne__, kinds, kinds[1:])) / max(1, len(text) - 1)


_KINDS = str.maketrans(
    {c: "a" for c in map(chr, range(97, 123))} | {c: "A" for c in map(chr, range(65, 91))} | {c: "0" for c in "0123456789"}
)


def ordinary(part: str) -> bool:
    """Whether a string of letters and digits is made of words and numbers."""
    humps = len(_HUMPS.findall(part))
    return humps <= 1 or len(part) >= HUMP * humps or _NUMBERED.fullmatch(part) is not None


def unusual(candidate: str) -> list[tuple[int, int]]:
    """Spans of a string without its words, numbers and examples.

    Parts of up to two characters say nothing; between unusual parts they belong to them.
    """
    found: list[tuple[int, int]] = []
    start, end, example = None, 0, False

    def close() -> None:
        if start is not None and end - start >= SHORTEST and not example:
            found.append((start, end))

    for part in _PARTS.finditer(candidate):
        text = part.group()
        if len(text) <= 2:
            continue
        # What stands beside the word of an example tells whether it is one or just a name with that word.
        marked = [p for p in PLACEHOLDERS.split(text) if len(p) > 2] if PLACEHOLDERS.search(text) else None
        if ordinary(text) if marked is None else all(map(ordinary, marked)):
            close()
            start, example = None, False
            continue
        start = part.start() if start is None else start
        end, example = part.end(), example or marked is not None
    close()
    return found


def _random_spans(text: str) -> list[Span]:
    found = []
    for candidate in HEX.candidates.finditer(text):
        string = candidate.group()
        if not string.isdigit() and not string.isalpha():
            found += [Span("entropy", candidate.start() + a, candidate.start() + b) for a, b in random_parts(string, *HEX.windows[0])]
    for candidate in TOKENS.candidates.finditer(text):
        string = candidate.group()
        if string.isalpha() and (string.islower() or string[1:].islower()) or ALLOWED.fullmatch(string):
            continue
        for first, end in unusual(string):
            own = string[first:end]
            window, bits = TOKENS.window(len(own))
            for a, b in random_parts(own, window, bits - FEWER_BITS if _HEX_ONLY.fullmatch(own) else bits):
                if changes(own[a:b]) >= TOKENS.changes:
                    found.append(Span("entropy", candidate.start() + first + a, candidate.start() + first + b))
    return found


def base_spans(text: str) -> list[Span]:
    """Secrets of the known forms, non-overlapping within a kind."""
    found = []
    lower = text.lower()
    if any(h in lower for h in _HINTS):
        found += [Span("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 8]
    if "AKIA" in text:
        found += [Span("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [Span("hex", *m.span()) for m in _HEX.finditer(text)]


def _order(span: Span) -> tuple[int, int]:
    return span.start, KINDS.index(span.kind)


def find_secrets(text: str) -> tuple[list[Span], list[Span]]:
    """(spans of known forms, all spans), sorted by start and kind.

    Of a random string, what no known form and no earlier random string has counts, if it is long enough.
    """
    base = sorted(base_spans(text), key=_order)
    every, end = [], -1
    for span in sorted(_random_spans(_without(text, base)), key=lambda s: (s.start, -s.end)):
        if span.end - max(span.start, end) >= SHORTEST:
            every.append(Span(span.kind, max(span.start, end), span.end))
            end = span.end
    return base, sorted(base + every, key=_order)


def _without(text: str, spans: list[Span]) -> str:
    """The text with blanks in the place of sorted spans."""
    parts, at = [], 0
    for span in spans:
        if span.end > at:
            start = max(at, span.start)
            parts += [text[at:start], " " * (span.end - start)]
            at = span.end
    return "".join([*parts, text[at:]]) if parts else text


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) of every row: lists of (kind, start, end), of known forms and of all.

    Offsets count code points, ends are exclusive. Null and empty texts have no spans.
    """

    def run(rows):
        for key, text in rows:
            base, every = find_secrets(text)
            yield key, [s._asdict() for s in base], [s._asdict() for s in every]

    spans = pa.list_(pa.struct({"kind": pa.string(), "start": pa.int64(), "end": pa.int64()}))
    return per_text(docs, id_col, text_col, run, {"base": spans, "spans": spans})


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of every row; the counts are of known forms.

    Null and empty texts have counts of 0, no spans and the digest of the empty string; repeated rows get equal
    results, and of an empty frame nothing is returned.
    """

    def run(rows):
        for key, text in rows:
            base, every = find_secrets(text)
            counts = [sum(s.kind == k for s in base) for k in KINDS[:3]]
            yield key, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)

    fields = {f"n_{k}": pa.int64() for k in KINDS[:3]} | {"base_sha256": pa.string(), "spans": pa.string()}
    return per_text(docs, id_col, text_col, run, fields)
