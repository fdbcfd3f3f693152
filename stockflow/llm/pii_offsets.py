"""Personal data in plain and disguised spelling, with spans in the source text.

Plain identifiers are found in the text itself. For disguised ones a chain of transducers rewrites the text:
look-alike letters and invisible characters, then spelled digits, then words and brackets that stand for
``@`` and ``.``. Every rewritten character keeps the span of the source it came from, so what the detectors
find in the rewritten text is mapped back. Texts that give the transducers nothing to do are not rewritten.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_text

KINDS = ("email", "ip", "card", "phone")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A number of digits is tried from its first digit only, as no later start can do better.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[Span]:
    end = 0
    for found in _DOMAIN.finditer(text):
        start = found.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < found.start():
            end = found.end()
            yield Span("email", start, end)


def luhn(digits: str) -> bool:
    """Whether the digits have a valid check digit."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _low_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def detect(text: str) -> list[Span]:
    """Identifiers as written, non-overlapping within a kind."""
    found = list(_emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        if all(map(_low_part, m.group().split("."))):
            found.append(Span("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _NO_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
            found.append(Span("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
                found.append(Span("phone", *m.span()))
    return found


class Rewritten:
    """A text and, for each of its characters, where the source of it starts and ends."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.starts = array("q", range(len(text)))
        self.ends = array("q", range(1, len(text) + 1))

    def replace(self, pattern: re.Pattern, to) -> None:
        """Put ``to(match)`` for every match; the characters put share the span of the match's source.

        ``to`` may give None to leave a match as it is, or (text, start, end) to replace a part of it.
        """
        parts, starts, ends, at = [], array("q"), array("q"), 0
        for found in pattern.finditer(self.text):
            new = to(found)
            if new is None:
                continue
            new, a, b = (new, *found.span()) if isinstance(new, str) else new
            parts += [self.text[at:a], new]
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            if new and b > a:
                starts += array("q", [self.starts[a]] * len(new))
                ends += array("q", [self.ends[b - 1]] * len(new))
            at = b
        if at:
            self.text = "".join([*parts, self.text[at:]])
            self.starts = starts + self.starts[at:]
            self.ends = ends + self.ends[at:]

    def source(self, span: Span) -> Span:
        return Span(span.kind, self.starts[span.start], self.ends[span.end - 1])


# Letters of other alphabets that look like the Latin ones below them.
_ALIKE = str.maketrans(
    "АВЕЗКМНОРСТУХЅІЈԌаеорсухѕіјһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρι",
    "ABE3KMHOPCTYXSIJGaeopcyxsijhdqwABEZHIKMNOPTYXovpi",
)
_INVISIBLE = "­͏᠎​-‏‪-‮⁠-⁤︀-️﻿"
_DOTS = "。．｡․"
#: Characters that may disguise another, apart from letters with accents.
_ODD = re.compile(
    rf"[{_INVISIBLE}{_DOTS}Ͱ-ԯ٠-٩۰-۹०-९‐-―⁰-₟"
    r"①-⒛Ⓐ-ⓩ！-～\U0001d400-\U0001d7ff]"
)
_HIDDEN = re.compile(f"[{_INVISIBLE}]")


def _plain(found: re.Match) -> str | None:
    """What an odd character looks like; None if it is only itself."""
    char = found.group()
    if _HIDDEN.match(char):
        return ""
    if char in _DOTS:
        return "."
    if "‐" <= char <= "―":
        return "-"
    alike = char.translate(_ALIKE)
    if alike != char:
        return alike
    digit = unicodedata.digit(char, None)
    if digit is not None:
        return str(digit)
    alike = unicodedata.normalize("NFKC", char)
    return alike if alike != char and alike.isascii() else None


# The digits from 0 to 9 in words.
_DIGIT_WORDS = (
    "zero|oh|null|zéro|cero",
    "one|eins|un|uno",
    "two|zwei|zwo|deux|dos",
    "three|drei|trois|tres",
    "four|vier|quatre|cuatro",
    "five|fünf|cinq|cinco",
    "six|sechs|seis",
    "seven|sieben|sept|siete",
    "eight|acht|huit|ocho",
    "nine|neun|neuf|nueve",
)
_DIGIT_OF = {w: str(d) for d, ws in enumerate(_DIGIT_WORDS) for w in ws.split("|")}
_DIGIT_WORD = "|".join(sorted(_DIGIT_OF, key=len, reverse=True))
_SPELLED_PART = re.compile(rf"(?i)\b(?:{_DIGIT_WORD})\b|[0-9]+|\+|\bplus\b|\bdot\b|\.")
#: At least four digits, some of them as words; single dots may stand between them.
_SPELLED = re.compile(
    rf"(?i)(?<![^\W_])(?:(?:plus\b|\+)[ -]*)?(?:(?:{_DIGIT_WORD})\b|[0-9]+)"
    rf"(?:[ ,-]{{0,2}}(?:(?:dot\b|\.)[ ]?)?(?:(?:{_DIGIT_WORD})\b|[0-9]+)){{3,}}"
)
_TWO_WORDS = re.compile(rf"(?i)\b(?:{_DIGIT_WORD})[ ,-]{{1,2}}(?:(?:dot\b|\.)[ ]?)?(?:{_DIGIT_WORD})\b")
#: Digits from which a run is an identifier although words and figures take turns in it.
LONG_RUN = 10


def _digits(found: re.Match) -> str | None:
    text = found.group()
    parts = [p.group().lower() for p in _SPELLED_PART.finditer(text)]
    new = "".join("+" if p in ("plus", "+") else "." if p in ("dot", ".") else _DIGIT_OF.get(p, p) for p in parts)
    if _TWO_WORDS.search(text):
        return new
    spelled = any(p in _DIGIT_OF for p in parts)
    return new if spelled and sum(map(str.isdigit, new)) >= LONG_RUN else None


_OPEN, _CLOSE = r"[\[({<]\s?", r"\s?[\])}>]"
_AT_SIGN = rf"\s?{_OPEN}(?:at|arroba|chez|@|a){_CLOSE}\s?|\s@\s|\s@|@\s"
_DOT_SIGN = rf"\s?{_OPEN}(?:dot|punkt|point|punto|\.){_CLOSE}\s?|\s\.\s"
_AT_WORD = r"[ _-](?:at|arroba)[ _-]"
_DOT_WORD = r"[ _-](?:dot|punkt|punto)[ _-]"
_LABEL = r"[A-Za-z0-9-]+?"
_LABEL_END = r"(?![A-Za-z0-9-]|@)"
_ADDRESS = re.compile(
    rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+?(?:(?:{_DOT_SIGN}|{_DOT_WORD})[A-Za-z0-9_%+-]+?){{0,3}}"
    rf"(?:(?:{_AT_SIGN}|@){_LABEL}(?:(?:{_DOT_SIGN}|\.){_LABEL})+"
    rf"|(?:{_AT_SIGN}|@|{_AT_WORD}){_LABEL}(?:(?:{_DOT_SIGN}|{_DOT_WORD}){_LABEL})+){_LABEL_END}"
)
_SIGNS = re.compile(rf"(?i)(?P<at>{_AT_SIGN}|{_AT_WORD})|(?P<dot>{_DOT_SIGN}|{_DOT_WORD})")
_NUMBER_DOT = re.compile(rf"(?i)(?<=[0-9])(?:{_DOT_SIGN}|{_DOT_WORD})(?=[0-9])")
#: Without one of these in a text in lower case no ``@`` or ``.`` is in disguise.
_SIGN_HINTS = ("dot", "punkt", "punto", "point", "[", "(", "{", "<", " @", "@ ", " . ")
_SIGN_HINT = re.compile(
    r"(?:dot|punkt|punto|point)(?![^\W_])|[\[({<]\s?(?:at|@|a|\.|arroba|chez)\s?[\])}>]|\s@|@\s|\s\.\s"
)
_DIGIT_HINT = re.compile(
    rf"\b(?:{_DIGIT_WORD})[ ,-]{{1,2}}(?:(?:dot\b|\.) ?)?(?:(?:{_DIGIT_WORD})\b|[0-9])|[0-9][ ,-]{{1,2}}(?:{_DIGIT_WORD})\b"
)
# Words that show that a bare "at" and "dot" around them are meant as words.
_NO_DOMAIN = re.compile(r"(?i)@(?:the|a|an|this|that|his|her|our|my|their|its|each|every)\.|\.(?:of|the|an|and|or|for|on|from|with|that|this)$")
_BRACKET = re.compile(r"[\[({<]")
# Endings of domains by which a bare "at" before them is taken for a sign, if no common word stands before it.
_ENDINGS = "com|org|net|edu|gov|info|io|de|at|ch|fr|es|it|uk|eu|nl|be|pl|by|us|ca|au|jp|br|ru"
_BEFORE_AT = frozenset(
    "look looks looked looking me us him her them you it he she we they i is are was were be been am and or not but so "
    "out up only also available online site website page pages link shop store here there home found find see visit more "
    "all that this one read live work works working stay arrive arrived hosted host published listed order ordered buy sold "
    "start starts meet met arrives sign register registered log login shown as of on in to for from by with even just".split()
)
_BARE_AT_HINT = re.compile(rf" (?:at|arroba) (?:[a-z0-9-]+\.)+(?:{_ENDINGS})(?![a-z0-9-]|\.[a-z0-9])")
_BARE_AT = re.compile(
    rf"(?i)(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]*[A-Za-z0-9]) (?:at|arroba) ((?:[A-Za-z0-9-]+\.)+(?:{_ENDINGS}))(?![A-Za-z0-9-]|\.[A-Za-z0-9])"
)
# Numbers with letters that look like the digits 1 and 0; a part set off by a blank has a digit at least.
_PART = r"[0-9OoIl]++(?![A-Za-z0-9])"
_DIGIT_PART = rf"(?=[OoIl]*+[0-9]){_PART}"
_IN_NUMBER = re.compile(rf"(?<![A-Za-z0-9]){_DIGIT_PART}(?:[.-]{_PART}|[ ]{_DIGIT_PART})*+")
_LETTER_DIGITS = str.maketrans("OoIl", "0011")
_NUMBER_HINT = re.compile(r"[0-9][ .-]?[OoIl]|[OoIl][ .-]?[0-9]")


def _address(found: re.Match) -> str | None:
    new = _SIGNS.sub(lambda m: "@" if m.group("at") else ".", found.group())
    bare = not any(_BRACKET.search(m.group()) for m in _SIGNS.finditer(found.group()))
    return new if new != found.group() and not (bare and _NO_DOMAIN.search(new)) else None


def _bare_at(found: re.Match) -> str | None:
    local, domain = found.groups()
    return None if local.lower() in _BEFORE_AT else f"{local}@{domain}"


def _number(found: re.Match) -> str | None:
    text = found.group()
    new = text.translate(_LETTER_DIGITS)
    return new if new != text and sum(map(str.isdigit, text)) >= 4 else None


def rewritten(text: str) -> Rewritten | None:
    """The text after all transducers, or None if they leave it as it is."""
    found = None
    if not text.isascii() and _ODD.search(text):
        found = Rewritten(text)
        found.replace(_ODD, _plain)
    lower = (found.text if found else text).lower()
    if _DIGIT_HINT.search(lower):
        found = found or Rewritten(text)
        found.replace(_SPELLED, _digits)
    if _NUMBER_HINT.search(found.text if found else text):
        found = found or Rewritten(text)
        found.replace(_IN_NUMBER, _number)
    if any(h in lower for h in _SIGN_HINTS) and _SIGN_HINT.search(lower):
        found = found or Rewritten(text)
        found.replace(_NUMBER_DOT, lambda m: ".")
        found.replace(_ADDRESS, _address)
    if " at " in lower or " arroba " in lower:
        if _BARE_AT_HINT.search(lower):
            found = found or Rewritten(text)
            found.replace(_BARE_AT, _bare_at)
    return found if found and found.text != text else None


def _order(span: Span) -> tuple[int, int]:
    return span.start, KINDS.index(span.kind)


def find_pii(text: str) -> tuple[list[Span], list[Span]]:
    """(spans as written, all spans), sorted by start and kind.

    A disguised identifier within a plain one of its kind is left out.
    """
    plain = sorted(detect(text), key=_order)
    clear = rewritten(text)
    if clear is None:
        return plain, plain
    more = [clear.source(s) for s in detect(clear.text)]
    new = [s for s in more if not any(s.kind == p.kind and p.start <= s.start and s.end <= p.end for p in plain)]
    return plain, sorted({*plain, *new}, key=_order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) of every row: lists of (kind, start, end), of plain identifiers and of all.

    Offsets count code points, ends are exclusive. Null and empty texts have no spans.
    """

    def run(rows):
        for key, text in rows:
            plain, every = find_pii(text)
            yield key, [s._asdict() for s in plain], [s._asdict() for s in every]

    spans = pa.list_(pa.struct({"kind": pa.string(), "start": pa.int64(), "end": pa.int64()}))
    return per_text(docs, id_col, text_col, run, {"base": spans, "spans": spans})


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row; the counts are of plain identifiers.

    Null and empty texts have counts of 0, no spans and the digest of the empty string; repeated rows get equal
    results, and of an empty frame nothing is returned.
    """

    def run(rows):
        for key, text in rows:
            plain, every = find_pii(text)
            counts = [sum(s.kind == k for s in plain) for k in KINDS]
            yield key, *counts, hashlib.sha256(joined(plain).encode()).hexdigest(), joined(every)

    fields = {f"n_{k}": pa.int64() for k in KINDS} | {"base_sha256": pa.string(), "spans": pa.string()}
    return per_text(docs, id_col, text_col, run, fields)


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, masked) of every row: its text with each identifier, plain or disguised, replaced by its kind in brackets.

    Null texts count as empty, empty ones stay empty, repeated rows are masked alike; of an empty frame nothing is
    returned.
    """

    def run(rows):
        for key, text in rows:
            parts, at = [], 0
            for span in find_pii(text)[1]:
                if span.start >= at:
                    parts += [text[at : span.start], f"[{span.kind}]"]
                at = max(at, span.end)
            yield key, "".join([*parts, text[at:]])

    return per_text(docs, id_col, text_col, run, {"masked": pa.string()})
