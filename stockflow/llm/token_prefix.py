"""Exact token counts at every prefix of a text, by dynamic programming.

The last token of a prefix of a piece is the one vocabulary entry ending there that may stand after the last
token of the shorter prefix it leaves; the count is one more than there. A table of these counts answers how
many tokens a prefix has and which prefix fits a budget, without encoding again.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Bpe, load
from .common import per_text

LIMIT = 1024
#: Pieces and pairs of tokens kept per process; pieces of more bytes are not kept.
KEPT_PIECES, KEPT_PAIRS, KEPT_BYTES = 400_000, 400_000, 200
#: Endings cut off as one piece that are more pieces while not complete.
_ENDINGS = ("'re", "'ve", "'ll")
_SPACES = re.compile(r"[^\S\x1c-\x1f]{2,}")


class PrefixCounter:
    """Counts of one tokenizer; keeps what it found for pieces and pairs up to a fixed number."""

    def __init__(self, bpe: Bpe) -> None:
        self.bpe = bpe
        self._pieces: dict[str, bytes] = {}
        self._pairs: dict[tuple[bytes, bytes], bool] = {}

    def _may_follow(self, before: bytes, token: bytes) -> bool:
        """Whether the two tokens, or the one if the first is empty, are what their bytes are encoded as."""
        found = self._pairs.get((before, token))
        if found is None:
            if len(self._pairs) >= KEPT_PAIRS:
                self._pairs.clear()
            ranks, both = self.bpe.ranks, before + token
            letters = both.decode("utf-8", "replace")
            # Letters alone are one piece, which the fast encoder merges by itself.
            merged = self.bpe.fast.encode_ordinary(letters) if letters.isalpha() else self.bpe.merge(both)
            found = self._pairs[before, token] = merged == [ranks[x] for x in (before, token) if x]
        return found

    def _of_piece(self, piece: str) -> list[int]:
        """Token counts after each character of a piece."""
        data, ranks, pairs, longest = piece.encode(), self.bpe.ranks, self._pairs, self.bpe.longest
        counts, last = [0], [b""]
        for end in range(1, len(data) + 1):
            # Just one start is right; most often the last token grows or a new one begins.
            start = end - 1 - len(last[-1])
            token = data[start:end]
            if token not in ranks or not (pairs.get((last[start], token)) or self._may_follow(last[start], token)):
                for start in range(end - 1, max(-1, end - longest - 1), -1):
                    token = data[start:end]
                    if token in ranks and self._may_follow(last[start], token):
                        break
            counts.append(counts[start] + 1)
            last.append(token)
        if len(data) > len(piece):
            found, end = [], 0
            for c in piece:
                end += len(c.encode())
                found.append(counts[end])
        else:
            found = counts[1:]
        if piece in _ENDINGS:
            found[1] = 2
        return found

    def _kept(self, piece: str) -> bytes:
        found = self._pieces.get(piece)
        if found is None:
            if len(self._pieces) >= KEPT_PIECES:
                self._pieces.clear()
            found = self._pieces[piece] = bytes(self._of_piece(piece))
        return found

    def _plain(self, text: str) -> np.ndarray:
        """Counts at all prefixes of a text without special tokens; the first is that of the empty prefix."""
        pieces = self.bpe.pieces(text)
        if not pieces:
            return np.zeros(1, np.int64)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        if 4 * lengths.max() <= KEPT_BYTES:
            inner = np.frombuffer(b"".join(map(self._kept, pieces)), np.uint8).astype(np.int64)
        else:
            inner = np.concatenate(
                [self._of_piece(p) if 4 * len(p) > KEPT_BYTES else np.frombuffer(self._kept(p), np.uint8) for p in pieces]
            ).astype(np.int64)
        ends = np.cumsum(lengths)
        whole = inner[ends - 1]
        table = np.concatenate(([0], np.repeat(np.cumsum(whole) - whole, lengths) + inner))
        # White space at the end of a prefix is one piece, though more text may divide it.
        for run in _SPACES.finditer(text):
            a, b = run.span()
            spaces = run.group()
            inside = list(self._kept(spaces)) if 4 * (b - a) <= KEPT_BYTES else self._of_piece(spaces)
            table[a + 1 : b + 1] = table[a] + inside
        return table

    def table(self, text: str) -> np.ndarray:
        """Token counts of all prefixes, from the empty one to the whole text."""
        if not any(s in text for s in self.bpe.special):
            return self._plain(text)
        parts = re.split("(" + "|".join(map(re.escape, self.bpe.special)) + ")", text)
        tables, base = [np.zeros(1, np.int64)], 0
        for at in range(0, len(parts), 2):
            plain, special = parts[at], parts[at + 1] if at + 1 < len(parts) else ""
            own = self._plain(plain)
            tables.append(base + own[1:])
            if special:
                # Until a special token is complete, its letters are plain text after the last pieces.
                tail = sum(map(len, self.bpe.pieces(plain)[-2:]))
                begun = self._plain(plain[len(plain) - tail :] + special[:-1])[tail + 1 :]
                tables.append(base + own[len(plain) - tail] + begun)
                base += own[-1] + 1
                tables.append(np.array([base]))
        return np.concatenate(tables)


def longest_within(table: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens, from a table of counts."""
    return int(np.flatnonzero(table <= budget)[-1])


_COUNTERS: dict[str, PrefixCounter] = {}


def _counter(path: str) -> PrefixCounter:
    """One counter per process and file, so that what it keeps serves all tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(load(path))
    return _COUNTERS[path]


def prefix_tables(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts) of every row: ``counts[k]`` is the number of tokens of the first k characters.

    Stored, it answers budgets in SQL: ``counts[k]``, or ``aggregate`` for the last k within one. Null texts
    count as empty and have the one count 0.
    """

    def run(rows):
        counter = _counter(tokenizer)
        for key, text in rows:
            yield key, counter.table(text).astype(np.int32)

    return per_text(docs, id_col, text_col, run, {"counts": pa.list_(pa.int32())})


def token_counts(
    docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, fit_chars) of every row, all read off its prefix table.

    ``fit_chars`` is the length of the longest prefix within the limit. Null texts count as empty. The file
    ``tokenizer`` must be readable on every executor.
    """

    def run(rows):
        counter = _counter(tokenizer)
        for key, text in rows:
            table = counter.table(text)
            total = int(table[-1])
            fit = len(text) if total <= limit else longest_within(table, limit)
            yield key, len(text.encode()), total, total > limit, fit

    fields = {"n_bytes": pa.int64(), "n_tokens": pa.int64(), "over_limit": pa.bool_(), "fit_chars": pa.int64()}
    return per_text(docs, id_col, text_col, run, fields)
