"""Byte-level BPE tokenizers from a ``tokenizers`` file, encoded fast and with the library's own results."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

# Fixed value: the pattern that byte-level BPE cuts a text with before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of Latin letters, in the terms of the faster module.
LATIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Anything for which the two patterns might differ.
NOT_LATIN = r"[^\t\n\r\x20-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-ɏ]"


def byte_letters() -> dict[str, int]:
    """The letter by which a vocabulary file writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """One vocabulary file. ``encode`` gives ids as the library does, without added special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        vocab = {w: i for w, i in spec["model"]["vocab"].items() if w not in self.special}
        self.ranks = {bytes(letters[c] for c in w): i for w, i in vocab.items()}
        self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens=self.special)
        self.longest = max(map(len, self.ranks))
        self._cut, self._cut_latin = regex.compile(PATTERN).findall, re.compile(LATIN_PATTERN).findall
        self._odd = re.compile(NOT_LATIN).search

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as error:  # its panics on extreme texts are no Exception
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def pieces(self, text: str) -> list[str]:
        """The pieces that are merged on their own; joined they give the text, which has no special token."""
        return self._cut(text) if self._odd(text) else self._cut_latin(text)

    def merge(self, word: bytes) -> list[int]:
        """Ids of a short byte string, by merging the lowest-ranked neighbours first."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            ranked = [self.ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
            at = min(range(len(ranked)), key=ranked.__getitem__)
            if ranked[at] == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """The tokenizer of a file, once per process."""
    return Bpe(path)
