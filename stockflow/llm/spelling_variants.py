"""Spelling variants: words of a vocabulary one edit apart, and the commoner form that each leads to.

Letters are hashed to eight symbols. Every word gives the keys of its reduced spelling and of the reduced
spellings one edit away; these meet the keys of the reduced vocabulary in a join, and what meets is compared in
its original spelling. Two words one edit apart are at most one edit apart when reduced, so none is missed. Of a
neighbourhood, the half that lies in the neighbourhoods of the other words anyway is not sent: each pair is
sought from its longer word, or from the one with the lower symbol, and counts for both.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import per_text, staged

LEAST_LENGTH = 5
LEAST_COUNT = 3
#: One in so many pairs of document and word loses a letter.
NOISE = 97
#: How many times as common as a word its form must be.
COMMONER = 2
#: Symbols that letters are hashed to. More make keys rarer and neighbourhoods larger.
SYMBOLS = 8
#: Letters above which a word is too long to travel with each of its keys.
LONG = 40
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: Keys after which a batch is handed on.
BATCH_KEYS = 200_000

_PAIR = ("word", "word_n", "near", "near_n")
_RUN = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: An odd number, so that powers of it can be divided by; keys are sums of symbols times powers of it.
_BASE = 0x9E3779B97F4A7C15
_UNBASE = np.uint64(pow(_BASE, -1, 1 << 64))


def lower_ascii(text: str) -> str:
    """The text with A to Z in lower case and nothing else changed."""
    return text.encode().translate(_LOWER).decode()


def words_of(key: object, text: str) -> Iterator[tuple[str, int]]:
    """(word, count) of a text: its runs of letters, of which a checksum of id and run makes some lose a letter."""
    begin = zlib.crc32(f"{'null' if key is None else key}:".encode())
    for run, n in Counter(_RUN.findall(lower_ascii(text))).items():
        if len(run) < LEAST_LENGTH:
            continue
        h = zlib.crc32(run.encode(), begin)
        if h % NOISE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_LENGTH:
            yield run, n


def _counted(rows: Iterator[tuple[object, str]]) -> Iterator[tuple]:
    held: Counter = Counter()
    for key, text in rows:
        for word, n in words_of(key, text):
            held[word] += n
        if len(held) >= HELD_WORDS:
            yield from ((None, *x) for x in held.items())
            held.clear()
    yield from ((None, *x) for x in held.items())


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of a corpus that are long and common enough. Each task sends a word once for many texts."""
    counts = per_text(docs, id_col, text_col, _counted, {"word": pa.string(), "n": pa.int64()})
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


@lru_cache(maxsize=256)
def _powers(size: int) -> np.ndarray:
    return np.array([pow(_BASE, i, 1 << 64) for i in range(size)], np.uint64)


def reduced(word: str) -> np.ndarray:
    """The symbols of a word, from 1."""
    return (np.frombuffer(word.encode("utf-32-le"), "<u4") % SYMBOLS + 1).astype(np.uint64)


def reduced_key(word: str) -> int:
    symbols = reduced(word)
    return int((symbols * _powers(len(symbols))).sum())


def neighbourhood(word: str) -> np.ndarray:
    """The distinct keys of a word's reduced spelling and of its full neighbourhood, all spellings one edit away."""
    deleted, replaced, inserted = _edits(word)
    return np.unique(np.concatenate(([np.uint64(reduced_key(word))], deleted, replaced.ravel(), inserted.ravel())))


def _edits(word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys after deleting each symbol, and after putting each symbol in place of, or before, each symbol.

    A key is a sum, so each edit changes it by a difference.
    """
    symbols = reduced(word)
    powers = _powers(len(symbols) + 1)
    parts = symbols * powers[:-1]
    before = np.concatenate(([np.uint64(0)], np.cumsum(parts, dtype=np.uint64)))
    whole, after = before[-1], before[-1] - before
    every = np.arange(1, SYMBOLS + 1, dtype=np.uint64)[:, None]
    deleted = before[:-1] + after[1:] * _UNBASE
    return deleted, whole - parts + every * powers[:-1], before + every * powers + after * np.uint64(_BASE)


def sought(word: str) -> np.ndarray:
    """The keys of the neighbourhood from which a word seeks the others: its own, those of deletions, and of higher symbols.

    The other edits of a word are such edits of the word that they lead to.
    """
    deleted, replaced, _ = _edits(word)
    higher = np.arange(1, SYMBOLS + 1)[:, None] > reduced(word)
    return np.unique(np.concatenate(([np.uint64(reduced_key(word))], deleted, replaced[higher])))


def _own_key(word: str) -> np.ndarray:
    return np.array([reduced_key(word)], np.uint64)


def _keyed(words: DataFrame, keys_of: Callable[[str], np.ndarray]) -> DataFrame:
    """A row for each key of each row's ``word``: all columns but the word, the key, and whether it is the word's own."""
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

    carried = words.columns[1:]
    schema = pa.schema([*to_arrow_schema(words.select(*carried).schema), ("key", pa.int64()), ("same", pa.bool_())])

    def rows(columns: list[pa.Array], found: list[np.ndarray], own: list[int], first: int) -> Iterator[pa.RecordBatch]:
        sizes = [len(k) for k in found]
        place, keys = np.repeat(np.arange(first, first + len(found)), sizes), np.concatenate(found)
        same = keys == np.repeat(np.array(own, np.uint64), sizes)
        for at in range(0, len(keys), BATCH_KEYS):
            part = slice(at, at + BATCH_KEYS)
            taken = [c.take(pa.array(place[part])) for c in columns]
            yield pa.record_batch([*taken, pa.array(keys[part].view(np.int64)), pa.array(same[part])], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, own, held = [], [], 0
            for at, word in enumerate(batch.column(0).to_pylist(), 1):
                found.append(keys_of(word))
                own.append(reduced_key(word))
                held += len(found[-1])
                if held >= BATCH_KEYS or at == len(batch):
                    yield from rows(batch.columns[1:], found, own, at - len(found))
                    found, own, held = [], [], 0

    return words.mapInArrow(run, from_arrow_schema(schema))


def _met(words: DataFrame, condition: Column) -> DataFrame:
    """Rows (word_id, word_n) and (near_id, near_n), once for each pair of words one of which is sought by the other.

    Of words with the same key, which seek each other, the first has the second. The condition is part of the join.
    """
    spread = words.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    wide = _keyed(spread, sought)
    own = _keyed(spread.withColumnsRenamed({"word_id": "near_id", "word_n": "near_n"}), _own_key).drop("same")
    once = ~F.col("same") | (F.col("word_id") < F.col("near_id"))
    return wide.hint("merge").join(own, (wide["key"] == own["key"]) & once & condition).drop("key", "same")


def _one_edit(word: str, near: str) -> Column:
    return (F.abs(F.length(word) - F.length(near)) <= 1) & (F.levenshtein(word, near, 1) == 1)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, word_n, near, near_n) of all ordered pairs of distinct words (word, n) exactly one edit apart.

    The join compares the original spellings as keys meet, so pairs that only look alike when reduced are never
    rows. No key is in a word's list twice, so a pair comes once, and is then written for both words. A word sends
    four or five keys for each of its letters; words above ``LONG`` letters travel as digests with them, and only
    what meets is given its spelling back.
    """
    size = F.length("word")
    short = words.where(size <= LONG).select("word", F.col("word").alias("word_id"), F.col("n").alias("word_n"))
    short = _met(short, _one_edit("word_id", "near_id")).withColumnsRenamed({"word_id": "word", "near_id": "near"})

    named = words.where(size >= LONG).select("word", F.md5("word").alias("word_id"), F.col("n").alias("word_n"))
    meet = _met(named, F.col("word_id") != F.col("near_id")).drop("word_n", "near_n")
    found = meet.join(named, "word_id").join(named.toDF("near", "near_id", "near_n"), "near_id")
    found = found.where((F.greatest(F.length("word"), F.length("near")) > LONG) & _one_edit("word", "near"))
    pairs = short.select(*_PAIR).unionByName(found.select(*_PAIR))
    turned = F.struct(*[F.col(c).alias(name) for c, name in zip((*_PAIR[2:], *_PAIR[:2]), _PAIR, strict=True)])
    return pairs.select(F.inline(F.array(F.struct(*_PAIR), turned)))


def with_forms(words: DataFrame) -> DataFrame:
    """(word, n, form, form_n, n_near): each word with its most common near word, if that is common enough.

    Of near words equally common the first in code-point order is taken.
    """
    alone = words.select("word", F.col("n").alias("word_n"), *[F.lit(None).cast(t).alias(c) for c, t in (("near", "string"), ("near_n", "bigint"))])
    rank = F.when(F.col("near").isNotNull(), F.struct(-F.col("near_n"), F.col("near")))
    found = near_pairs(words).unionByName(alone).groupBy("word").agg(
        F.max("word_n").alias("n"), F.min(rank).alias("best"), F.count("near").alias("n_near")
    )
    best_n = -F.col("best")["col1"]
    common = best_n >= COMMONER * F.col("n")
    return found.select(
        "word", "n", F.when(common, F.col("best")["near"]).alias("form"), F.when(common, best_n).alias("form_n"), "n_near"
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words of (word, form) links: the end of the chain of forms.

    Each round doubles how far a word looks. A form is at least twice as common as its word, so chains have no
    circles and at most 62 links, which six rounds cover.
    """
    now = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = now.join(ahead, "root", "left")
        if moved.where(F.col("further").isNotNull()).isEmpty():
            return now
        now = staged(moved.select("word", F.coalesce("further", "root").alias("root")), "roots")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of a corpus.

    Null, empty and wordless texts add no words; repeated rows count each time; a null id counts as the text
    ``null``. Of an empty frame nothing is returned. Other columns are not read.
    """
    words = staged(vocabulary(docs, id_col, text_col), "vocabulary")
    found = staged(with_forms(words), "forms")
    ends = roots(found.where(F.col("form").isNotNull()).select("word", "form"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
