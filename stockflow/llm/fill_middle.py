"""Texts cut into prefix, middle and suffix at line ends, for fill-in-the-middle training.

The UTF-8 of a whole batch of texts is viewed as 64-bit words. Arithmetic on a word marks its bytes that end a
line, counts of the marks are summed up over the words, and the place of the k-th line end is found by a search
in the sums and a selection within one word. No text is scanned character by character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
SEED = "7"
#: Percent of the texts that are transformed, and of these the percent that have the suffix first.
RATE, SUFFIX_FIRST = 100, 50
#: Bytes of output after which a batch is handed on.
BATCH_BYTES = 16 << 20

_LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
_ONES = np.uint64(0x0101010101010101)


class LineEnds:
    """Rank and select over the bytes of a buffer that end a unit."""

    def __init__(self, data: np.ndarray, end: int = 10) -> None:
        padded = np.full((len(data) // 8 + 1) * 8, (end + 1) & 0xFF, np.uint8)
        padded[: len(data)] = data
        words = padded.view("<u8") ^ (_ONES * np.uint64(end))
        # The high bit of each byte that is zero now; no carry leaves a byte, so the marks are exact.
        self.marks = ~(((words & _LOW7) + _LOW7) | words | _LOW7)
        counts = np.bitwise_count(self.marks).astype(np.int64)
        self.upto = np.cumsum(counts)
        self.before = self.upto - counts

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ends stand before each of the places."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        below = (np.uint64(1) << (byte * np.uint64(8))) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The places of the k-th ends, counted from 0; there must be as many."""
        word = np.searchsorted(self.upto, k, side="right")
        left, mark = k - self.before[word], self.marks[word]
        for skipped in range(7):
            mark = np.where(left > skipped, mark & (mark - np.uint64(1)), mark)
        lowest = mark & (~mark + np.uint64(1))
        return (word << 3) + (np.bitwise_count(lowest - np.uint64(1)) >> 3)


class Draw(NamedTuple):
    """Four numbers of 32 bits for an id."""

    first: int
    second: int
    third: int
    fourth: int


def draw(key: object, seed: str = SEED) -> Draw:
    """The numbers of an id, the same in every run; a null id counts as the text ``null``."""
    digest = hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).digest()
    return Draw(*(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)))


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings and the places where each starts, with the end of the last one."""
    texts = texts.cast(pa.large_string())
    _, places, data = texts.buffers()
    at = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def cuts(texts: pa.Array, draws: list[Draw]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lines, start, end of prefix, end of middle, end) of each text, places as bytes of the batch."""
    data, at = _buffer(texts)
    ends = LineEnds(data)
    start, stop = at[:-1], at[1:]
    earlier = ends.rank(start)
    whole = ends.rank(stop) - earlier
    open_end = (stop > start) & (np.append(data, 0)[np.maximum(stop, 1) - 1] != 10)
    n = whole + open_end
    drawn = np.array([d[:2] for d in draws], np.int64).reshape(-1, 2) % (n + 1)[:, None]
    found = []
    for k in (drawn.min(1), drawn.max(1)):
        place = stop.copy()
        inside = (k > 0) & (k <= whole)
        place[inside] = ends.select(earlier[inside] + k[inside] - 1) + 1
        place[k == 0] = start[k == 0]
        found.append(place)
    return n, start, *found, stop


def _rows(ids: list, texts: pa.Array, rate: int, suffix_first: int) -> Iterator[tuple]:
    draws = [draw(i) for i in ids]
    n, start, first, second, stop = (x.tolist() for x in cuts(texts, draws))
    data = memoryview(_buffer(texts)[0])
    for i, key in enumerate(ids):
        text = str(data[start[i] : stop[i]], "utf-8")
        if not text or draws[i].third % 100 >= rate or any(m in text for m in MARKS):
            yield key, n[i], "plain", None, None, text
            continue
        prefix, middle = str(data[start[i] : first[i]], "utf-8"), str(data[first[i] : second[i]], "utf-8")
        suffix = text[len(prefix) + len(middle) :]
        if draws[i].fourth % 100 < suffix_first:
            form, output = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
        else:
            form, output = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
        yield key, n[i], form, len(prefix), len(middle), output


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row.

    ``n`` is the number of lines. Two numbers drawn from the id pick the line ends between which the middle lies.
    The form is ``psm``, ``spm``, or ``plain`` for texts that are empty, hold a mark or are not among ``rate``
    percent; their output is the text itself, and the lengths are null. Null texts count as empty, repeated rows
    are cut alike, of an empty frame nothing is returned. Other columns are not read.
    """
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

    frame = docs.select(id_col, text_col)
    key = to_arrow_schema(frame.select(id_col).schema).field(0)
    longs = ("prefix_chars", "middle_chars")
    schema = pa.schema(
        [key, ("n", pa.int64()), ("form", pa.string()), *[(c, pa.int64()) for c in longs], ("output", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for row in _rows(batch.column(0).to_pylist(), batch.column(1).fill_null(""), rate, suffix_first):
                held.append(row)
                size += len(row[-1])
                if size > BATCH_BYTES:
                    yield _batch(held, schema)
                    held, size = [], 0
            if held:
                yield _batch(held, schema)

    return frame.mapInArrow(run, from_arrow_schema(schema))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A mark is never in a text that is cut, so it shows where the parts meet."""
    parts = F.split(output, "|".join(MARKS))
    one, two, three = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))


def fim_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row, as ``fill_in_middle``."""
    cut = fill_in_middle(docs, id_col, text_col)
    return cut.select(
        id_col,
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
