"""Spelling variants against a brute-force version, and on odd inputs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from stockflow.llm import queries, spelling_variants as sv
from stockflow.llm.common import table


def slow_words(rows: list[tuple]) -> dict[str, int]:
    """The words and their counts, run by run."""
    found: Counter = Counter()
    for key, text in rows:
        for m in re.finditer("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m.group())
            h = zlib.crc32(f"{'null' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 3}


def slow_variants(rows: list[tuple]) -> dict[str, tuple]:
    """All one-edit spellings over all letters in use, looked up one by one."""
    n = slow_words(rows)
    letters = {c for w in n for c in w}
    near = {}
    for w in n:
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        others = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters}
        others |= {a + c + b[1:] for a, b in cuts if b for c in letters}
        near[w] = (others - {w}) & n.keys()
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def found_variants(df) -> dict[str, tuple]:
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_registered_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF_DIR, "documents").collect()]
    expected = slow_variants(rows)
    assert found_variants(queries.op11_spelling_variants(spark, SF_DIR)) == expected
    assert sum(f is not None for f, *_ in expected.values()) > 100


@pytest.mark.parametrize("seed", range(3))
def test_dense_vocabulary_equals_brute_force(spark, seed):
    """Few letters and short words: chains of forms, ties, many near words, long words, letters beyond ASCII."""
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abÀÿ÷") for _ in range(rng.randint(4, 7))) for _ in range(150)]
    for size in (39, 40, 41, 42, 90):
        base = "".join(rng.choice("abÀÿ÷") for _ in range(size))
        stock += [base, base[:7] + base[8:], base[:9] + "c" + base[10:], base + "a"]
    rows = [(i, " ".join(rng.choices(stock, [2.0 ** -(k % 9) for k in range(len(stock))], k=300))) for i in range(12)]
    assert found_variants(sv.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == slow_variants(rows)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " 12 _ \n"), (None, "Words words words"), (5, "WÖRDER wÖrder WÖrder wörder"), (6, "tiny " * 9)]
    rows += [(7, "repeated"), (7, "repeated"), (7, "repeated"), (8, "lengthy" * 30_000 + " " + ("lengthier" * 20_000 + " ") * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clashing = "word n near near_n key form form_n root n_near best word_n further".split()
    df = df.select("*", *[F.lit("own").alias(c) for c in clashing])
    expected = slow_words(rows)
    found = found_variants(sv.spelling_variants(df))
    assert {w: v[2] for w, v in found.items()} == expected
    assert {"words", "wÖrder", "repeated"} <= expected.keys() and "tiny" not in expected
    assert sv.spelling_variants(df.limit(0)).collect() == []


def test_keys_of_edits_are_in_the_neighbourhood():
    rng = random.Random(4)
    for _ in range(300):
        word = "".join(chr(rng.choice([*range(97, 123), *range(192, 256)])) for _ in range(rng.randint(1, 25)))
        at, letter = rng.randrange(len(word)), rng.choice("aeÿz")
        keys = {int(k) for k in sv.neighbourhood(word)}
        for other in (word, word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :], word + letter):
            key = sv.reduced_key(other)
            assert key in keys
            # One of the two seeks the other, and both only where they have the same key.
            seeking = [key in sv.sought(word), sv.reduced_key(word) in sv.sought(other)]
            assert sum(seeking) == (2 if key == sv.reduced_key(word) else 1)


def test_only_verified_pairs_leave_the_join(spark):
    """The original spellings are compared in the condition of the join itself."""
    words = spark.createDataFrame([("letters", 5), ("lettres", 4)], "word string, n long")
    plan = sv.near_pairs(words)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[key#\d+L\], \[key#\d+L\], Inner, .*levenshtein", plan)
