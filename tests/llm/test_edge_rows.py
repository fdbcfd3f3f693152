"""Every operator and stage on null, empty, very long, tied and repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_DIR
from stockflow.llm import (
    digest_index,
    harmonic_packing,
    html_extract,
    pii_offsets,
    quality_lines,
    queries,
    secret_entropy,
    simhash_bktree,
    source_mixing,
    token_prefix,
    toxic_segments,
)
from stockflow.llm.common import table

PATH = public_tokenizers.path(queries.VOCABULARY)
LONG = "A quite ordinary line of many words in it. " * 8000
PLAIN = "The first plain sentence stands here, and a second one follows it closely."
ROWS = [
    (1, None, "en", "s"),
    (2, "", "en", "s"),
    (3, " \n\t ", None, "s"),
    (4, LONG, "en", None),
    (5, PLAIN, None, None),
    (6, PLAIN, "en", "s"),
    (6, PLAIN, "en", "s"),
    (6, "Another text with the same id as the one before.", "en", "s"),
    (None, PLAIN, "de", "t"),
    (None, None, None, None),
]
#: Names that operators use for columns of their own.
CLASHING = (
    "digest id_key keep_id group_size kept fp fingerprint component_id score passages counts tokens key_source "
    "key_lang key_topic chance words lines grams marked places passed label fold id start length"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    df = df.withColumn("n_chars", F.length("text").cast("bigint"))
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def model(spark):
    return toxic_segments.ToxicModel({"idiot": 6.0}, slope=0.5, offset=-2.0)


def per_row(model):
    """Operators that give one row per input row."""
    return {
        "html": lambda d: html_extract.extract(d, {}, "doc_id", "text"),
        "quality": quality_lines.judged,
        "mixing": source_mixing.mixed,
        "pii": pii_offsets.pii_digest,
        "pii spans": pii_offsets.pii_spans,
        "pii masks": pii_offsets.masked,
        "tokens": lambda d: token_prefix.token_counts(d, PATH),
        "prefixes": lambda d: token_prefix.prefix_tables(d, PATH),
        "toxicity": lambda d: toxic_segments.score(d, model),
        "secrets": secret_entropy.secret_digest,
        "secret spans": secret_entropy.secret_spans,
        "exact dedup": digest_index.exact_dedup,
        "near dedup": simhash_bktree.near_duplicates,
    }


@pytest.mark.parametrize("name", per_row(None))
def test_one_row_for_each(docs, nothing, model, name):
    operator = per_row(model)[name]
    found = operator(docs)
    ids = sorted((r["doc_id"] for r in found.select("doc_id").collect()), key=str)
    assert ids == sorted((r[0] for r in ROWS), key=str)
    assert operator(nothing).collect() == []


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect() if r["doc_id"] is not None}


def test_quality_of_edges(docs):
    found = by_id(quality_lines.judged(docs), "n_words", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for empty in (1, 2, 3):
        assert found[empty] == (0, 0, 0, True, False)
    assert found[4] == (72000, 0, 72000, True, False)


def test_quality_removes_lines_then_rejects(spark):
    prose = "\n".join(" ".join(f"word{7 * i + j}" for j in range(9)) + "." for i in range(20))
    menu = "\n".join(f"home{i} | news{i} | about{i} | login{i}" for i in range(90))
    rows = [(1, prose), (2, prose + "\nCopyright (c) me. All rights reserved.\nNext page"), (3, prose + "\n" + menu)]
    found = quality_lines.judged(spark.createDataFrame(rows, "doc_id long, text string"))
    assert by_id(found, "base_failed", "n_removed_lines", "kept") == {1: (False, 0, True), 2: (False, 2, True), 3: (False, 90, False)}
    kept = quality_lines.cleaned(spark.createDataFrame(rows, "doc_id long, text string"))
    assert by_id(kept, "text") == {1: (prose,), 2: (prose,)}


def test_exact_dedup_of_edges(docs):
    found = by_id(digest_index.exact_dedup(docs), "keep_id", "group_size", "kept")
    # Null, null again and empty are equal texts; a null id stays only if a group has no other.
    assert found[1] == (2, 3, False) and found[2] == (2, 3, True)
    assert found[5] == (6, 4, False)


def test_near_dedup_of_edges(docs):
    found = by_id(simhash_bktree.near_duplicates(docs), "fingerprint", "component_id")
    assert found[1] == found[2] == found[3] == ("0" * 16, 1)
    assert found[5][1] == 5


def test_tokens_of_edges(docs):
    found = by_id(token_prefix.token_counts(docs, PATH), "n_bytes", "n_tokens", "over_limit", "fit_chars")
    assert found[1] == found[2] == (0, 0, False, 0)
    assert found[4][2] and found[4][3] < len(LONG)


def test_packing_of_edges(docs, nothing):
    found = harmonic_packing.pack(docs, PATH, with_ids=True)
    assert harmonic_packing.pack(nothing, PATH).collect() == []
    empties = [r for r in found.collect() if r.doc_id in (1, 2)]
    assert [(r.start, r.length, r.doc_tokens, r.ids) for r in empties] == [(0, 1, 1, [1])] * 2
    assert found.where("doc_id = 6").agg(F.sum("length")).first()[0] == sum(
        r.doc_tokens for r in harmonic_packing.pack(docs.where("doc_id = 6"), PATH).where("start = 0").collect()
    )


def rows_of(df):
    return sorted(df.select("doc_id", "text").collect(), key=str)


def test_filters_keep_whole_rows(docs, nothing, model):
    for keep in (digest_index.unique_rows, simhash_bktree.one_of_each, source_mixing.sampled):
        found = keep(docs)
        assert found.columns == docs.columns
        assert all(r[c] == f"own {c}" for r in found.collect() for c in CLASHING)
        assert keep(nothing).collect() == []
    clean = toxic_segments.without_toxic(docs, model)
    assert clean.columns == docs.columns and clean.count() == len(ROWS)
    assert toxic_segments.without_toxic(nothing, model).collect() == []


def test_unique_rows_has_each_text_once(docs):
    found = [r.text or "" for r in digest_index.unique_rows(docs).collect()]
    assert sorted(found) == sorted({r[1] or "" for r in ROWS})


def test_one_of_each_has_each_group_once(docs):
    found = simhash_bktree.one_of_each(docs).collect()
    groups = {r.component_id for r in simhash_bktree.near_duplicates(docs).collect()}
    prints = {r.fingerprint for r in simhash_bktree.near_duplicates(docs).collect()}
    assert len(groups) <= len(found) <= len(prints)
    assert len({simhash_bktree.fingerprint(r.text or "") for r in found}) == len(found)


def test_toxic_rows_go(spark, model):
    rows = [(1, "a fine text"), (2, "you idiot and idiot and idiot"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in toxic_segments.without_toxic(docs, model).collect()] == [1, 3]
    passages = by_id(toxic_segments.score(docs, model), "passages")
    text = rows[1][1]
    assert [text[p.start : p.end] for p in passages[2][0]] == ["idiot and idiot and idiot"]


def test_passages_are_places_in_the_text_itself(spark, model):
    """Lower case of a text with a dotted capital I is longer than the text."""
    text = "İİİİ you IDIOT here"
    found = toxic_segments.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [text[p.start : p.end] for p in found.passages] == ["IDIOT"]


# The pipeline.


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stage_on_edges(spark, docs, nothing, name, stage):
    last = name == corpus_pipeline.STAGES[-1][0]
    for frame in (docs, nothing):
        found = stage(spark, frame, SF_DIR)
        rows = found.collect()
        if not last:
            assert found.columns == docs.columns
        assert bool(rows) == (frame is docs)


def test_pipeline_is_its_operators_one_after_another(spark):
    docs = table(spark, SF_DIR, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    labels = table(spark, SF_DIR, "labels")
    scores = toxic_segments.score(docs, toxic_segments.fit(docs, labels))
    clean = {r.doc_id for r in scores.collect() if r.score < 0.5}
    unique = {max(i for i in clean if texts[i] == t) for t in {texts[i] for i in clean}}
    prints = {i: simhash_bktree.fingerprint(texts[i]) for i in sorted(unique)}
    group = {i: i for i in prints}
    for _ in prints:
        before = dict(group)
        for i in prints:
            group[i] = min(group[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 2)
        if group == before:
            break
    stay = set(group.values())
    kept = {r.doc_id for r in source_mixing.mixed(docs.where(F.col("doc_id").isin(list(stay)))).collect() if r.kept}
    pieces = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id for r in pieces} == kept
    totals = {}
    for r in pieces:
        totals[r.doc_id, r.doc_tokens] = totals.get((r.doc_id, r.doc_tokens), 0) + r.length
    assert all(total == n for (_, n), total in totals.items())
