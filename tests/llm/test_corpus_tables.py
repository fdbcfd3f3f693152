"""Operators on tables against brute force, and the registered queries against SQL."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SF_DIR
from stockflow.llm import (
    bpe,
    components as cc,
    digest_index,
    harmonic_packing as hp,
    queries,
    simhash_bktree as sim,
    source_mixing as mix,
    toxic_segments as tox,
)
from stockflow.llm.common import fresh_path, table

PATH = public_tokenizers.path(queries.VOCABULARY)


def _text(value) -> str:
    return repr(value + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for name_of_table in ("documents", "conversations"):
        duck.execute(f"create view {name_of_table} as select * from '{SF_DIR}/{name_of_table}.parquet'")
    cursor = duck.execute(queries.ORACLES[name])
    columns = sorted(c[0] for c in cursor.description)
    place = [[c[0] for c in cursor.description].index(c) for c in columns]
    df = queries.QUERIES[name](spark, SF_DIR)
    assert sorted(df.columns) == columns
    ours = sorted(tuple(_text(r[c]) for c in columns) for r in df.collect())
    assert ours == sorted(tuple(_text(r[i]) for i in place) for r in cursor.fetchall())


# Exact deduplication.


def test_new_data_meets_the_index(spark):
    path = fresh_path(spark, "index")
    first = spark.createDataFrame([(1, "a"), (5, "a"), (2, "b")], "doc_id long, text string")
    second = spark.createDataFrame([(9, "a"), (7, "c"), (8, "c")], "doc_id long, text string")
    index = digest_index.DigestIndex(spark, path, 3)
    index.add(first, "monday")
    again = digest_index.DigestIndex(spark, path, 3)
    for _ in range(2):  # the second time as after a load that broke off
        again.add(second, "tuesday")
    assert again.entries().count() == 3
    assert again.rows().where("is_new").count() == 3
    found = digest_index.verdicts(digest_index.digests(first.union(second)), again).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in found} == {
        1: (9, 3, False), 5: (9, 3, False), 9: (9, 3, True), 2: (2, 1, True), 7: (8, 2, False), 8: (8, 2, True)
    }
    again.add(spark.createDataFrame([(3, "a"), (4, "b")], "doc_id long, text string"), "wednesday")
    assert sorted((r.keep_id, r.group_size) for r in again.entries().collect()) == [(4, 2), (8, 2), (9, 4)]
    again.add(first.limit(0))
    assert again.entries().count() == 3
    again.forget()
    assert digest_index.DigestIndex(spark, path, 3).entries().count() == 3


def test_index_is_bucketed_and_anti_joined_where_it_lies(spark):
    index = digest_index.DigestIndex(spark, buckets=4)
    rows = {r.col_name: r.data_type for r in spark.sql(f"describe formatted {index.name}").collect()}
    assert rows["Num Buckets"] == "4" and "digest" in rows["Sort Columns"]
    docs = table(spark, SF_DIR, "documents")
    index.add(docs.where("doc_id % 2 = 0"))
    groups = digest_index.digests(docs).groupBy("digest").agg(F.max("id").alias("keep_id"))
    new = index.new_groups(groups)
    new.collect()
    plan = new._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    join = plan[plan.index("SortMergeJoin") :]
    assert re.match(r"SortMergeJoin(\(skew=true\))? \[digest#\d+\], \[digest#\d+\], LeftAnti", join)
    # The groups are the first child of the join, the index is the second.
    stored = join[: join.index("Bucketed: true")]
    assert stored.count("FileScan") == 2 and "Exchange" not in stored[stored.rindex("+- ") :]
    assert "Exchange" not in index.entries()._jdf.queryExecution().executedPlan().toString()


def test_hot_text_is_spread_and_judged(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same").otherwise(F.concat(F.lit("t"), F.col("id") % 6000)).alias("text")
    )
    settings = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = digest_index.exact_dedup(docs)
        sizes = [r[1] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 2400
        assert found.where("group_size = 6667 and keep_id = 19998").count() == 6667
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# Near-duplicates.


def slow_fingerprint(text: str, shingle: int = 3) -> int:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    parts = lower.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
    parts = [p for p in parts if p]
    grams = [" ".join(parts[i : i + shingle]) for i in range(len(parts) - shingle + 1)]
    grams = grams or ([" ".join(parts)] if parts else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(numbers: list[int], radius: int) -> dict[int, int]:
    root = {n: n for n in numbers}
    for _ in numbers:
        changed = False
        for a in numbers:
            for b in numbers:
                if (a ^ b).bit_count() <= radius and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
        if not changed:
            break
    return root


@pytest.mark.parametrize("text", ["", " \n", "One", "one two", "One two THREE", "ß Ü a b c d e", "a b c " * 50_000, "x" * 100_000])
def test_fingerprint_of_edges(text):
    assert sim.fingerprint(text) == slow_fingerprint(text)


def test_bk_tree_finds_all_within(rng=random.Random(5)):
    centres = [rng.getrandbits(64) for _ in range(20)]
    values = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) for c in centres for _ in range(10)}
    values = {v & (2**64 - 1) for v in values}
    tree = sim.BKTree()
    for v in values:
        tree.add(v)
    for q in values:
        found = {tree.values[i] for i in tree.within(q, 2)}
        assert found == {v for v in values if (v ^ q).bit_count() <= 2}


@pytest.mark.parametrize("tree_size", [4096, 7])
def test_links_connect_what_is_near(spark, monkeypatch, tree_size):
    """With small trees, shards are split and all blocks of queries meet all trees."""
    monkeypatch.setattr(sim, "TREE_SIZE", tree_size)
    monkeypatch.setattr(sim, "BLOCK_SIZE", 2 * tree_size)
    rng = random.Random(tree_size)
    values = set()
    for _ in range(12):
        value = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            values.add(value)
            value ^= 1 << rng.randrange(64)
            value ^= rng.choice([0, 1 << rng.randrange(64), 7 << rng.randrange(60)])
    values = sorted(v & (2**64 - 1) for v in values)
    fps = spark.createDataFrame([(sim._signed(v),) for v in values], "fp long")
    found = {r.node: r.root for r in cc.components(sim.links(fps)).collect()}
    groups = defaultdict(set)
    for v, root in slow_components(values, 2).items():
        groups[root].add(sim._signed(v))
    expected = {frozenset(g) for g in groups.values() if len(g) > 1}
    ours = defaultdict(set)
    for node, root in found.items():
        ours[root].add(node)
    assert {frozenset(g) for g in ours.values()} == expected


def test_components_of_chains_and_hubs(spark):
    chain = [(i + 1, i) for i in range(100)]
    hub = [(1000, n) for n in range(1001, 1200)] + [(5000, 1100)]
    edges = spark.createDataFrame([*chain, *hub, (7, 7), (1, 0)], "hi long, lo long")
    found = {r.node: r.root for r in cc.components(edges).collect()}
    assert found == {i: 0 for i in range(101)} | {n: 1000 for n in [*range(1000, 1200), 5000]}


def test_registered_near_duplicates_equal_brute_force(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, SF_DIR, "documents").collect()}
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    root = slow_components(sorted(set(prints.values())), sim.RADIUS)
    least = {}
    for i, f in prints.items():
        least[root[f]] = min(i, least.get(root[f], i))
    found = queries.op10_simhash_near_dedup(spark, SF_DIR).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {
        i: (f"{f:016x}", least[root[f]]) for i, f in prints.items()
    }
    kept = sim.one_of_each(table(spark, SF_DIR, "documents"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


# Packing.


def check_packing(pieces, texts: dict, copies: int = 1) -> None:
    tokens = bpe.load(PATH)
    ids = {i: [*tokens.library.encode(t, add_special_tokens=False).ids, hp.END_ID] for i, t in texts.items()}
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in pieces:
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.length == len(own) > 0 and r.ids_crc32 == zlib.crc32(own.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
        by_bin[r.sequence_id].append((r.offset, r.length))
    for i, own in ids.items():
        seen = Counter(p for a, n in by_doc[i] for p in range(a, a + n))
        assert seen == Counter({p: copies for p in range(len(own))})
    for places in by_bin.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= hp.CAPACITY and (end == hp.CAPACITY or end & (end - 1) == 0)


def test_registered_packing_covers_every_token(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, SF_DIR, "documents").collect()}
    check_packing(queries.op6_harmonic_packing(spark, SF_DIR).collect(), texts)


def test_full_bins_have_their_class_s_number_of_pieces():
    packer, rng = hp.Packer(), random.Random(3)
    docs = {i: np.arange(rng.choice([1, 63, 64, 700, 2047, 2048, 2049, 9000]), dtype=np.uint32) for i in range(300)}
    full = [b for i, ids in docs.items() for b in packer.add(i, ids)]
    for pieces in full:
        sizes = {len(p.ids) for p in pieces}
        assert sum(len(p.ids) for p in pieces) == hp.CAPACITY
        if len(sizes) == 1 and sizes <= {hp.CAPACITY // m for m in packer.open}:
            assert len(pieces) == hp.CAPACITY // sizes.pop()
    assert sum(len(p.ids) for b in [*full, *packer.close()] for p in b) == sum(map(len, docs.values()))


# Mixing.


def slow_rake(cells: dict, targets: dict, rounds: int = 200) -> dict:
    weights = dict(cells)
    for _ in range(rounds):
        for d in range(3):
            sums = Counter()
            for cell, w in weights.items():
                sums[cell[d]] += w
            weights = {c: w * targets[d].get(c[d], 0) / sums[c[d]] if sums[c[d]] else 0.0 for c, w in weights.items()}
    return weights


def test_raking_meets_given_targets(spark):
    rng = random.Random(4)
    cells = {(s, lang, t): rng.randint(1, 1000) for s in "abc" for lang in "xy" for t in "pqr"}
    targets = [{"a": 0.2, "b": 0.3, "c": 0.5}, {"x": 0.6, "y": 0.4}, {"p": 0.5, "q": 0.5}]
    wanted = [(d, value, share) for d, t in zip(mix.DIMENSIONS, targets, strict=True) for value, share in t.items()]
    frames = spark.createDataFrame(wanted, "dimension string, value string, share double")
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens long")
    found = {(r.source, r.lang, r.topic): r.share for r in mix.rake(df, frames).collect()}
    assert found == pytest.approx(slow_rake(cells, targets), abs=1e-6)
    assert all(found[c] == 0 for c in cells if c[2] == "r")


def test_sample_is_the_rows_that_mixed_keeps(spark):
    docs = table(spark, SF_DIR, "documents")
    kept = {r.doc_id for r in mix.mixed(docs).where("kept").collect()}
    rows = mix.sampled(docs)
    assert rows.columns == docs.columns
    assert {r.doc_id for r in rows.collect()} == kept
    assert 0 < len(kept) < docs.count()


def test_stray_document_leaves_the_share_kept_as_it_is(spark):
    """Neither the operator nor the stage lets one document of a rare kind decide about the others."""
    import corpus_pipeline

    rows = [(i, "word " * 50, "en" if i % 3 else "de", "aab"[i // 3 % 3]) for i in range(4000)]
    schema = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame(rows, schema)
    stray = docs.union(spark.createDataFrame([(4000, "word", "xx", "stray")], schema))
    shares = [mix.mixed(d).where("kept").count() / 4000 for d in (docs, stray)]
    assert abs(shares[0] - mix.RATE) < 0.02 and abs(shares[0] - shares[1]) < 0.01
    assert abs(corpus_pipeline.mixing(spark, stray, "").count() / 4000 - shares[1]) < 0.01


def test_given_targets_topics_and_tokens_are_used(spark):
    rows = [(i, None, "en", "ab"[i % 2], "xy"[i // 2 % 2], 10 if i % 2 else None) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, theme string, size long")
    targets = [("topic", "x", 0.75), ("topic", "y", 0.25), ("topic", "absent", 5.0)]
    targets = spark.createDataFrame(targets, "dimension string, value string, share double")
    cells = mix.probabilities(docs, targets, rate=0.25, topic_col="theme", tokens_col="size").collect()
    assert {(r.source, r.topic): r.tokens for r in cells} == {("a", "x"): 500, ("a", "y"): 500, ("b", "x"): 5000, ("b", "y"): 5000}
    kept = Counter()
    for r in cells:
        kept[r.topic] += r.tokens * r.probability
    # Sources and languages have no target and keep their own shares.
    assert kept["x"] == pytest.approx(3 * kept["y"]) and sum(kept.values()) == pytest.approx(0.25 * 11_000)
    assert {r.source: r.share for r in cells if r.topic == "x"} == pytest.approx({"a": 0.75 / 11, "b": 7.5 / 11})


def test_rate_is_the_share_of_tokens_kept(spark):
    rng = random.Random(5)
    rows = [(rng.randint(1, 10_000), rng.random() ** 3) for _ in range(50)]
    tokens = sum(n for n, _ in rows)
    cells = spark.createDataFrame(rows, "tokens long, ratio double")
    for rate in (0.01, 0.5, 0.99):
        factor = mix.rate_factor(cells, rate)
        assert sum(n * min(1, ratio * factor) for n, ratio in rows) == pytest.approx(rate * tokens)
    some = spark.createDataFrame([(10, 0.5), (90, 0.0)], "tokens long, ratio double")
    assert mix.rate_factor(some, 0.05) == pytest.approx(1.0)
    assert mix.rate_factor(some, 0.9) == float("inf")
    with pytest.raises(ValueError, match="rate"):
        mix.rate_factor(cells, 0)


# Toxicity.


def slow_segments(scores: list[float]) -> list[tuple[int, int]]:
    """Maximal segments by their definition: the best of a range, then the same left and right of it."""
    if not scores:
        return []
    best = max(
        ((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0)
    )
    if best[0] <= 0:
        return []
    a, n = -best[2], -best[1]
    right = [(x + a + n, y + a + n) for x, y in slow_segments(scores[a + n :])]
    return [*slow_segments(scores[:a]), (a, a + n), *right]


def test_segments_are_the_maximal_ones():
    rng = random.Random(6)
    for _ in range(400):
        # Sums of distinct powers never tie.
        scores = [rng.choice((1, -1)) * (rng.randint(1, 40) + rng.random()) for _ in range(rng.randint(0, 14))]
        found = tox.segments(np.array(scores))
        assert [(a, b) for _, a, b in found] == slow_segments(scores)
        assert [s for s, _, _ in found] == pytest.approx([sum(scores[a:b]) for _, a, b in found])


def test_chance_fit_recovers_its_parameters():
    rng = np.random.default_rng(1)
    lengths = rng.integers(50, 2000, 5000)
    rate, log_k = 0.9, -2.0
    best = (log_k + np.log(lengths) - np.log(-np.log(rng.random(5000)))) / rate
    found = tox.fit_chance(lengths, best)
    assert found[0] == pytest.approx(rate, rel=0.05) and found[1] == pytest.approx(log_k, abs=0.2)


def test_words_without_a_score_of_their_own_fall_back_to_a_near_one(spark):
    """Each beginning is less than APART from the next, and the word is far from the first."""
    rng = random.Random(8)
    letters = "bcdfghklmn"
    rows = []
    for word, toxic, n in (("abcdefg", 77, 100), ("abcdexy", 63, 100), ("abcdxyz", 108, 200), ("abcxyzz", 192, 400)):
        for i in range(n):
            around = ["".join(rng.choice(letters) for _ in range(9)) for _ in range(2)]
            rows.append((int(i < toxic), f"{around[0]} {word} {around[1]}"))
    odds = tox.word_odds(spark.createDataFrame(rows, "toxic int, text string")).collect()
    model = tox.ToxicModel({r.feature: r.score for r in odds if abs(r.apart) >= tox.APART})
    scores = {r.feature: r.score for r in odds if not r.feature.endswith("*")}
    assert scores["abcdefg"] > 0.9
    assert all(abs(model.word_score(word) + tox.DRIFT - own) < tox.APART + 1e-9 for word, own in scores.items())


def test_held_out_toxic_documents_are_told_apart(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.op7_toxic_segments(spark, folder).join(table(spark, folder, "labels"), "doc_id").toPandas()
    held = found[found["held_out"]]
    assert (held["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in held["doc_id"]]).all()
    ranks = held["score"].rank()
    toxic = held["toxic"] == 1
    auc = (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.95
    assert (held["predicted"][~toxic] == 0).mean() > 0.98
    assert found["score"].between(0, 1).all()


def test_family_of_an_unseen_word_scores():
    model = tox.ToxicModel({"gru*": 2.0, "grumb*": 5.0, "grumble": 6.0})
    words = ("grumble", "grumbling", "grub", "gru", "other")
    assert [model.word_score(w) for w in words] == [5.0, 4.0, 1.0, -1.0, -1.0]


def test_labels_of_one_kind_teach_nothing(spark):
    docs = spark.createDataFrame([(i, "some words") for i in range(20)], "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(0).alias("toxic"))
    for known in (labels, labels.limit(0)):
        model = tox.fit(docs, known)
        assert [r.score < 0.01 for r in tox.score(docs, model).collect()] == [True] * 20
