"""Toxic passages as maximum-scoring segments of a text.

A word's score is its log-odds between toxic and clean labelled texts, less a drift that makes plain prose
negative. The odds are smoothed by Dirichlet priors: a word's prior is what its first letters show, down to
three of them, so an inflected form unseen in training scores like its family. A linear scan finds all
maximal-scoring segments of a text. Under extreme-value statistics fitted to clean texts, the best segment of
n plain words exceeds s with probability 1 - exp(-K n exp(-lambda s)); segments above what n words give by
chance are the toxic passages, and their excess, added up, is mapped to a probability.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import per_text, staged, unused

#: Labelled rows that a model is fitted on, about: the rest is left out by a hash of the id.
SAMPLE = 20_000
PREFIXES = (3, 4, 5)
PRIOR = 4.0
DRIFT = 1.0
#: Scores closer than this to that of the longest shorter beginning with a score of its own, or to 0 without one,
#: are not kept apart from it. It bounds what a word's score loses.
APART = 0.4
#: Bounds of the extreme-value rate, for samples in which chance segments are absent.
LEAST_RATE, MOST_RATE = 0.2, 3.0
HELD_OUT = "crc32(cast({} as string)) % 5"
_WORD = re.compile(r"[^\W\d_]+")
_KEPT_WORDS = 400_000


@dataclass
class ToxicModel:
    """Scores of words and of beginnings of words (ending in ``*``), and the calibration."""

    scores: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    offset: float = -30.0
    _known: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    def word_score(self, word: str) -> float:
        found = self._known.get(word)
        if found is None:
            if len(self._known) >= _KEPT_WORDS:
                self._known.clear()
            found = self.scores.get(word)
            for size in reversed(PREFIXES):
                if found is None and len(word) > size:
                    found = self.scores.get(f"{word[:size]}*")
            found = self._known[word] = (found or 0.0) - DRIFT
        return found


def word_list(text: str) -> list[str]:
    """The words of a text in lower case. They are found in the text itself, as lower case may be longer than it."""
    lower = text.lower()
    if len(lower) == len(text):
        return _WORD.findall(lower)
    return [w.lower() for w in _WORD.findall(text)]


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first, end) of a row of numbers, in one pass.

    Numbers that are not positive only move the running sum, so the scan stops at positive ones alone. Of each
    open segment it knows the sums before and after it, and the nearest earlier one that began lower.
    """
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    lows: list[float] = []
    highs: list[float] = []
    spans: list[tuple[int, int]] = []
    lower: list[int] = []
    for at in np.flatnonzero(scores > 0).tolist():
        low, high, first = float(sums[at]), float(sums[at + 1]), at
        while True:
            j = len(lows) - 1
            while j >= 0 and lows[j] >= low:
                j = lower[j]
            if j < 0 or highs[j] >= high:
                break
            low, first = lows[j], spans[j][0]
            del lows[j:], highs[j:], spans[j:], lower[j:]
        lows.append(low)
        highs.append(high)
        spans.append((first, at + 1))
        lower.append(j)
    return [(h - w, *s) for w, h, s in zip(lows, highs, spans, strict=True)]


def _scored(text: str, model: ToxicModel) -> tuple[int, list[tuple[float, int, int]]]:
    words = word_list(text)
    return len(words), segments(np.fromiter(map(model.word_score, words), float, len(words)))


def evidence(n_words: int, found: list[tuple[float, int, int]], model: ToxicModel) -> float:
    """Excess of the significant segments over chance, or by how much the best one falls short of it."""
    chance = model.log_k + math.log(max(1, n_words))
    excess = [model.rate * s - chance for s, _, _ in found]
    return sum(e for e in excess if e > 0) or max(excess, default=-chance)


def probability(value: float, model: ToxicModel) -> float:
    """Chance of the label 1 for evidence; past these bounds it changes nothing."""
    x = model.offset + model.slope * max(-30.0, min(60.0, value))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def word_odds(sample: DataFrame, text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(feature, score, apart): log-odds of words and of beginnings of words in a labelled sample.

    ``apart`` is the distance to the score of the longest shorter beginning that is kept by ``APART``, or to 0.
    A word counts once for each pair of neighbours, so copies of a text add nothing.
    """

    def run(rows: Iterator[tuple[int, str]]) -> Iterator[tuple]:
        for label, text in rows:
            words = word_list(text)
            for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                yield label, word, hash_pair(before, after)

    seen = per_text(sample, label_col, text_col, run, {"word": pa.string(), "around": pa.int64()})
    seen = seen.toDF("label", "word", "around").distinct()
    counts = seen.groupBy("word").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    counts = staged(counts, "word-counts")
    totals = counts.agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b")).first()
    all_a, all_b = float(totals["all_a"] or 0), float(totals["all_b"] or 0)
    each = all_a * all_b / (all_a + all_b) if all_a and all_b else 0.0
    a, b = F.col("a") * (each / all_a if all_a else 0.0), F.col("b") * (each / all_b if all_b else 0.0)
    share = (a + PRIOR * F.coalesce("above", F.lit(0.5))) / (a + b + PRIOR)
    odds = F.ln(share / (1 - share))
    apart = F.col("score") - F.coalesce("above_given", F.lit(0.0))
    # What a word gets that falls back to this beginning.
    given = F.when(F.abs("apart") >= APART, F.col("score")).otherwise(F.col("score") - F.col("apart"))
    found, levels = None, None
    for size in (*PREFIXES, None):
        if size:
            own = counts.where(F.length("word") > size).groupBy(F.substring("word", 1, size).alias("key"))
            own = own.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).withColumn("size", F.lit(size))
        else:
            own = counts.withColumnRenamed("word", "key").withColumn("size", F.lit(0))
        if levels is None:
            own = own.withColumns({c: F.lit(None).cast("double") for c in ("above", "above_given")})
        else:
            length = F.length("key") if size is None else F.lit(size)
            up = F.when(length > F.lit(PREFIXES[0]), F.least(length - 1, F.lit(PREFIXES[-1])))
            own = own.withColumn("up", F.substring("key", F.lit(1), up))
            above = levels.select(F.col("key").alias("up"), F.col("share").alias("above"), F.col("given").alias("above_given"))
            own = own.join(above, "up", "left").drop("up")
        name = F.concat("key", F.lit("*")) if size else F.col("key")
        own = own.select("key", name.alias("feature"), share.alias("share"), odds.alias("score"), "above_given")
        own = own.withColumn("apart", apart).withColumn("given", given).drop("above_given")
        own = staged(own, "word-odds")
        levels = own if levels is None else levels.unionByName(own)
        found = levels
    return found.select("feature", "score", "apart")


def hash_pair(before: str, after: str) -> int:
    """A number for two neighbours, the same in every process."""
    import zlib

    return zlib.crc32(before.encode()) << 32 >> 1 | zlib.crc32(after.encode()) >> 1


def fit_chance(lengths: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """(lambda, log K) of greatest likelihood for the best segments of clean texts of these lengths."""
    if not len(best) or best.max() <= 0:
        return MOST_RATE, 0.0
    lengths = np.maximum(lengths, 1).astype(float)

    def slope(rate: float) -> float:
        weights = lengths * np.exp(-rate * best)
        return len(best) / rate - best.sum() + len(best) * (weights * best).sum() / weights.sum()

    low, high = LEAST_RATE, MOST_RATE
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if slope(middle) > 0 else (low, middle)
    return low, math.log(len(best) / (lengths * np.exp(-low * best)).sum())


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> tuple[float, float]:
    """(slope, offset) of a logistic curve of labels over evidence; the slope is not negative."""
    x = np.clip(x, -30.0, 60.0)
    scale = max(1.0, float(np.abs(x).max()))
    design = np.stack([x / scale, np.ones_like(x)], 1)
    weights = np.zeros(2)
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (chance - y) + ridge * weights
        curve = (design * (chance * (1 - chance) + 1e-9)[:, None]).T @ design + ridge * np.eye(2)
        weights = weights - np.linalg.solve(curve, slope)
    if weights[0] < 0:
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
        return 0.0, math.log(share / (1 - share))
    return float(weights[0]) / scale, float(weights[1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = SAMPLE,
) -> ToxicModel:
    """A model from the labelled rows that are not held out (crc32 of the id mod 5 is 0).

    About ``sample`` of them are used, chosen by a hash of the id, which bounds what reaches the driver: a score
    for each word of their texts that stands ``APART``, and three numbers for each row of the fifth that
    calibrates. Null texts count as empty; labels other than 0 and 1 are left out.
    Without rows of both labels the model knows nothing and gives every text the share of the label 1, or 0.
    """
    label, known_labels = F.col(label_col).cast("int"), labels.where(F.col(label_col).isin(0, 1))
    fold = F.expr(HELD_OUT.format(id_col))
    known_labels = known_labels.where(fold != 0).select(F.col(id_col).alias("id"), label.alias("label"))
    total = known_labels.count()
    # The same rows on both sides, so that only texts of the sample are shuffled.
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(math.ceil((1 << 20) * min(1.0, sample / max(1, total))))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(part)
    rows = staged(texts.join(known_labels.where(part), "id").withColumn("fold", F.expr(HELD_OUT.format("id"))), "toxic-sample")
    learn, check = rows.where("fold != 4"), rows.where("fold = 4")
    if learn.agg(F.countDistinct("label")).first()[0] < 2:
        learn = rows
    if check.agg(F.countDistinct("label")).first()[0] < 2:
        check = rows
    share = rows.agg(F.avg("label")).first()[0]
    if not share or share == 1:
        return ToxicModel(offset=-30.0 if not share else 30.0)
    odds = word_odds(learn, "text", "label").where(F.abs("apart") >= APART)
    model = ToxicModel({r["feature"]: r["score"] for r in odds.select("feature", "score").toLocalIterator()})

    def best(pairs: Iterator[tuple[int, str]]) -> Iterator[tuple]:
        for y, text in pairs:
            n, found = _scored(text, model)
            yield y, n, max((s for s, _, _ in found), default=0.0)

    seen = per_text(check, "label", "text", best, {"n": pa.int64(), "best": pa.float64()}).toPandas()
    clean = seen[seen["label"] == 0]
    model.rate, model.log_k = fit_chance(clean["n"].to_numpy(), clean["best"].to_numpy())

    def weigh(pairs: Iterator[tuple[int, str]]) -> Iterator[tuple]:
        for y, text in pairs:
            yield y, evidence(*_scored(text, model), model)

    seen = per_text(check, "label", "text", weigh, {"x": pa.float64()}).toPandas()
    model.slope, model.offset = fit_logistic(seen["x"].to_numpy(), seen["label"].to_numpy(float))
    return model


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, passages) of every row: the probability of the label 1 and the significant segments.

    A passage has start and end in code points and its excess over chance. Null texts count as empty; they and
    texts without words have no passage and the score of the weakest evidence.
    """

    def run(rows: Iterator[tuple[object, str]]) -> Iterator[tuple]:
        for key, text in rows:
            n, found = _scored(text, model)
            chance, places, passages = model.log_k + math.log(max(1, n)), None, []
            for s, first, end in found:
                if model.rate * s > chance:
                    places = places or [m.span() for m in _WORD.finditer(text)]
                    span = {"start": places[first][0], "end": places[end - 1][1], "excess": model.rate * s - chance}
                    passages.append(span)
            yield key, probability(evidence(n, found, model), model), passages

    span = pa.struct({"start": pa.int64(), "end": pa.int64(), "excess": pa.float64()})
    return per_text(docs, id_col, text_col, run, {"score": pa.float64(), "passages": pa.list_(span)})


def without_toxic(docs: DataFrame, model: ToxicModel, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows scored below the limit, with all their columns.

    Null and empty texts have the weakest evidence and stay as long as that is below the limit. Repeated rows
    stay or go together; of an empty frame nothing is returned.
    """
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chances = (probability(evidence(*_scored(t.as_py() or "", model), model), model) for t in batch.column(place))
            yield batch.filter(pa.array([c < limit for c in chances], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
