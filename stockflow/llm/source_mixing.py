"""Mixing a corpus to target shares of source, language and topic by iterative proportional fitting.

Token weights of the cells of source, language and topic are raked: scaled to each list of target shares in
turn until all hold. The ratio of a cell's raked to its own tokens, times one factor for all cells, is the
probability with which its documents stay, by a hash of their id, so a rerun keeps the same ones. The factor is
the one at which a stated share of all tokens stays, and no probability exceeds 1, so a rare cell only stays
below its target and never decides how much of the rest goes.

Targets are a table (dimension, value, share); topics and tokens are columns of the documents where they have
such. Without them the operator makes do with targets drawn from the corpus's own shares, with words as tokens
and with the form of a text as its topic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import count_of, known, staged, unused, words

DIMENSIONS = ("source", "lang", "topic")
#: Exponent that draws the shares of a margin together: 1 leaves them, 0 makes them equal.
SMOOTHING = 0.9
#: Share of all tokens that stays.
RATE = 0.9
ROUNDS = 40
#: Rounds after which the cells are written.
ROUNDS_WRITTEN = 4
#: Largest difference between a raked and a target share at which raking ends.
TOLERANCE = 1e-12
_HASH_RANGE = 1 << 52
_SEED = "mixing"


def token_count(text: Column) -> Column:
    """Words of a text, at least one, as its weight."""
    return F.greatest(F.size(words(text)), F.lit(1)).cast("bigint")


def topic_of(text: Column) -> Column:
    """What a text is by its form: a list, code or symbols, a note, an article or a long read."""
    plain = known(text)
    size = F.length(plain)
    marks, signs = count_of(plain, "|"), count_of(plain, "#*$%&<>{}=;")
    return (
        F.when(marks * 50 > size, "list")
        .when(signs * 20 > size, "symbols")
        .when(size < 600, "note")
        .when(size < 6000, "article")
        .otherwise("long read")
    )


def with_dimensions(
    docs: DataFrame, text_col: str = "text", topic_col: str | None = None, tokens_col: str | None = None
) -> tuple[DataFrame, list[str]]:
    """The rows with a key column for each dimension and their tokens.

    Missing sources, languages and topics are one value each, the empty one. Tokens that are missing or below 1
    count as 1. Without ``topic_col`` and ``tokens_col`` both come from the text.
    """
    keys = unused(docs, *(f"key_{d}" for d in DIMENSIONS), "tokens")
    columns = {c.lower() for c in docs.columns}
    named = [d if d in columns else None for d in DIMENSIONS[:2]]
    values = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c else F.lit("") for c in (*named, topic_col)]
    if not topic_col:
        values[2] = topic_of(F.col(text_col))
    given = F.greatest(F.coalesce(F.col(tokens_col).cast("bigint"), F.lit(1)), F.lit(1)) if tokens_col else None
    values.append(token_count(F.col(text_col)) if given is None else given)
    return docs.withColumns(dict(zip(keys, values, strict=True))), keys


def margins(cells: DataFrame) -> DataFrame:
    """(dimension, value, tokens) of the values of all dimensions."""
    each = [F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS]
    rows = cells.select("tokens", F.explode(F.array(*each)).alias("m"))
    return rows.groupBy("m.dimension", "m.value").agg(F.sum("tokens").alias("tokens"))


def smoothed_targets(cells: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """(dimension, value, share): each margin's own shares to the power of ``smoothing``, brought to the sum 1."""
    found = margins(cells).withColumn("part", F.pow("tokens", F.lit(smoothing)))
    return found.select("dimension", "value", (F.col("part") / _sum_of("part", "dimension")).alias("share"))


def _sum_of(column: str, *keys: str) -> Column:
    return F.sum(column).over(Window.partitionBy(*keys))


def _wanted(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """(dimension, value, target) for every value that occurs; the targets of a dimension add up to 1, or are all 0."""
    given = targets.select("dimension", F.col("value").cast("string").alias("value"), F.col("share").cast("double").alias("share"))
    each = Window.partitionBy("dimension")
    # A target that no value has still counts as one given for its dimension.
    known_dimensions = given.select("dimension").distinct().withColumn("given", F.lit(True))
    rows = margins(cells).join(given, ["dimension", "value"], "left").join(known_dimensions, "dimension", "left")
    rows = rows.withColumn("wanted", F.when(F.col("given"), F.coalesce("share", F.lit(0.0))).otherwise(F.col("tokens").cast("double")))
    total = F.sum("wanted").over(each)
    return rows.select("dimension", "value", F.when(total > 0, F.col("wanted") / total).otherwise(0.0).alias("target"))


def rake(cells: DataFrame, targets: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Cells (source, lang, topic, tokens) with their raked share of the whole.

    ``targets`` has a row (dimension, value, share) for each value of a margin. A value without one counts as
    target 0 and its cells get nothing; targets of values that do not occur are left out, and the rest scaled to
    the sum 1. A dimension without any target keeps its own shares. Cells are one for each combination that
    occurs, however many documents there are; a window holds those of one value, on disk if they are many. Some
    rounds at a time are written, so plans stay short.
    """
    wanted = staged(_wanted(cells, targets), "targets")
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d in DIMENSIONS:
        own = wanted.where(F.col("dimension") == d)
        now = now.join(own.select(F.col("value").alias(d), F.col("target").alias(f"target_{d}")), d)
    now = staged(now, "cells")
    for done in range(0, rounds, ROUNDS_WRITTEN):
        for _ in range(min(ROUNDS_WRITTEN, rounds - done)):
            for d in DIMENSIONS:
                now = _scaled(now, d)
        now = staged(now, "raked")
        if _error(now) < tolerance:
            break
    total = F.lit(now.agg(F.sum("weight")).first()[0]).cast("double")
    return now.select(*DIMENSIONS, "tokens", (F.col("weight") / total).alias("share"))


def _scaled(cells: DataFrame, d: str) -> DataFrame:
    """Cells scaled so that the weights of each value of a dimension add up to its target."""
    total = _sum_of("weight", d)
    return cells.withColumn("weight", F.col("weight") * F.when(total > 0, F.col(f"target_{d}") / total).otherwise(0.0))


def _error(cells: DataFrame) -> float:
    """The largest difference between a raked and a target share, over all values of all dimensions."""
    each = [F.struct(F.lit(d).alias("dim"), F.col(d).alias("value"), F.col(f"target_{d}").alias("target")) for d in DIMENSIONS]
    margin = cells.select("weight", F.explode(F.array(*each)).alias("m")).groupBy("m.dim", "m.value")
    margin = margin.agg(F.sum("weight").alias("sum"), F.first("m.target").alias("target"))
    return margin.agg(F.max(F.abs(F.col("sum") - F.col("target")))).first()[0] or 0.0


def rate_factor(cells: DataFrame, rate: float) -> float:
    """The k at which sum(tokens * min(1, k * ratio)) is the rate's share of all tokens of the cells.

    The sum is concave in k, so steps along its slope approach k from below, and each but the last brings
    further cells to the probability 1. Where cells with a ratio hold fewer tokens than asked for, k is infinite.
    """
    if not 0 < rate <= 1:
        raise ValueError(f"rate must be above 0 and at most 1, not {rate}")
    factor, full_cells = 0.0, -1
    while True:
        full = F.col("ratio") * factor >= 1
        found = cells.agg(
            F.sum("tokens").cast("double").alias("all"),
            F.count_if(full).alias("n_full"),
            F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)).cast("double").alias("full"),
            F.coalesce(F.sum(F.when(~full, F.col("tokens") * F.col("ratio"))), F.lit(0.0)).alias("slope"),
        ).first()
        if found["n_full"] <= full_cells:
            return factor
        if not found["slope"]:
            return math.inf
        full_cells, factor = found["n_full"], (rate * found["all"] - found["full"]) / found["slope"]


def probabilities(
    docs: DataFrame,
    targets: DataFrame | None = None,
    text_col: str = "text",
    rate: float = RATE,
    topic_col: str | None = None,
    tokens_col: str | None = None,
) -> DataFrame:
    """(source, lang, topic, tokens, share, probability) of every cell of a corpus; of an empty one, none.

    Without targets those of ``smoothed_targets`` are taken. Cells without a share have the probability 0; of
    the tokens of all cells about the share ``rate`` stays, or all that have a share if these are fewer.
    """
    rows, keys = with_dimensions(docs, text_col, topic_col, tokens_col)
    rows = rows.select(*[F.col(k).alias(d) for k, d in zip(keys, (*DIMENSIONS, "tokens"), strict=True)])
    cells = staged(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    raked = rake(cells, smoothed_targets(cells) if targets is None else targets).withColumn("ratio", F.col("share") / F.col("tokens"))
    raked = staged(raked, "shares")
    chance = F.when(F.col("ratio") > 0, F.least(F.lit(1.0), F.col("ratio") * rate_factor(raked, rate))).otherwise(0.0)
    return staged(raked.select(*DIMENSIONS, "tokens", "share", chance.alias("probability")), "probabilities")


def drawn(id_col: str) -> Column:
    """A number from 0 to below 1 for each id, the same in every run; a null id counts as text ``null``."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{_SEED}:"), key)), 1, 13), 16, 10)
    return digest.cast("double") / _HASH_RANGE


def mixed(
    docs: DataFrame,
    targets: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    rate: float = RATE,
    topic_col: str | None = None,
    tokens_col: str | None = None,
) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, probability, drawn, kept) of every row; repeated rows draw alike."""
    cells = probabilities(docs, targets, text_col, rate, topic_col, tokens_col)
    rows = docs.select(*_needed(docs, id_col, text_col, topic_col, tokens_col))
    rows, keys = with_dimensions(rows, text_col, topic_col, tokens_col)
    rows = rows.select(F.col(id_col).alias("doc_id"), *[F.col(k).alias(d) for k, d in zip(keys, (*DIMENSIONS, "tokens"), strict=True)])
    found = rows.join(cells.select(*DIMENSIONS, "probability"), list(DIMENSIONS))
    found = found.withColumn("drawn", drawn("doc_id")).withColumn("kept", F.col("drawn") < F.col("probability"))
    return found.select("doc_id", *DIMENSIONS, "tokens", "probability", "drawn", "kept")


def _needed(docs: DataFrame, *columns: str | None) -> list[str]:
    wanted = {*columns, *DIMENSIONS[:2]}
    return [c for c in docs.columns if c in wanted]


def sampled(
    docs: DataFrame,
    targets: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    rate: float = RATE,
    topic_col: str | None = None,
    tokens_col: str | None = None,
) -> DataFrame:
    """The rows that stay, with all their columns.

    Null and empty texts count one token and draw like any other; repeated rows stay or go together. Of an empty
    frame nothing stays.
    """
    cells = probabilities(docs, targets, text_col, rate, topic_col, tokens_col)
    rows, keys = with_dimensions(docs, text_col, topic_col, tokens_col)
    (chance,) = unused(rows, "chance")
    cells = cells.select(*[F.col(d).alias(k) for d, k in zip(DIMENSIONS, keys, strict=False)], F.col("probability").alias(chance))
    found = rows.join(cells, keys[:3])
    return found.where(drawn(id_col) < F.col(chance)).select(*docs.columns)
