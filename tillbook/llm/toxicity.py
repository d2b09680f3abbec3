"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.llm.common import among_first, hash_place, row_function

#: Features are hashed to 2**BITS places, which bounds the weights whatever the corpus holds.
BITS = 20
#: At most so many labelled documents are learned from.
TRAIN_ROWS = 20_000
EPOCHS = 3
#: Words are runs of these bytes, A-Z in lower case: letters, digits and all of UTF-8 beyond ASCII.
_WORD_BYTES = bytes(
    b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256)
)
# Odd multipliers that mix the hashes of the words of a pair: one for each gap.
_FIRST, _SECOND = 0x9E3779B97F4A7C15, (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Rates:
    """FTRL-proximal: ``alpha`` and ``beta`` set each coordinate's rate from its own gradients, ``l1`` its sparsity."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.0


@dataclass(frozen=True)
class Weights:
    """The coordinates that are not zero. Without examples of both labels there are none, and ``fitted`` is false."""

    places: np.ndarray
    values: np.ndarray
    bias: float
    fitted: bool


def hashed_features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Places of a text's words, word pairs, and pairs with one or two words between them, with repeats."""
    words = text.encode().translate(_WORD_BYTES).split() if text else []
    hashes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    parts = [hashes * np.uint64(_FIRST)]
    for gap, factor in enumerate(_SECOND, 1):
        mixed = hashes[:-gap] * np.uint64(_FIRST) ^ (hashes[gap:] + np.uint64(gap)) * np.uint64(factor)
        parts.append(mixed * np.uint64(_FIRST))
    return (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.uint32)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents as (doc_id, toxic, features), one for each doc_id.

    The ids that hash to the first places are taken, and none whose crc32 leaves 0 when divided by 5. Of several labels of
    a document the largest counts; null ids and null labels do not.
    """
    key = F.col("doc_id").cast("long")
    labelled = (
        labels.select(key.alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    ids = (
        labelled.where(among_first("doc_id", rows, labelled.select(F.count("*")).scalar()))
        .orderBy(hash_place("doc_id"), "doc_id")
        .limit(rows)
    )
    places = row_function(T.BinaryType(), lambda: lambda text: np.unique(hashed_features(text)).tobytes())
    # The sample has at most `rows` short rows, so it may be broadcast.
    found = docs.select(key.alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    return (
        found.select("doc_id", "toxic", F.struct(F.xxhash64("text").alias("h"), places("text").alias("f")).alias("_x"))
        .groupBy("doc_id", "toxic")
        .agg(F.min("_x").alias("_x"))
        .select("doc_id", "toxic", F.col("_x.f").alias("features"))
    )


def held_out(doc_id: Column) -> Column:
    """True for ids whose crc32 (of the id as text) is divisible by 5; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def ftrl(examples: Iterator[tuple[np.ndarray, int]], bits: int = BITS, rates: Rates = Rates()) -> Weights:
    """One pass of FTRL-proximal over (places, label) pairs. Each place keeps the sum of its squared gradients, which sets its own
    rate, and its weight stays 0 until its gradients sum to more than ``l1``. The bias has no penalty."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = 0.0
    labels = set()

    def weight(zs, ns):
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - rates.l1, 0.0)
        return -shrunk / ((rates.beta + np.sqrt(ns)) / rates.alpha + rates.l2)

    for places, label in examples:
        labels.add(label)
        zs, ns = z[places], n[places]
        w = weight(zs, ns)
        bias = -bias_z / ((rates.beta + math.sqrt(bias_n)) / rates.alpha)
        g = 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, w.sum() + bias)))) - label
        z[places] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / rates.alpha * w
        n[places] = ns + g * g
        bias_z += g - (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / rates.alpha * bias
        bias_n += g * g
    w = weight(z, n)
    kept = np.flatnonzero(w)
    return Weights(
        kept.astype(np.uint32),
        w[kept].astype(np.float32),
        -bias_z / ((rates.beta + math.sqrt(bias_n)) / rates.alpha),
        labels == {0, 1},
    )


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, epochs: int = EPOCHS, rates: Rates = Rates()) -> Weights:
    """Learn from at most ``rows`` labelled documents, read ``epochs`` times in a fixed order.

    The learner is sequential: one task streams over the sorted sample and holds two numbers for each place, no
    documents. What returns to the driver is the sparse weights, at most 2**BITS of them.
    """
    order = F.xxhash64("doc_id", "epoch")
    sample = (
        labelled_sample(docs, labels, rows)
        .withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
        .repartition(1)
        .sortWithinPartitions("epoch", order, "doc_id")
    )

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learned = ftrl(
            (np.frombuffer(f, np.uint32), int(y)) for b in batches for f, y in zip(b["features"], b["toxic"])
        )
        yield pd.DataFrame(
            {
                "places": [learned.places.tobytes()],
                "values": [learned.values.tobytes()],
                "bias": [learned.bias],
                "fitted": [learned.fitted],
            }
        )

    learned = sample.select("toxic", "features").mapInPandas(
        train, "places binary, values binary, bias double, fitted boolean"
    )
    row = learned.first()
    if row is None:  # an empty sample may have no partition at all
        return Weights(np.zeros(0, np.uint32), np.zeros(0, np.float32), 0.0, False)
    return Weights(
        np.frombuffer(row["places"], np.uint32), np.frombuffer(row["values"], np.float32), row["bias"], row["fitted"]
    )


def score_text(text: str | None, dense: np.ndarray, bias: float) -> float:
    places = hashed_features(text)
    found = np.unique(places[dense[places] != 0])
    total = float(dense[found].sum(dtype=np.float64)) + bias
    return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, total))))


def score_of(text: Column, weights: Weights, spark: SparkSession) -> Column:
    """A text's score from 0 to 1, from the whole text alone.

    A null or empty text has no feature and scores by the bias. Weights without examples of both labels score 0.
    """
    if not weights.fitted:
        return F.lit(0.0)
    sent = spark.sparkContext.broadcast((weights.places, weights.values))
    bias = float(weights.bias)

    def prepare():
        places, values = sent.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[places] = values
        return lambda value: score_text(value, dense, bias)

    return row_function(T.DoubleType(), prepare)(text)


def drop_toxic(docs: DataFrame, weights: Weights, least: float = 0.5) -> DataFrame:
    """The documents, all columns as they are, that score under ``least``.

    Null and empty texts score by the bias, so they stay unless most labelled texts are toxic; of repeated rows all stay or all go. Weights
    without examples of both labels keep every document.
    """
    return docs.where(score_of(F.col("text"), weights, docs.sparkSession) < least)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled documents outside the held-out fifth, then score every document.

    Repeated rows each get a row, equal texts score the same, a null doc_id is not held out. Texts are scored whole, however long; each
    feature counts once, and one text is held by one task. Other columns than doc_id and text are not used.
    """
    scored = docs.select("doc_id", score_of(F.col("text"), fit(docs, labels), docs.sparkSession).alias("score"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
