"""Resampling towards a target: hashed n-gram counts of corpus and target give importance weights; Gumbel noise makes the draw."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tillbook.llm.common import stored
from tillbook.operators.sequence import number_rows

BUCKETS, LENGTH, SEED = 10_000, 3, 42
#: Words a document must have to be drawn, and the share that is drawn in percent.
LEAST_WORDS, PERCENT = 20, 5
SCALE = 1000

#: A-Z to lower case; every other ASCII character that is neither a letter nor a digit to a blank. All bytes of longer UTF-8 characters stay.
_TABLE = bytes(
    b if b >= 0x80 or chr(b).isdigit() or "a" <= chr(b) <= "z" else b + 32 if "A" <= chr(b) <= "Z" else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Letters, digits and characters beyond ASCII in a row, as UTF-8, A-Z in lower case."""
    return text.encode().translate(_TABLE).split() if text else []


def bucket_of_features(words: list[bytes], length: int = LENGTH, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of every run of 1 to ``length`` words joined by blanks: its crc32 goes on from that of the run without its last word."""
    crcs = list(map(zlib.crc32, words))
    runs = [np.array(crcs, np.int64)]
    after = [b" " + word for word in words]
    for n in range(1, min(length, len(words))):
        crcs = list(map(zlib.crc32, after[n:], crcs))
        runs.append(np.array(crcs, np.int64))
    return np.concatenate(runs) % buckets


def feature_counts(texts: DataFrame, length: int = LENGTH, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all ``texts`` each bucket has. Tasks count their own texts; the driver gets ``buckets`` sums at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(bucket_of_features(words_of(text), length, buckets).tolist())
        columns = [pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "n"])

    summed = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = np.zeros(buckets, np.int64)
    for bucket, n in summed.collect():
        found[bucket] = n
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket, the log of how much likelier the target has it than the source, both smoothed by one, in thousandths, down."""
    size, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratios = (((t + 1) * (s_all + size)) / ((s + 1) * (t_all + size)) for s, t in zip(source.tolist(), target.tolist()))
    return np.array([floor(SCALE * log(r)) for r in ratios], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from a hash of seed and doc_id alone; a null doc_id counts as an empty one."""
    own = "" if doc_id is None else doc_id
    h = int(hashlib.sha256(f"{seed}:{own}".encode()).hexdigest()[:8], 16)
    return floor(-SCALE * log(-log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight (the sum of the features' gains) and score (with noise) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    longs = ("n_words", "n_features", "weight", "score")
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(name, T.LongType()) for name in longs)])
    kind = to_arrow_type(docs.schema["doc_id"].dataType)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                features = bucket_of_features(words, length, len(own))
                weight = int(own[features].sum())
                rows.append((len(words), len(features), weight, weight + noise(doc_id, seed)))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(longs)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(kind), *columns], names=["doc_id", *longs])

    return docs.select("doc_id", "text").mapInArrow(read, schema)


def resample(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """Every document's n_features, weight and score, and its ``rank`` (1, 2, ..) among the drawn, null for others.

    Of the documents with at least ``least`` words ``percent`` in a hundred (down) are drawn, those with the highest scores; ties go to the
    smaller doc_id (nulls last), then by n_features and weight. The draw is a range sort over all tasks; none gathers the drawn.

    A null or empty text has no features, weight 0, and is never drawn; a text of any length is one row in its task. Repeated rows are drawn
    each on its own. An empty benchmark gives weights by the corpus alone, an empty corpus no rows. Other columns than doc_id and text
    are not used.
    """
    gain = gains(feature_counts(docs), feature_counts(benchmark))
    weighed = stored(weigh(docs, gain), "resampling-scores")
    fit = F.col("n_words") >= least
    falling = weighed.where(fit).select("doc_id", "n_features", "weight", "score", (-F.col("score")).alias("_falling"))
    ranked = number_rows(falling, ["_falling", "doc_id", "n_features", "weight"], "_drawn")
    drawn = percent * weighed.where(fit).count() // 100
    rank = F.when(F.col("_drawn") < drawn, F.col("_drawn") + 1).cast("long").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    others = weighed.where(~fit).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, rank).unionByName(others)
