"""Language-model scoring: the difference of a document's cross-entropies under a target and a background bigram model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import stored, words_of

#: Weight of the bigram's share among those of its first word, and of the uniform part of a single word's probability.
BIGRAM_WEIGHT, UNIFORM_WEIGHT = 0.7, 0.01
#: Text of a block, in bytes. A longer text is a block of its own.
BLOCK_BYTES = 6_000_000
#: Keys of what begins a document and of all words together; those of words are other even numbers, of bigrams odd ones.
BEGIN, ALL = np.uint64(0), np.uint64(2)

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_SCORES = "doc_id {}, n_words long, target_loss double, background_loss double, score double"


def word_keys(text: str | None) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) << np.uint64(1)


@dataclass(frozen=True)
class Tokens:
    """The words of some texts one after another: the text each is in, its key, that of the word before, and of both."""

    doc: np.ndarray
    word: np.ndarray
    before: np.ndarray
    pair: np.ndarray
    lengths: np.ndarray


def tokens(texts: list[str | None]) -> Tokens:
    keys = [word_keys(text) for text in texts]
    lengths = np.array([len(k) for k in keys], np.int64)
    word = np.concatenate([*keys, np.zeros(0, np.uint64)])
    before = np.concatenate((np.zeros(1, np.uint64), word))[: len(word)]
    starts = np.cumsum(lengths) - lengths
    before[starts[lengths > 0]] = BEGIN
    pair = (before * _MIX[0] + word) * _MIX[1]
    pair = (pair ^ pair >> np.uint64(31)) | np.uint64(1)
    return Tokens(np.repeat(np.arange(len(texts)), lengths), word, before, pair, lengths)


def own_counts(t: Tokens, target: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, background, target) of the texts, keys ascending, and where among them each word, each bigram, and what begins a document
    is. What begins a document counts once for each text with a word."""
    begin = np.flatnonzero(t.lengths)
    keys = np.concatenate((t.word, t.pair, np.full(len(begin), BEGIN), np.full(len(begin[:1]), ALL)))
    found, place = np.unique(keys, return_inverse=True)
    place, everything = place[: len(keys) - len(begin[:1])], place[len(keys) - len(begin[:1]) :]
    marked = target[np.concatenate((t.doc, t.doc, begin))]
    background, of_target = (np.bincount(p, minlength=len(found)) for p in (place, place[marked]))
    background[everything] += t.lengths.sum()
    of_target[everything] += t.lengths[target].sum()
    return found, background, of_target, place


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers, compressed with their bytes of equal weight side by side."""
    return zstandard.compress(values.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def in_blocks(docs: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """(block, bytes, ids, data): ``docs`` in blocks of about ``size`` bytes of text, each one row with its doc_ids and the texts as
    compressed Arrow data, written: what belongs to a block is then the same however often it is read."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, filled, parts = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            begin = 0
            for row, length in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
                filled += length or 0
                if filled > size:
                    parts.append(batch.slice(begin, row - begin))
                    yield from emit(block, filled - (length or 0), parts)
                    block, filled, parts, begin = block + 1, length or 0, [], row
            parts.append(batch.slice(begin))
        yield from emit(block, filled, parts)

    def emit(block: int, filled: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks() if parts else None
        if rows:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.select(["text"]).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows.select(["text"]))
            ids = pa.array([rows.column("doc_id").to_pylist()], pa.list_(rows.schema.field("doc_id").type))
            columns = [pa.array([block]), pa.array([filled]), ids, pa.array([sink.getvalue().to_pybytes()])]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "bytes", "ids", "data"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select("doc_id", "text").mapInArrow(gather, f"block long, bytes long, ids array<{kind}>, data binary")
    return stored(numbered, "lm-blocks")


def with_targets(blocks: DataFrame, chosen: DataFrame) -> DataFrame:
    """``blocks`` with ``targets``, the places of the documents whose doc_id is in ``chosen`` (distinct), or null. Texts are not joined
    to ids: only the places found are sent to the blocks."""
    ids = blocks.select("block", F.posexplode("ids").alias("place", "doc_id"))
    places = ids.join(chosen, "doc_id").groupBy("block").agg(F.collect_list("place").alias("targets"))
    return blocks.select("block", "ids", "data").join(places, "block", "left")


def opened(data: bytes, targets: list[int] | None) -> tuple[Tokens, np.ndarray]:
    """Tokens of the texts in a block, and which of the texts are of the target."""
    t = tokens(pa.ipc.open_stream(data).read_all().column("text").to_pylist())
    target = np.zeros(len(t.lengths), bool)
    target[targets or []] = True
    return t, target


def block_counts(blocks: DataFrame, bits: int) -> DataFrame:
    """(part, block, key, background, target) of the words and bigrams of each block, in one row for each of 2^``bits`` ranges of keys.

    Keys are packed as the steps between them: hashes in order are about as many bits shorter as their number has.
    """

    def count(rows: pa.Table) -> pa.Table:
        block, data, targets = (rows.column(name)[0] for name in ("block", "data", "targets"))
        t, target = opened(data.as_py(), targets.as_py())
        key, *n, _ = own_counts(t, target)
        part = (key >> np.uint64(1) >> np.uint64(63 - bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        spans = list(zip(cuts, [*cuts[1:], len(key)]))
        out = {"part": part[cuts], "block": pa.repeat(block, len(cuts))}
        out["key"] = pa.array([packed(np.diff(key[i:j], prepend=np.uint64(0))) for i, j in spans], pa.binary())
        for side, own in zip(("background", "target"), n):
            out[side] = pa.array([packed(own[i:j]) for i, j in spans], pa.binary())
        return pa.table(out)

    # By groups of one row, so that a batch of Arrow data is one block.
    schema = "part long, block long, key binary, background binary, target binary"
    return blocks.groupBy("block").applyInArrow(count, schema)


def shared_counts(counts: DataFrame) -> DataFrame:
    """(part, block, background, target): for each row of ``counts`` those of the whole corpus, of the same keys in the same order.

    A range of keys has at most one row for each block, and each of its keys once in it, so no range is hot.
    """

    def of_part(rows: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpacked(steps), dtype=np.uint64) for steps in rows.column("key").to_pylist()]
        ends = np.cumsum([len(k) for k in keys])[:-1]
        found, place = np.unique(np.concatenate(keys), return_inverse=True)
        out = {name: rows.column(name) for name in ("part", "block")}
        for side in ("background", "target"):
            own = np.concatenate([unpacked(n) for n in rows.column(side).to_pylist()])
            total = np.bincount(place, own, len(found)).astype(np.int64)[place]
            out[side] = pa.array([packed(n) for n in np.split(total, ends)], pa.binary())
        return pa.table(out)

    return counts.groupBy("part").applyInArrow(of_part, "part long, block long, background binary, target binary")


def corpus_counts(t: Tokens, target: np.ndarray, shared: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Where among the texts' keys each word and bigram is, and the keys' counts in the whole corpus, in columns for target and background.

    ``shared`` names keys by their place and gives their counts on both sides; the others are in no other text.
    """
    keys, background, of_target, places = own_counts(t, target)
    n = np.stack([of_target, background, keys == ALL], axis=1)
    place, shared_target, shared_background = shared
    n[place, 0], n[place, 1] = shared_target, shared_background
    return places, n


def losses(t: Tokens, target: np.ndarray, places: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What each word's probabilities cost in nats under the target and the background model, its own text left out of both."""
    size = len(t.word)
    word, pair, begin = places[:size], places[size : 2 * size], places[2 * size]

    def in_own_text(place: np.ndarray) -> np.ndarray:
        _, at, times = np.unique(t.doc * len(n) + place, return_inverse=True, return_counts=True)
        return times[at]

    own_word, own_pair = in_own_text(word), in_own_text(pair)
    # What begins the text is in it once; a word before another is in it as often as it occurs, at its end too.
    begins = t.before == BEGIN
    before, own_before = (np.where(begins, first, np.roll(x, 1)) for first, x in ((begin, word), (1, own_word)))
    totals = n[np.flatnonzero(n[:, 2])[0]]
    cost = np.empty((size, 2))
    for side, taken in enumerate((target[t.doc], True)):
        count = np.ascontiguousarray(n[:, side])
        rest = totals[side] - t.lengths[t.doc] * taken
        share = np.divide(count[word] - own_word * taken, rest, out=np.zeros(size), where=rest > 0)
        single = (1 - UNIFORM_WEIGHT) * share + UNIFORM_WEIGHT / totals[1]
        context = count[before] - own_before * taken
        both = np.divide(count[pair] - own_pair * taken, context, out=np.zeros(size), where=context > 0)
        cost[:, side] = -np.log(np.where(context > 0, BIGRAM_WEIGHT * both + (1 - BIGRAM_WEIGHT) * single, single))
    return cost


def score(docs: DataFrame, chosen: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """Score ``docs`` (doc_id, text) under the models of those whose doc_id is in ``chosen`` (doc_id, distinct) and of all.

    One row per document: n_words, mean loss per word under each model, and ``score``, the mean of the words' differences: the
    smaller, the more like the target. A null or empty text has no words, losses and score of 0.

    Every word and bigram of the corpus counts; nothing is cut off and no model is collected or sent to all tasks. Documents go in
    blocks of ``size`` bytes. A block sends its distinct words and bigrams, packed by ranges of keys, of which there are about half as
    many as blocks, and gets back the corpus's counts in the same order. A text longer than ``size`` is one block, whose words one task
    holds as numbers.
    """
    blocks = in_blocks(docs, size)
    # All columns of what is marked are read both times, so that Spark shuffles the texts once.
    filled = blocks.agg(F.sum("bytes")).first()[0] or 0
    marked = with_targets(blocks, chosen)
    shared = shared_counts(block_counts(marked, (filled // (2 * size)).bit_length()))

    def of_block(texts: pa.Table, counts: pa.Table) -> pa.Table:
        ids, data, targets = (texts.column(name)[0] for name in ("ids", "data", "targets"))
        t, target = opened(data.as_py(), targets.as_py())
        mean = np.zeros((len(target), 2))
        if len(t.word):
            parts = counts.sort_by("part")
            packs = (parts.column(side).to_pylist() for side in ("target", "background"))
            given = [np.concatenate([unpacked(n) for n in side]) for side in packs]
            cost = losses(t, target, *corpus_counts(t, target, (np.arange(len(given[0])), *given)))
            for side in range(2):
                mean[:, side] = np.bincount(t.doc, cost[:, side], len(target)) / np.maximum(t.lengths, 1)
        columns = [ids.values, t.lengths, mean[:, 0], mean[:, 1], mean[:, 0] - mean[:, 1]]
        return pa.table(dict(zip(("doc_id", "n_words", "target_loss", "background_loss", "score"), columns)))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return marked.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(of_block, _SCORES.format(kind))


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """Score every document; the target is the documents whose ``quality`` label is 1, the background all documents.

    A document never counts as evidence for itself: its own words and bigrams are left out of both models. A bigram's probability is 0.7
    of its share among those of its first word and 0.3 of the single word's, which is 0.99 of its share and 0.01 spread evenly;
    after a word that the rest of a side's documents lack, it is the single word's alone. Words and bigrams are known by 64-bit
    hashes.

    Labels with null doc_id or quality don't count, nor do repeated ones twice. A corpus without target documents has a uniform
    target model. Repeated rows each get a row and count each time, so that copies are evidence for one another. Losses are rounded to
    six places. Texts are scored whole, however long, one text by one task. Other columns than doc_id and text are not used.
    """
    chosen = stored(labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct(), "lm-target")
    rounded = {n: F.round(n, 6) for n in ("target_loss", "background_loss", "score")}
    return score(docs, chosen, size).withColumns(rounded)
