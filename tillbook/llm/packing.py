"""Best-fit packing of tokenized documents after a dominance reduction in the manner of Martello and Toth."""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.llm.common import stored

CAPACITY = 2048
#: Follows the ids of each document.
END_ID = 0
VOCABULARY = "byte_bpe_50k"


# --- Tokens and pieces ------------------------------------------------------------------------


def encoder(vocabulary: str = VOCABULARY, added: bool = False):
    """A function from a text to the ids that tokenizers gives with this vocabulary's JSON file. With ``added``, the file's added
    tokens (<|endoftext|>) in a text are their own ids, as tokenizers has it by default; without, they are text like any other.

    The same vocabulary as ranks gives the same ids in a fifth of the time, but knows no added tokens: texts are split at those
    first. It gives up on very long runs of white space; those parts take the JSON file.
    """
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow: list[tokenizers.Tokenizer] = []

    def encode_plain(text: str) -> list[int]:
        try:
            return fast.encode_ordinary(text)
        except BaseException as failure:  # a panic of the library is no Exception
            if type(failure).__name__ != "PanicException":
                raise
        if not slow:
            slow.append(tokenizers.Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json")))
            slow[0].encode_special_tokens = True
        return slow[0].encode(text, add_special_tokens=False).ids

    own = added_tokens(vocabulary) if added else {}
    if not own:
        return encode_plain
    split = re.compile("(" + "|".join(map(re.escape, sorted(own, key=len, reverse=True))) + ")").split

    def encode(text: str) -> list[int]:
        parts = split(text)
        if len(parts) == 1:
            return encode_plain(text)
        return [i for k, part in enumerate(parts) if part for i in ([own[part]] if k % 2 else encode_plain(part))]

    return encode


def added_tokens(vocabulary: str = VOCABULARY) -> dict[str, int]:
    """The added tokens of the vocabulary's JSON file and their ids."""
    with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    for token in tokens:
        if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
            raise ValueError(f"{vocabulary}: {token['content']} is not found by its characters alone")
    return {token["content"]: token["id"] for token in tokens}


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits, else full ones, of which the first may be shorter."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((start, capacity) for start in range(first, length, capacity))]


def pieces(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, keep_ids: bool = False, added: bool = False
) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32, and ``ids`` (unsigned little-endian
    32-bit) if asked for.

    ``chunk`` and ``place`` number the pieces of each length: place counts them within a task, and chunk is the task. They
    are stable once the rows have been written.
    """
    fields = [docs.schema["doc_id"], *_PIECE_FIELDS] + ([T.StructField("ids", T.BinaryType())] if keep_ids else [])
    schema = T.StructType(fields)

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, added)
        seen = np.zeros(capacity + 1, np.int64)
        chunk = TaskContext.get().partitionId()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), END_ID], "<u4")
                for number, (start, length) in enumerate(cut(len(ids), capacity)):
                    data = ids[start : start + length].tobytes()
                    row = (doc_id, number, start, length, zlib.crc32(data), chunk, int(seen[length]))
                    rows.append((*row, data) if keep_ids else row)
                    seen[length] += 1
            if rows:
                kinds = [batch.schema.field("doc_id").type, *_ARROW_PIECE, *([pa.binary()] if keep_ids else [])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)], names=[f.name for f in fields]
                )

    return docs.select("doc_id", "text").mapInArrow(tokenize, schema)


_PIECE_FIELDS = [
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("chunk", T.IntegerType()),
    T.StructField("place", T.LongType()),
]
_ARROW_PIECE = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


# --- The plan: lengths and counts, not documents ----------------------------------------------


@dataclass
class Plan:
    """Where the items of each length go. A row: of the items of a length, ``items`` from number ``rank`` on fill
    sequences from ``sequence`` on, ``each`` to a sequence, from ``offset`` on."""

    capacity: int
    left: dict[int, int]
    sequences: int = 0
    rows: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    used: dict[int, int] = field(default_factory=dict)

    def put(self, length: int, items: int, sequence: int, offset: int, each: int) -> None:
        rank = self.used.get(length, 0)
        self.rows.append((length, rank, items, sequence, offset, each))
        self.used[length] = rank + items
        self.left[length] -= items
        if not self.left[length]:
            del self.left[length]

    def fix(self, lengths: Sequence[int], copies: int) -> None:
        """Fill ``copies`` new sequences with one item of each of the lengths."""
        offset = 0
        for length in lengths:
            self.put(length, copies, self.sequences, offset, 1)
            offset += length
        self.sequences += copies


def dominating(lengths: list[int], count: dict[int, int], large: int, capacity: int) -> list[int] | None:
    """Companions of an item of length ``large`` that no other choice can better, or None if that can't be shown.

    A set dominates another if the other's items can be dealt to its own items without exceeding any. ``lengths`` are
    those left, ascending. Sets of up to three items are looked at:
    nothing fits beside it; one item fills it; only one more fits: the largest; or at most two more fit, and one item is no less
    than any pair, or one pair is no less than any in both of its items.
    """
    room = capacity - large

    def free(length: int) -> int:
        return count.get(length, 0) - (length == large)

    def largest(most: int, but: int | None = None) -> int | None:
        at = bisect_right(lengths, most)
        while at:
            at -= 1
            if free(lengths[at]) - (lengths[at] == but) > 0:
                return lengths[at]
        return None

    smallest: list[int] = []
    for length in lengths:
        smallest += [length] * min(free(length), 3 - len(smallest))
        if len(smallest) == 3 or length > room:
            break
    one = largest(room)
    if one is None:
        return []
    if one == room or sum(smallest[:2]) > room or len(smallest) < 2:
        return [one]
    if len(smallest) == 3 and sum(smallest) <= room:
        return None
    best_pair = max(
        (a + b for a in lengths if a <= room and free(a) > 0 for b in [largest(room - a, a)] if b is not None), default=0
    )
    if one >= best_pair:
        return [one]
    second = largest(room - one, one)
    others = [b for b in lengths if 2 * b <= room and free(b) > 0 and (largest(room - b, b) or 0) >= b]
    if second is not None and second >= max(others, default=0):
        return [one, second]
    return None


def reduce_by_dominance(plan: Plan) -> None:
    """Fix sets that provably belong to some best packing, from the longest items down, until a pass fixes none."""
    changed = True
    while changed:
        changed = False
        for large in sorted(plan.left, reverse=True):
            while large in plan.left:
                companions = dominating(sorted(plan.left), plan.left, large, plan.capacity)
                if companions is None:
                    break
                group = [large, *companions]
                plan.fix(group, min(plan.left[length] // group.count(length) for length in set(group)))
                changed = True


def best_fit(plan: Plan) -> None:
    """The rest in descending lengths, each item into the fullest sequence that takes it. Sequences with equal room are one interval."""
    rooms: list[int] = []  # ascending, those with open sequences
    intervals: dict[int, list[tuple[int, int]]] = {}

    def open_up(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in intervals:
                insort(rooms, room)
            intervals.setdefault(room, []).append((first, count))

    for length in sorted(plan.left, reverse=True):
        while items := plan.left.get(length, 0):
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = intervals[room].pop()
                if not intervals[room]:
                    del intervals[room], rooms[at]
            else:
                room, first = plan.capacity, plan.sequences
                count = -(-items // (room // length))
                plan.sequences += count
            each = room // length
            full = min(count, items // each)
            if full:
                plan.put(length, full * each, first, plan.capacity - room, each)
                open_up(room - each * length, first, full)
            elif count:
                plan.put(length, items, first, plan.capacity - room, items)
                open_up(room - items * length, first, 1)
                full = 1
            if full < count:
                rest = items - full * each
                if room == plan.capacity and 0 < rest < each:
                    plan.put(length, rest, first + full, 0, rest)
                    open_up(room - rest * length, first + full, 1)
                    full += 1
                open_up(room, first + full, count - full)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """A plan for items given as a count for each length. Its work and size depend on the capacity, not on the number of items."""
    plan = Plan(capacity, {length: n for length, n in counts.items() if n})
    reduce_by_dominance(plan)
    best_fit(plan)
    return plan


# --- From the plan to the pieces --------------------------------------------------------------


def pack(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, keep_ids: bool = False, added: bool = False
) -> DataFrame:
    """Every piece of every document with its sequence and its offset there.

    Documents are tokenized and cut once, and the pieces written to the shared folder. The driver sees one count for each
    length, at most ``capacity`` of them, and plans on those. The pieces of a length are numbered through all tasks
    (place in the task, and a running sum over the tasks' counts), and a piece's number finds its row of the plan.

    With ``added``, added tokens of the vocabulary in a text are their own ids (see ``encoder``); the queries ask for that.
    A null or empty text is its end mark alone. Null doc_ids and repeated rows are packed like any other. Equal
    lengths may change places between runs. An empty table gives no rows. Other columns than doc_id and text are not used.
    """
    cut_up = stored(pieces(docs, capacity, vocabulary, keep_ids, added), "packing-pieces")
    counts = cut_up.groupBy("chunk", "length").agg((F.max("place") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = stored(
        counts.select("chunk", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "packing-counts"
    )
    totals = {row["length"]: row["n"] for row in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranked = cut_up.join(base.drop("n"), ["chunk", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    placed = ranked.withColumn("_at", place_by(plan_packing(totals, capacity), docs)(F.col("length"), F.col("rank")))
    kept = [f.name for f in cut_up.schema if f.name not in ("chunk", "place")]
    return placed.select(*kept, "_at.sequence_id", "_at.offset")


def place_by(plan: Plan, docs: DataFrame):
    """A function from (length, rank) to (sequence_id, offset). The plan is sent to the executors: its rows are
    bounded by the capacity."""
    rows = np.array(sorted(plan.rows), np.int64).reshape(-1, 6)
    sent = docs.sparkSession.sparkContext.broadcast(rows)

    def at(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        rows = sent.value
        lengths, ranks = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        out = np.zeros((len(lengths), 2), np.int64)
        order = np.lexsort((ranks, lengths))
        for size in np.unique(lengths):
            own = rows[rows[:, 0] == size]
            which = order[np.searchsorted(lengths[order], size) : np.searchsorted(lengths[order], size, "right")]
            row = own[np.searchsorted(own[:, 1], ranks[which], "right") - 1]
            nth = ranks[which] - row[:, 1]
            out[which, 0] = row[:, 3] + nth // row[:, 5]
            out[which, 1] = row[:, 4] + nth % row[:, 5] * size
        return pd.DataFrame({"sequence_id": out[:, 0], "offset": out[:, 1]})

    return F.pandas_udf(at, "sequence_id long, offset long")
