"""SimHash near duplicates: fingerprints, and their links by the general pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.llm.common import columns_of, free_name, row_function, stored, words_of
from tillbook.llm.components import components

BITS, WIDTH, DISTANCE, SEED = 64, 3, 3, 42
#: Fingerprints compared in one group at most, about: larger buckets are dealt to pairs of blocks of half as many.
GROUP = 4096
#: Cost of a comparison, where shuffling one key costs 1.
COMPARE_COST = 0.05


# --- Fingerprints ---------------------------------------------------------------------------


def simhash(text: str | None, width: int = WIDTH) -> int:
    """The fingerprint as a signed 64-bit number: a bit is set if it is in over half the XXH64 of the word shingles.

    Repeated shingles count each time. A text of fewer words is one shingle; without words it is 0.
    """
    words = words_of(text)
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    starts, at = [], 0
    for word in words:
        starts.append(at)
        at += len(word) + 1
    ends = [*starts[1:], at]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :])]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint_of(text: Column, width: int = WIDTH) -> Column:
    return row_function(T.LongType(), lambda: lambda value: simhash(value, width))(text)


# --- The design: which bits are probed together, and with which threshold ---------------------


@dataclass(frozen=True)
class BitStatistics:
    """Over all distinct fingerprints: how many, and how many have each pair of bits set."""

    count: int
    both: np.ndarray

    @property
    def share(self) -> np.ndarray:
        return np.diag(self.both) / max(self.count, 1)

    def correlation(self) -> np.ndarray:
        p = self.share
        spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
        return np.abs(self.both / max(self.count, 1) - np.outer(p, p)) / np.where(spread > 0, spread, np.inf)


def bit_statistics(fingerprints: DataFrame) -> BitStatistics:
    """From a table with the column ``fp``. Each task sums its own rows; the driver gets 64 x 64 sums and a count."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, rows = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            values = np.ascontiguousarray(batch["fp"].to_numpy("<i8"))
            for at in range(0, len(values), 1 << 16):
                part = values[at : at + (1 << 16)]
                bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += (bits.T @ bits).astype(np.int64)
                rows += len(part)
        yield pd.DataFrame({"place": np.arange(BITS * BITS + 1), "n": np.append(both.ravel(), rows)})

    sums = fingerprints.select("fp").mapInPandas(partial, "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for place, n in sums.collect():
        flat[place] = n
    return BitStatistics(int(flat[-1]), flat[:-1].reshape(BITS, BITS))


def group_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits to ``parts`` groups of near-equal size, each bit beside those it is most correlated with.

    A group starts with the free bit of the strongest tie and takes, one by one, the free bit closest to what it holds.
    """
    free, groups = set(range(len(correlation))), []
    for part in range(parts):
        size = len(free) // (parts - part)
        ties = {b: max((correlation[b, o] for o in free if o != b), default=0.0) for b in free}
        group = [min(free, key=lambda b: (-ties[b], b))]
        free.discard(group[0])
        while len(group) < size:
            taken = min(free, key=lambda b: (-correlation[b, group].sum(), b))
            group.append(taken)
            free.discard(taken)
        groups.append(group)
    return groups


def within_odds(statistics: BitStatistics, group: Sequence[int], most: int) -> np.ndarray:
    """Odds that two fingerprints of different texts differ in at most 0, 1, .. ``most`` bits of a group.

    A chain along the group: whether they differ in a bit depends on whether they differ in the one before,
    as the joint shares of the two bits have it.
    """
    n = max(statistics.count, 1)
    p = statistics.share
    agree = p**2 + (1 - p) ** 2
    state = np.zeros((2, most + 1))
    state[0, 0] = agree[group[0]]
    if most:
        state[1, 1] = 1 - agree[group[0]]
    for a, b in zip(group, group[1:]):
        p11 = statistics.both[a, b] / n
        cells = np.array([p11, p[a] - p11, p[b] - p11, 1 - p[a] - p[b] + p11])
        same_both = float((cells**2).sum())
        to_same = np.array([same_both, max(agree[b] - same_both, 0.0)])
        reach = np.array([agree[a], 1 - agree[a]])
        stay = np.divide(to_same, reach, out=np.full(2, agree[b]), where=reach > 0).clip(0, 1)
        moved = np.zeros_like(state)
        moved[0] = stay @ state
        moved[1, 1:] = ((1 - stay) @ state)[:-1]
        state = moved
    return np.cumsum(state.sum(axis=0))


def allocate(costs: Sequence[Sequence[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 (never probed) up, one for each group, whose sum plus the number of groups is ``total``.

    ``costs[g][t + 1]`` is the cost of group g at threshold t. Dynamic programming over the groups.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for extra in range(min(len(row) - 1, total - used) + 1):
                found = (cost + row[extra], [*chosen, extra - 1])
                if used + extra not in step or found < step[used + extra]:
                    step[used + extra] = found
        best = step
    return best[total]


def design(statistics: BitStatistics, distance: int = DISTANCE) -> list[int]:
    """The masks to probe with: fingerprints within ``distance`` bits agree under at least one of them.

    By the general pigeonhole principle two such fingerprints differ in at most t bits of some group, if the groups' t + 1
    sum to distance + 1. A group with threshold t gives a mask for each choice of t of its bits to leave out. For each number
    of groups the thresholds with the least estimated cost (keys to shuffle, pairs to compare) are found, and of
    all numbers of groups the cheapest is taken: many short groups for few fingerprints, few long ones for many.
    """
    best: tuple[float, list[int]] | None = None
    count = max(statistics.count, 1)
    pairs = count * (count - 1) / 2
    for parts in range(1, distance + 2):
        groups = group_bits(statistics.correlation(), parts)
        costs = [
            [0.0, *(count * comb(len(g), t) + COMPARE_COST * pairs * odds for t, odds in enumerate(within))]
            for g in groups
            for within in [within_odds(statistics, g, distance)]
        ]
        cost, thresholds = allocate(costs, distance + 1)
        masks = [
            sum(1 << b for b in group if b not in left_out)
            for group, threshold in zip(groups, thresholds)
            if threshold >= 0
            for left_out in combinations(group, threshold)
        ]
        if best is None or cost < best[0]:
            best = (cost, masks)
    return best[1]


# --- Probing ----------------------------------------------------------------------------------


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits. As unsigned numbers: numpy counts the bits of a negative number's absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked within a group: each value in turn takes in those not yet reached within the distance."""
    left, right = [], []
    waiting = values
    while len(waiting) > 1:
        queue, waiting = [waiting[0]], waiting[1:]
        while queue and len(waiting):
            node = queue.pop()
            near = differing(waiting, node) <= distance
            if near.any():
                found = waiting[near]
                left.append(np.full(len(found), node))
                right.append(found)
                queue.extend(found)
                waiting = waiting[~near]
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _compare(batch: pd.DataFrame, keys: list[str], distance: int) -> pd.DataFrame:
    """Links within each run of equal keys of a sorted batch."""
    table = batch[keys].to_numpy(np.int64)
    values = batch["fp"].to_numpy(np.int64)
    starts = np.flatnonzero(np.r_[True, (table[1:] != table[:-1]).any(axis=1)])
    sizes = np.diff(np.r_[starts, len(values)])
    left, right = [], []
    small = sizes <= 8
    group = np.repeat(np.where(small, np.arange(len(sizes)), -1), sizes)
    for shift in range(1, 8):
        near = np.flatnonzero((group[:-shift] == group[shift:]) & (group[:-shift] >= 0))
        near = near[differing(values[near], values[near + shift]) <= distance]
        left.append(values[near])
        right.append(values[near + shift])
    for start, size in zip(starts[~small], sizes[~small]):
        a, b = forest(values[start : start + size], distance)
        left.append(a)
        right.append(b)
    return pd.DataFrame({"u": np.concatenate(left), "v": np.concatenate(right)})


def links(fingerprints: DataFrame, masks: Sequence[int], distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """Links (u, v) between distinct fingerprints within ``distance`` bits: enough to connect all that are connected.

    Each fingerprint goes to one bucket for each mask, and only within buckets are fingerprints compared. The bits are
    counted for every pair of a bucket, but of a bucket only a forest of its links is returned, not all pairs. A bucket with over
    ``group`` fingerprints is cut into blocks of half as many, and each pair of blocks is a group of its own: every
    pair is still compared, and no task holds more than a few groups' worth of rows.
    """
    probes = F.explode(
        F.array(*[F.struct(F.lit(i).alias("probe"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bucket")) for i, m in enumerate(masks)])
    )
    keyed = fingerprints.select("fp", probes.alias("_p")).select("fp", "_p.*")
    large = stored(
        keyed.groupBy("probe", "bucket")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > group)
        .select("probe", "bucket", F.ceil(F.col("n") / (group // 2)).cast("int").alias("blocks")),
        "simhash-large-buckets",
    )
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    keys = ["probe", "bucket", "low", "high"]
    dealt = (
        keyed.join(large, ["probe", "bucket"], "left")
        .select("probe", "bucket", "fp", own.alias("own"), other.alias("other"))
        .select("probe", "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The last run of a batch may go on in the next one.
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = (batch[keys] != batch[keys].iloc[-1]).any(axis=1).to_numpy()
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if cut:
                yield _compare(batch.iloc[:cut], keys, distance)
            rest = batch.iloc[cut:]
        if rest is not None and len(rest):
            yield _compare(rest, keys, distance)

    return (
        dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(compare, "u long, v long").distinct()
    )


def near_duplicates(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """Each document's ``fingerprint`` (16 hex digits) and ``component_id``: the smallest doc_id among all documents that
    can be reached from it over links of at most ``distance`` bits, itself included.

    Equal fingerprints are one node, whatever their number. A null or empty text has fingerprint zero and links like
    any other. Null doc_ids take part but are never smallest; a component of nothing else has a null
    id. Repeated rows each get a row. Other columns than doc_id and text are not used.
    """
    found = stored(docs.select("doc_id", fingerprint_of(F.col("text"), width).alias("fp")), "simhash-fingerprints")
    joined = found.join(group_ids(found, distance), "fp")
    return joined.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("group_id").alias("component_id")
    )


def group_ids(found: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root, group_id) for the distinct fingerprints of ``found`` (doc_id, fp). ``root`` names the component, ``group_id`` is its
    smallest doc_id."""
    nodes = stored(found.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    roots = components(links(nodes, design(bit_statistics(nodes), distance), distance))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("group_id"))
    return placed.join(smallest, "root").select("fp", "root", "group_id")


def representatives(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """One document of each component: the row with its smallest doc_id (nulls last), of several such rows the one with the smallest
    text hash. All columns of ``docs`` stay as they are.

    Rows are known by two hashes of doc_id and text. Those of the rows to keep are found on short rows; whole texts are
    shuffled once, for the join that picks them.
    """
    n1, n2 = free_name(docs, "_k1"), free_name(docs, "_k2")
    k1, k2 = F.xxhash64("doc_id", "text"), F.xxhash64("text", "doc_id", F.lit(1))
    found = stored(
        docs.select("doc_id", fingerprint_of(F.col("text"), width).alias("fp"), k1.alias(n1), k2.alias(n2)),
        "simhash-fingerprints",
    )
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", n1, n2)
    first = found.groupBy("fp").agg(F.min(rank).alias("first"))
    kept = (
        group_ids(found, distance)
        .join(first, "fp")
        .groupBy("root")
        .agg(F.min("first").alias("first"))
        .select(f"first.{n1}", f"first.{n2}")
    )
    picked = docs.withColumns({n1: k1, n2: k2}).join(kept, [n1, n2]).dropDuplicates([n1, n2])
    return picked.select(columns_of(docs))
