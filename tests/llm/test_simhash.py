import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tillbook.llm import simhash as s
from tillbook.llm.components import components


def plain(text):
    """The fingerprint bit by bit."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lower.translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, distance=3):
    """(doc_id, fingerprint) rows to component ids, over all pairs."""
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= distance:
            parent[root(a)] = root(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return {(i, f): least.get(root(f)) for i, f in rows}


def test_fingerprints_equal_plain_ones(docs, corpus):
    odd = [(None, None), (1, ""), (2, " \n"), (3, "One"), (4, "one TWO"), (4, "one TWO"), (5, "É é\x1cx a b c"), (6, "a b c " * 500)]
    table = docs(odd).select("doc_id", "text").union(corpus.select("doc_id", "text"))
    found = s.near_duplicates(table).collect()
    rows = [(r.doc_id, plain(r.text)) for r in table.collect()]
    want = brute_components(rows)
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in found), key=str) == sorted(
        ((i is None, i or 0, f"{f:016x}", want[i, f]) for i, f in rows), key=str
    )


def table_of(spark, values):
    return spark.createDataFrame([(int(np.array(v, np.uint64).astype(np.int64)),) for v in values], "fp long")


@pytest.mark.parametrize("group", [s.GROUP, 6])
def test_links_connect_what_is_near(spark, group):
    """A dense ball around a few centres, and far ones: both in one group and in split buckets."""
    random.seed(6)
    values = set()
    for _ in range(6):
        centre = random.getrandbits(64)
        for _ in range(40):
            values.add(centre ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 4))))
    values |= {random.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    table = table_of(spark, values)
    masks = s.design(s.bit_statistics(table)) if group == s.GROUP else halves()
    groups = {}
    for r in components(s.links(table, masks, group=group)).collect():
        groups.setdefault(r.root % 2**64, set()).add(r.node % 2**64)
    want = {}
    for (_, f), least in brute_components([(f, f) for f in values]).items():
        want.setdefault(least, set()).add(f)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want.values() if len(g) > 1}


def halves():
    """Two groups of 32 bits with threshold 1 each."""
    return [sum(1 << b for b in range(at, at + 32) if b != out) for at in (0, 32) for out in range(at, at + 32)]


def test_every_near_pair_agrees_under_a_mask():
    random.seed(7)
    for n in (10**3, 10**8, 10**9):
        statistics = s.BitStatistics(n, np.full((64, 64), n // 4) + np.eye(64, dtype=np.int64) * (n // 4))
        masks = s.design(statistics)
        for _ in range(500):
            a = random.getrandbits(64)
            b = a ^ sum(1 << x for x in random.sample(range(64), random.randint(0, 3)))
            assert any((a ^ b) & m == 0 for m in masks)
    assert len(s.design(s.BitStatistics(10**3, statistics.both // 10**6))) < len(masks)


def test_thresholds_are_the_cheapest():
    random.seed(8)
    for _ in range(50):
        costs = [[0.0, *sorted(random.random() * 9 for _ in range(4))] for _ in range(random.randint(1, 4))]
        cost, chosen = s.allocate(costs, 4)
        every = [
            (sum(row[t + 1] for row, t in zip(costs, ts)), ts)
            for ts in np.ndindex(*[5] * len(costs))
            for ts in [[t - 1 for t in ts]]
            if sum(t + 1 for t in ts) == 4
        ]
        assert cost == pytest.approx(min(every)[0]) and sum(t + 1 for t in chosen) == 4


def test_correlated_bits_share_a_group():
    corr = np.zeros((64, 64))
    for a, b in ((0, 63), (5, 40), (7, 8)):
        corr[a, b] = corr[b, a] = 0.9
    for parts in (2, 3, 4):
        where = {b: n for n, g in enumerate(s.group_bits(corr, parts)) for b in g}
        assert len(where) == 64 and where[0] == where[63] and where[5] == where[40] and where[7] == where[8]


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (2, 1)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}}


def test_marks_of_very_many_edges_do_not_overflow(spark):
    from tillbook.llm.components import _mark

    edges = spark.range(20_000_000).selectExpr("id + 1 as u", "id as v")
    mark = _mark(edges)
    assert mark[0] == 20_000_000 and mark == _mark(edges.repartition(7)) != _mark(edges.where("u <> 5"))
    assert _mark(edges.where("u = 1").selectExpr("v as u", "u as v"))[1:] != _mark(edges.where("u = 1"))[1:]


def test_one_of_each_group_stays(docs):
    words = [f"word{i}" for i in range(300)]
    base, other = " ".join(words), " ".join(words[::-1])
    rows = [(9, base), (3, base), (3, base), (None, base), (5, other), (None, "alone"), (7, None), (8, ""), (5, "same id elsewhere x y z")]
    table = docs(rows, "_k1 int")
    kept = s.representatives(table)
    assert kept.columns == table.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(3, base), (5, other), (None, "alone"), (7, None), (5, "same id elsewhere x y z")], key=str
    )
    assert s.representatives(docs([])).count() == 0 and s.near_duplicates(docs([])).count() == 0
