import math
import re
import zlib

import numpy as np
import pytest

from tillbook.llm import toxicity as t


def made_up(n):
    """Every third text holds one of two bad words; a text's other words are its own."""
    rows = []
    for i in range(n):
        words = [f"w{(i * 7 + k * k) % 50}" for k in range(20)]
        if i % 3 == 0:
            words[i % 20] = ("Rotten", "vile")[i % 2]
        rows.append((i, " ".join(words)))
    return rows


def test_learns_and_holds_out(spark, docs):
    rows = made_up(600) + [(None, None), (None, ""), (10_000, "vile " * 30_000), (0, made_up(1)[0][1])]
    labels = spark.createDataFrame(
        [(i, int(i % 3 == 0)) for i in range(600)] + [(None, 1), (5, None), (0, 1), (0, 0)], "doc_id long, toxic int"
    )
    found = t.classify(docs(rows), labels).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(600))
    held = [by[i].predicted == (i % 3 == 0) for i in range(600) if by[i].held_out]
    assert sum(held) >= 0.97 * len(held)
    assert by[10_000].predicted == 1 and all(0 <= r.score <= 1 for r in found)
    none = [r for r in found if r.doc_id is None]
    assert len({r.score for r in none}) == 1 and not any(r.held_out or r.predicted for r in none)


def test_labels_of_the_held_out_fifth_change_nothing(spark, docs):
    d = docs(made_up(200))
    rows = [(i, int(i % 3 == 0)) for i in range(200)]
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in rows]
    a, b = (t.fit(d, spark.createDataFrame(r, "doc_id long, toxic int")) for r in (rows, flipped))
    assert a.bias == b.bias and (a.places == b.places).all() and (a.values == b.values).all()


def test_without_labels_nothing_is_toxic(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r.score, r.predicted) for r in t.classify(docs(made_up(5)), none).collect()} == {(0.0, 0)}
    assert t.classify(docs([]), none).count() == 0


def test_sample_is_bounded_and_has_each_document_once(spark, docs):
    labels = spark.createDataFrame([(i % 40, i % 2) for i in range(200)], "doc_id long, toxic int")
    sample = t.labelled_sample(docs(made_up(40) + made_up(40)), labels, 10).collect()
    assert len(sample) == len({r.doc_id for r in sample}) == 10


def test_rare_features_get_no_weight():
    rng = np.random.default_rng(0)
    examples = [(np.unique(np.r_[rng.integers(10, 1 << t.BITS, 30), [1, 2][i % 2]]), i % 2) for i in range(400)]
    w = t.ftrl(iter(examples))
    assert {1, 2} <= set(w.places.tolist()) and len(w.places) < 20


def test_features_are_words_pairs_and_skips():
    two = set(t.hashed_features("Alpha beta").tolist())
    assert len(two) == 3 and two == set(t.hashed_features("alpha, BETA!").tolist())
    assert len(t.hashed_features("a b c d")) == 4 + 3 + 2 + 1
    assert len(t.hashed_features(None)) == len(t.hashed_features("...")) == 0


def plain_places(text):
    """Words, pairs and skip-grams hashed one by one, in whole numbers."""
    first, factors, mask = 0x9E3779B97F4A7C15, (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93), 2**64 - 1
    h = [zlib.crc32(w) for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())]
    mixed = list(h)
    for gap in (1, 2, 3):
        mixed += [(a * first ^ (b + gap) * factors[gap - 1]) & mask for a, b in zip(h, h[gap:])]
    return {(x * first & mask) >> 44 for x in mixed}


def plain_ftrl(examples, l1=6.0):
    """FTRL-proximal with alpha and beta 1, a term at a time: (weights, bias)."""
    z, n = {}, {}

    def weight(i, penalty):
        s = z.get(i, 0.0)
        return 0.0 if abs(s) <= penalty else -(s - math.copysign(penalty, s)) / (1 + math.sqrt(n.get(i, 0.0)))

    for places, label in examples:
        terms = [(i, l1) for i in places] + [("bias", 0.0)]
        w = {i: weight(i, penalty) for i, penalty in terms}
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i, _ in terms:
            before = n.get(i, 0.0)
            n[i] = before + g * g
            z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) * w[i]
    learned = {i: weight(i, l1) for i in z if i != "bias"}
    return {i: w for i, w in learned.items() if w}, weight("bias", 0.0)


def test_weights_and_scores_equal_plain_ftrl(spark, docs):
    rows = made_up(300) + [(900, "Größe VILE; rotten-vile"), (901, ""), (902, None), (903, "vile " * 30_000)]
    labels = [(i, int(i % 3 == 0)) for i in range(300)]
    table, marks = docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    learned = t.fit(table, marks)

    text, label = dict(rows), dict(labels)
    kept = [(i,) for i in label if zlib.crc32(str(i).encode()) % 5]
    order = spark.createDataFrame(kept, "doc_id long").selectExpr("doc_id", "explode(sequence(1, 3)) as epoch")
    order = order.selectExpr("epoch", "xxhash64(doc_id, epoch) as h", "doc_id").collect()
    weights, bias = plain_ftrl((plain_places(text[i]), label[i]) for _, _, i in sorted(map(tuple, order)))
    assert weights and set(weights) == set(learned.places.tolist())
    assert learned.bias == pytest.approx(bias, rel=1e-9)
    assert dict(zip(learned.places.tolist(), learned.values.tolist())) == pytest.approx(weights, rel=1e-6)
    for r in t.classify(table, marks).collect():
        total = bias + sum(weights.get(i, 0.0) for i in plain_places(text[r.doc_id]))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-6) and r.predicted == (r.score >= 0.5)
