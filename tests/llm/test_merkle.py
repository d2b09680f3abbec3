import hashlib
import random
import zlib

import pytest

from tillbook.llm import merkle as m

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos int, tree string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*fields):
    values = [None if f is None else str(f) for f in fields]
    return h(*["-" if v is None else f"{len(v.encode())}:{v}" for v in values])


def fold(nodes, at, digest):
    """(root of the tree over nodes, siblings of ``at``, root if it were ``digest``), run by run."""
    beside = []
    while len(nodes) > 1:
        run = at - at % 2
        others = [nodes[k] for k in range(run, min(run + 2, len(nodes))) if k != at]
        beside += others
        digest = h(*[digest if k == at else nodes[k] for k in range(run, min(run + 2, len(nodes)))])
        nodes = [h(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        at //= 2
    return nodes[0], beside, digest


def brute_force(rows):
    """Rows (doc_id, source, lang, n_chars, text) to the manifest's rows, each leaf folded on its own."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is None, r[0] or 0, leaf_of(*r))) for x in langs}
    subroots = [fold([leaf_of(*r) for r in trees[x]], 0, "")[0] for x in langs]
    out = []
    for place, lang in enumerate(langs):
        leaves = [leaf_of(*r) for r in trees[lang]]
        for at, (doc_id, source, _, n, text) in enumerate(trees[lang]):
            hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n is not None
            changed = leaf_of(doc_id, source, lang, n + 1, text) if hit else leaves[at]
            subroot, low, again = fold(leaves, at, changed)
            root, high, again = fold(subroots, place, again)
            out.append((doc_id, leaves[at], subroot, root, h(*low, *high), again, again == root))
    return sorted(out, key=str)


def found(table, levels):
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, m.manifest(table, levels).select(columns).collect()), key=str)


def table_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


@pytest.mark.parametrize("levels", [1, 3, m.LEVELS])
def test_equals_brute_force(spark, levels):
    rng = random.Random(levels)
    rows = [(i, rng.choice(["a", "b:", None]), rng.choice(["en", "de", "zü", "", None]), rng.choice([None, i]), rng.choice(["é", "", None, f"t {i}"])) for i in rng.sample(range(900), 150)]
    rows += [(None, None, None, None, None)] * 3 + [(77, "s", "en", 4, "same")] * 2 + [(None, "s", "one", 7, "lone"), (5, "s", "two", 7, "x" * 300_000)]
    got = found(table_of(spark, rows), levels)
    assert got == brute_force(rows)
    assert {r[6] for r in got} == {True, False}


def test_trees_of_every_shape(spark):
    rows = [(1000 * n + i, "s", f"lang{n}", i, f"text {i}") for n in (1, 2, 3, 7, 8, 9, 33) for i in range(n)]
    assert found(table_of(spark, rows), 2) == brute_force(rows)


def test_whole_corpus(corpus):
    rows = [tuple(r) for r in corpus.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = found(corpus, 4)
    assert got == brute_force(rows)
    assert sum(not r[6] for r in got) == sum(zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None for r in rows) > 0


def test_no_rows(spark):
    assert m.manifest(table_of(spark, [])).count() == 0


def test_a_version_copies_only_its_path():
    rng = random.Random(1)
    for n in (1, 2, 5, 16, 23):
        nodes = [h(str(i)) for i in range(n)]
        built = m.levels_of(nodes, None)
        at = rng.randrange(n)
        path = m.copied_path(built, at, h("changed"))
        again = m.levels_of([h("changed") if k == at else x for k, x in enumerate(nodes)], None)
        assert path == [level[at >> k] for k, level in enumerate(again)]
        for k, (old, new) in enumerate(zip(built, again)):
            assert [x for i, x in enumerate(old) if i != at >> k] == [x for i, x in enumerate(new) if i != at >> k]


def test_rows_that_are_not_altered_are_folded_too(spark, monkeypatch):
    rows = [(i, "s", f"lang{i % 2}", i, f"text {i}") for i in range(40) if zlib.crc32(str(i).encode()) % 7]
    assert all(r[6] for r in found(table_of(spark, rows), 2))
    # With another fold no root is met: what is returned was computed from each leaf and its siblings.
    monkeypatch.setattr(m, "folded", lambda digest, path, place: m.F.sha2(m.F.col(digest), 256))
    got = found(table_of(spark, rows), 2)
    assert len(got) == len(rows) and not any(r[6] or r[5] == r[3] for r in got)
