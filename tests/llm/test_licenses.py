import re

import pytest

from tillbook.llm import licenses as lic

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MIT = lic.TEMPLATES[4][1]


def plain(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = [
        (i, label)
        for phrase, label in lic.BASE.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    places = [i for i, _ in found]
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


ROWS = [
    (1, None), (2, ""), (3, "Released under the MIT License. cc-by-nc CC BY NC cc by nc"), (3, "other text, same id"),
    (None, "Apache License, Version 2.0"), (None, "Apache License, Version 2.0"), (5, "É license_under ünder the mit licensed"),
    (6, "x " * 20_000 + "under the MIT\x00License"),
]


def test_base_equals_plain_scan(docs, corpus):
    for table in (docs(ROWS), corpus):
        rows = sorted((str((r.doc_id, *plain(r.text))) for r in table.collect()))
        found = lic.digest(table).collect()
        assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in found) == rows
        for r in found:
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
            assert r.score == 1.0 if r.n_base else True


@pytest.mark.parametrize(
    "text, labels",
    [
        (f"a b {MIT} c", "mit"),
        (MIT.replace("free of charge", "at no charge").replace("without restriction", "with no restriction at all"), "mit"),
        (MIT[: len(MIT) // 2], ""),
        ("This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
        ("This work is licensed under the Creative Commons Attribution 4.0 International License", "cc-by"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
        (f"{MIT} and Licensed under the Apache License, Version 2.0", "apache-2,mit"),
        ("license mit the under", ""),
    ],
)
def test_own_labels(docs, text, labels):
    (row,) = lic.digest(docs([(1, text)])).collect()
    assert row.labels == labels and (row.score >= lic.LEAST_SCORE) == bool(labels)


def test_repeated_occurrences_are_apart():
    known = [lic.Template("t", 3)]
    assert [s[1:3] for s in lic.merge_diagonals([(0, 0, [0]), (0, 3, [0]), (0, 9, [0])], known)] == [(0, 3), (3, 6), (9, 12)]


def test_neighbouring_diagonals_are_one():
    known = [lic.Template("t", 12)]
    spans = lic.merge_diagonals([(0, 5, [0, 1, 2]), (0, 6, [6, 7, 8, 9])], known)
    assert [(s[1], s[2]) for s in spans] == [(5, 18)] and spans[0][3] == 11 / 13


def test_empty_table(docs):
    assert lic.digest(docs([])).count() == 0


def test_many_words_put_in_or_left_out_at_one_place(docs):
    words = MIT.split()
    middle = len(words) // 2
    into = lambda extra: " ".join([*words[:middle], *extra, *words[middle:]])
    header = [f"page{i}" for i in range(8)]
    texts = [into(header), into(header[:4]), " ".join(words[:middle] + words[middle + 6 :]), into(header * 3)]
    # Twice in a row, and with a stray match of three words shortly after.
    texts += [f"{into(header)} {into(header)}", MIT + " x" * 9 + " " + " ".join(words[-30:-26])]
    found = {r.doc_id: r for r in lic.find_licenses(docs(list(enumerate(texts)))).collect()}
    assert [[s.label for s in found[i].spans] for i in range(6)] == [["mit"], ["mit"], ["mit"], [], ["mit", "mit"], ["mit"]]
    assert (found[0].spans[0].start, found[0].spans[0].end) == (0, len(lic.license_words(texts[0])))
    assert found[5].spans[0].score == 1.0


@pytest.mark.parametrize("label, text", lic.TEMPLATES)
def test_every_template_has_its_own_label(label, text):
    known = [lic.Template(own, len(lic.license_words(t))) for own, t in lic.TEMPLATES]
    hits = {}
    words = lic.license_words(f"a b {text} c d")
    for place, gram in enumerate(lic.rolling_hashes(words).tolist()):
        for number, (_, other) in enumerate(lic.TEMPLATES):
            for position, of_other in enumerate(lic.rolling_hashes(lic.license_words(other)).tolist()):
                if gram == of_other:
                    hits.setdefault((number, place - position), []).append(position)
    spans = lic.merge_diagonals([(n, d, p) for (n, d), p in hits.items()], known)
    assert [s for s in spans if s[0] == label and (s[1], s[2]) == (2, len(words) - 2) and s[3] == 1.0]


def test_a_long_text_of_one_notice_takes_linear_time(docs):
    import time

    times = 80_000
    start = time.monotonic()
    (row,) = lic.digest(docs([(1, "released under the mit license by us " * times)])).collect()
    assert (row.n_base, row.first_word, row.last_word, row.labels) == (times, 1, 7 * (times - 1) + 1, "mit")
    assert time.monotonic() - start < 60
