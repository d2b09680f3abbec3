import random
import re

import zstandard

from tillbook.llm import quality as q

random.seed(5)
PROSE = " ".join("".join(random.choice("etaoinshrdlu") for _ in range(random.randint(2, 8))) for _ in range(900))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The base counts, written without regard to speed."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


TEXTS = [
    None, "", " \n\t", "one two", "a b c d e f g h i j", "a b c d e x a b c d e f g h i j k l m n o p q r s t u",
    "a a a a a a a a a a a a", "x\ny\nx\n\n \n \nx ", "é b\x1cc d\x85e " * 4, "#*$%&|<> " * 12, PROSE,
]


def test_base_equals_plain_counts(docs, corpus):
    table = docs(list(enumerate(TEXTS)))
    for source in (table, corpus.where("length(text) < 3000")):
        for r in source.select("doc_id", "text").join(q.quality_rules(source), "doc_id").collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(r.text)
            assert not (r.kept and r.base_failed)


def test_bands_reject_repetition_and_noise(docs):
    noise = "".join(random.choice([chr(c) for c in range(0x4E00, 0x9000)]) + " " * (i % 3 == 0) for i in range(3000))
    same = "\n".join(f"anotherlongrow {i} repeatedcolumn anothercolumn {i} sametableagain lastcolumn {i}" for i in range(2000))
    part = PROSE * 3 + " " + "z" * 4096 * 4
    verdicts = {r.doc_id: r for r in q.quality_rules(docs([(1, PROSE), (2, same), (3, noise), (4, part)])).collect()}
    assert verdicts[1].kept and not verdicts[2].kept
    assert not verdicts[2].base_failed and verdicts[2].ratio > 3.3
    assert verdicts[3].ratio < verdicts[1].ratio and verdicts[4].bad_chunks > 0.2


def test_rows_stay(docs):
    table = docs([(None, None), (1, PROSE), (1, PROSE)])
    found = q.quality_rules(table).collect()
    assert len(found) == 3 and [r.kept for r in found if r.doc_id == 1] == [True, True]
    assert [(r.n_words, r.kept, r.base_failed) for r in found if r.doc_id is None] == [(0, False, True)]
    assert q.quality_rules(docs([])).count() == 0


def test_limits_belong_to_lengths():
    assert q.in_band(50, 1.9) and not q.in_band(50, 2.1) and q.in_band(20_000, 3.7) and not q.in_band(20_000, 1.5)


def test_the_last_part_is_checked_and_chunks_weigh_by_bytes(docs):
    import base64

    noise = base64.b64encode(random.Random(8).randbytes(3000)).decode()
    prose = PROSE[:4096]
    texts = [(1, prose + noise[:3000]), (2, noise[:3000] + prose), (3, prose + PROSE[:1500]), (4, prose * 1 + noise[:600]), (5, noise[:3000])]
    found = {r.doc_id: r for r in q.quality_rules(docs(texts)).collect()}
    assert len(prose) == 4096 and not found[1].kept and found[1].bad_chunks == 3000 / 7096
    assert found[3].bad_chunks == 0 and found[4].bad_chunks < 0.2 and found[5].bad_chunks == 1
    # Noise in a short last part weighs no more than its bytes.
    mixed = "".join((prose, prose[::-1], noise[:2000]))
    assert q.verdict(mixed, q.zstandard.ZstdCompressor(level=q.LEVEL).compress)["bad_chunks"] == 2000 / len(mixed)


def plain_bands(text):
    """(ratio, bad_chunks, within limits) of a text, a chunk at a time."""
    data = (text or "").encode()

    def fits(part):
        ratio = len(part) / len(zstandard.compress(part, 3)) if part else 0.0
        limits = [(low, high) for least, low, high in q.BANDS if least <= len(part)][-1]
        return ratio, limits[0] <= ratio <= limits[1]

    bad, rest = 0, data
    while rest:
        part, rest = rest[:4096], rest[4096:]
        bad += 0 if fits(part)[1] else len(part)
    share = bad / len(data) if data else 0.0
    return fits(data)[0], share, fits(data)[1] and share <= 0.2


def test_bands_equal_plain_ones(docs, corpus):
    import base64

    noise = base64.b64encode(random.Random(3).randbytes(9000)).decode()
    made = [PROSE[:a] + noise[:b] + "z" * c for a in (0, 99, 4096, 5000) for b in (0, 1, 700, 4096, 9000) for c in (0, 5, 5000)]
    table = docs(list(enumerate(TEXTS + made + [PROSE * 400])))
    seen = set()
    for source in (table, corpus):
        for r in source.select("doc_id", "text").join(q.quality_rules(source), "doc_id").collect():
            ratio, share, within = plain_bands(r.text)
            assert (r.ratio, r.bad_chunks, r.kept) == (ratio, share, within and not r.base_failed)
            seen.add((within, share > 0, r.base_failed))
    assert len(seen) >= 5
