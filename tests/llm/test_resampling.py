import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from tillbook.llm import resampling as r

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_force(rows, items):
    def count(texts):
        return Counter(zlib.crc32(f.encode()) % 10_000 for t in texts for f in features(t)[1])

    s, t = count(x for _, x in rows), count(items)
    s_all, t_all = sum(s.values()), sum(t.values())
    out, fit = [], []
    for doc_id, text in rows:
        words, own = features(text)
        weight = sum(
            math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in (zlib.crc32(f.encode()) % 10_000 for f in own)
        )
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(own), weight, score, None])
        if len(words) >= 20:
            fit.append(out[-1])
    fit.sort(key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    for place, row in enumerate(fit[: 5 * len(fit) // 100]):
        row[4] = place + 1
    return sorted(map(tuple, out), key=str)


def found(docs, items):
    return sorted(map(tuple, r.resample(docs, items).collect()), key=str)


def test_equals_brute_force(spark, docs, corpus, benchmark_items):
    rows = [(x.doc_id, x.text) for x in corpus.collect()]
    rows += [(None, None), (9001, ""), (9002, "One"), (9003, "Two, WORDS"), (9004, "é\x85É a1 b 中文 " * 30), (9004, "é a " * 30), (None, "x y z " * 40), (7, "Hot " * 200_000)]
    rows += [(9005, "same words again " * 9)] * 40
    want = brute_force(rows, [x.text for x in benchmark_items.collect()])
    assert found(docs(rows, "_drawn int"), benchmark_items) == want
    assert sum(x[4] is not None for x in want) >= 10


def test_no_rows_and_no_benchmark(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert found(docs([]), none) == []
    rows = [(i, f"word{i} " * 25) for i in range(40)]
    assert found(docs(rows), none) == brute_force(rows, [])


def test_every_byte_of_the_table():
    for b in range(0x80):
        assert [w.decode() for w in r.words_of(f"x{chr(b)}y")] == features(f"x{chr(b)}y")[0]


def test_chained_crcs_are_those_of_the_joined_words():
    words = [b"a", b"bc", "é".encode(), b"9"]
    want = [zlib.crc32(b" ".join(words[i : i + n])) % 97 for n in (1, 2, 3, 4) for i in range(5 - n)]
    assert np.array_equal(r.bucket_of_features(words, 4, 97), want)
