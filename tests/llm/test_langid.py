import math

import numpy as np
import pytest

from tillbook.llm import langid as li

EN = "the quick brown fox jumps over the lazy dog and then there is the other thing with that which we think "
DE = "der schnelle braune fuchs springt über den faulen hund und dann gibt es noch das andere ding mit dem wir "


@pytest.fixture(scope="module")
def learned(spark):
    rows = [(i, (EN, DE)[i % 2] * 3, ("en", "de")[i % 2]) for i in range(40)] + [(None, EN, "xx"), (99, None, "en"), (98, EN, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, lang string")


ROWS = [
    *[(i, f"https://h{i % 3}.site.de/{i}", f"<html lang='de'><p>{DE}</p>") for i in range(12)],
    *[(100 + i, f"http://user:pw@H{i % 3}.Other.com:80/{i}", f"<html lang=en-GB><p>{EN}</p>") for i in range(12)],
    (200, "https://h1.site.de/none", "<html><p>12 34</p>"), (201, None, "<html lang='en'></html>"), (202, None, None),
    (202, None, None), (None, "relative/path", EN), (204, "http://10.0.0.1/", f"<script>{EN * 5}</script><p>{DE}"),
    (205, "https://new.site.de/", ""),
]


def brute_force(rows, model):
    """The fusion written over all pages, page by page."""
    size = len(model.languages)
    seen = []
    for page_id, url, page in rows:
        logs = np.array(li.text_evidence(page, model.logs))
        q = np.round(np.exp(logs) / np.exp(logs).sum() * li.UNIT).astype(int)
        host = None
        if url and "://" in url:
            host = url.lower().split("://")[1].split("/")[0].split("@")[-1].split(":")[0]
        parts = host.split(".") if host else []
        suffix = parts[-1] if len(parts) > 1 and not parts[-1].isdigit() else None
        seen.append((page_id, host, ".".join(parts[-2:]), suffix, li.declared_language(page), logs, q))

    def others(k, test):
        return sum((s[6] for n, s in enumerate(seen) if n != k and test(s)), np.zeros(size)) / li.UNIT

    for k, (page_id, host, domain, suffix, declared, logs, _) in enumerate(seen):
        everything = others(k, lambda s: True)
        prior = (everything + 1) / (everything.sum() + size)
        if host:
            for test in (lambda s: s[1] and s[2] == domain, lambda s: s[1] == host):
                n = others(k, test)
                prior = (n + li.SMOOTHING * prior) / (n.sum() + li.SMOOTHING)
        total = logs + np.log(prior)
        for value, place in ((suffix, 3), (declared, 4)):
            if value:
                kinds = len({s[place] for s in seen if s[place]})
                n = others(k, lambda s: s[place] == value)  # noqa: B023
                total += np.log((n + li.CELL) / (everything + li.CELL * kinds))
        p = np.exp(total - total.max())
        yield page_id, p / p.sum()


def test_equals_brute_force(spark, learned):
    model = li.fit(learned)
    assert model.languages == ["de", "en"]
    found = li.identify(pages_of(spark, ROWS), learned).collect()
    want = list(brute_force(ROWS, model))
    key = lambda x: (x[0] is None, x[0] or 0)
    assert len(found) == len(ROWS)
    for row, (page_id, p) in zip(sorted(found, key=key), sorted(want, key=key)):
        assert row.page_id == page_id and row.lang == model.languages[int(p.argmax())]
        assert math.isclose(row.posterior, p.max(), rel_tol=1e-6)


def test_each_kind_of_evidence_decides_where_others_are_silent(spark, learned):
    by = {r.page_id: r for r in li.identify(pages_of(spark, ROWS), learned).collect()}
    assert by[200].text_lang is None and by[200].lang == "de"  # host
    assert by[205].lang == "de"  # domain and suffix
    assert by[201].lang == "en" and by[201].declared == "en"  # declaration
    assert by[204].lang == by[204].text_lang == "de" and by[100].host == "h0.other.com"


def test_without_labels_and_without_pages(spark, learned):
    pages = pages_of(spark, ROWS)
    none = li.identify(pages, learned.limit(0)).collect()
    assert len(none) == len(ROWS) and all(r.lang is None and r.posterior is None for r in none)
    assert li.identify(pages.limit(0), learned).count() == 0


def test_markup():
    assert li.declared_language('<META http-equiv="Content-Language" content="FR-ca">') == "fr"
    assert li.declared_language("<html lang=english>") is None and li.declared_language(None) is None
    assert li.visible_text("<p>a&amp;b<!-- c --><style>d</style>").split() == ["a&b"]


def test_sample_of_a_language_is_bounded(spark, learned):
    few, all_ = li.fit(learned, 2), li.fit(learned)
    assert few.languages == all_.languages and not np.array_equal(few.logs, all_.logs) or few.logs.shape == all_.logs.shape


def test_markup_equals_plain_patterns():
    import random
    import re

    hidden = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>|<[^>]*>", re.IGNORECASE | re.DOTALL)
    declared = re.compile(
        r"<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})(?![a-z])"
        r"|<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?([a-z]{2,3})(?![a-z])",
        re.IGNORECASE,
    )
    bits = ["<", ">", "<!--", "-->", "<script", "</SCRIPT >", "<style>", "</style", "<html", "<Meta", " lang=", "'de", "en ", "fra",
            "content-language", " content = ", " ", "x", "<scripts", "</template>", "<template ", "\n", "-", "<html lang=xyzz"]
    draw = random.Random(3)
    for _ in range(20_000):
        page = "".join(draw.choices(bits, k=draw.randint(0, 14)))
        assert li.visible_text(page) == hidden.sub(" ", page), page
        found = declared.search(page)
        assert li.declared_language(page) == (found and (found[1] or found[2]).lower()), page


def test_pages_of_unclosed_tags_take_linear_time():
    import time

    for piece in ("<script ", "<html ", "<meta content-language ", "<!-- ", "<", "<style></style ", "<html lang= "):
        start = time.monotonic()
        page = piece * (1_000_000 // len(piece))
        assert li.visible_text(page) and li.declared_language(page) is None
        assert time.monotonic() - start < 4, piece
