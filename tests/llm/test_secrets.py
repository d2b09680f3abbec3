import hashlib
import random
import re
from collections import Counter
from math import log2

from tillbook.llm import secrets as s

RANDOM = "aB3dE5fG7hJ9kL2mN4pQ6rS8tU1vW0xY"
TEXTS = [
    "token = '04dbebab91ab85687d33eeaaf9ac699e1188f962'",
    "PassWord:abc12 secret:  \"abcdef\" token: token: abcdefgh",
    "ſecret=abcdefgh api_key=abcdefgh APIKEY : zz.zz-zz",
    "AKIA" + "A1" * 8 + " AKIA123 xAKIA" + "Z" * 16 + "9",
    "0123abcd" * 3 + " " + "ab" * 11,
    f"x {RANDOM} y", f"https://example.com/{RANDOM}example", "\U0001f600 " + RANDOM, "a" * 5000, "", None,
]


def base_spans(text):
    """Written plainly: every pattern over the whole text, failing matches dropped."""
    out = []
    word = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in "password")
    assign = re.compile(
        "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
        + r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    )
    assert re.fullmatch(word, "pAssWord")
    for kind, pattern, keep in (
        ("assign", assign, lambda m: len(m[2]) >= 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if keep(m)]
    order = ["assign", "access", "hex"]
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(out, key=lambda x: (x[0], order.index(x[1]))))


def test_base_equals_plain_scan(docs, corpus):
    for table in (docs(list(enumerate(TEXTS)) + [(None, TEXTS[0]), (0, TEXTS[0])]), corpus):
        rows = table.select("doc_id", "text").join(s.digest(table), "doc_id").collect()
        for r in rows:
            want = base_spans(r.text or "")
            assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), r.text
            kinds = Counter(x.split(":")[0] for x in want.split(",") if x)
            assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
            assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def test_rows_and_nulls(docs):
    found = s.digest(docs([(None, None), (1, ""), (1, ""), (2, TEXTS[0])])).collect()
    assert len(found) == 4 and sum(r.spans == "" for r in found) == 3
    assert s.digest(docs([])).count() == 0


def test_entropy_span_and_allow_list():
    allow = [re.compile(p) for p in s.ALLOW]
    assert s.scan_text(TEXTS[5], allow) == [("entropy", 2, 2 + len(RANDOM))]
    assert s.scan_text(TEXTS[6], allow) == [] and s.scan_text(TEXTS[6]) != []
    assert s.scan_text("123e4567-e89b-12d3-a456-426614174abc", allow) == []
    assert s.scan_text("z" * 5000, allow) == s.scan_text("thisisonlyalongwordwithoutany", allow) == []


def test_incremental_counts_equal_counts_anew():
    random.seed(3)
    for _ in range(300):
        run = "".join(random.choice("abcdef01"[: random.randint(1, 8)]) for _ in range(random.randint(0, 40)))
        window, least = random.randint(1, 12), random.random() * 3
        covered = set()
        for a in range(len(run) - window + 1):
            part = run[a : a + window]
            h = -sum(n / window * log2(n / window) for n in Counter(part).values())
            if h >= least and any(map(str.isdigit, part)):
                covered |= set(range(a, a + window))
        got = {p for a, b in s.entropy_windows(run, window, least, (str.isdigit,)) for p in range(a, b)}
        assert got == covered


def test_redaction(docs):
    table = docs([(1, TEXTS[0]), (2, None), (3, "clean"), (4, f"{RANDOM} {RANDOM}")], "n_chars int")
    rows = {r.doc_id: r for r in s.redact(table).collect()}
    assert rows[1].text == "[secret]'" and rows[1].n_chars == len("[secret]'")
    assert rows[2].text is None and (rows[3].text, rows[3].n_chars) == ("clean", 7)
    assert rows[4].text == "[secret] [secret]" and s.redact(table).columns == table.columns


def test_a_placeholder_hides_its_own_part_alone(docs):
    allow = [re.compile(p) for p in s.ALLOW]
    key = RANDOM + "yZ9"
    for head, tail in (("sample_key=", ""), ("/example/", ""), ("", "/example"), ("x=0123456789/", "=xxxx"), ("dummy/" * 20, "")):
        assert s.scan_text(head + key + tail, allow) == [("entropy", len(head), len(head) + len(key))]
    random.seed(6)
    letters = [chr(c) for c in range(48, 123) if chr(c).isalnum()]
    blob = "".join(random.choice(letters) for _ in range(3000))
    text = f"{blob}xxxx{blob}"
    found = s.scan_text(text, allow)
    assert {k for k, _, _ in found} == {"entropy"} and sum(b - a for _, a, b in found) > 5500
    assert not any(a < 3004 and b > 3000 for _, a, b in found)
    assert s.scan_text(f"/a/{RANDOM}example/b", allow) == []
    (row,) = s.redact(docs([(1, f"sample_key={key}")])).collect()
    assert key not in row.text


def test_random_strings_of_every_class_are_found():
    random.seed(7)
    digits, lower = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    upper = lower.upper()
    for chars, length, least in (
        (lower + digits, 40, 0.97), (upper + "234567", 40, 0.97), (lower + upper, 40, 0.97), (lower, 64, 0.9), (upper, 64, 0.9),
        (lower + digits, 20, 0.8), (upper + "234567", 20, 0.8), (lower + upper, 20, 0.8), (lower + upper + digits, 20, 0.8),
    ):
        runs = ["".join(random.choice(chars) for _ in range(length)) for _ in range(200)]
        assert sum(bool(s.scan_text(f"a {run} b")) for run in runs) >= least * 200, (chars, length)
    for word in ("donaudampfschifffahrtsgesellschaft", "antidisestablishmentarianism", "INTERNATIONALIZATIONS", "path/to/some/longer/folder"):
        assert s.scan_text(word) == []


def test_windows_within_another_span_are_left_out():
    text = f"{RANDOM}= token={RANDOM}/{RANDOM} {RANDOM}"
    spans = s.scan_text(text)
    for k, a, b in spans:
        assert k != "entropy" or not any((a, b) != (c, d) and c <= a and b <= d for _, c, d in spans)
