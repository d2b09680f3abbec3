"""Secret scans: assignment, access-key and hex patterns, and sliding-window entropy per character class."""

from __future__ import annotations

import re
from collections.abc import Sequence
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.llm.common import columns_of, free_name, row_function

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
#: One of these is in every text in which _ASSIGN matches.
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
#: Every hex or access match long enough to count lies within a candidate.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Character class: (its runs, window length, least bits per character, what a window must hold). The windows of 20 are as
#: long as the shortest candidate. Of 20 random characters of their class 1 to 10 % have fewer bits than asked for, of a single
#: case's letters half: the words of a language come close to those, so only the more mixed windows of a run count.
CLASSES = {
    "hex": (re.compile(r"[0-9A-Fa-f]+"), 24, 3.0, (str.isdigit, str.isalpha)),
    "base64": (re.compile(r"[A-Za-z0-9+/_=-]+"), 24, 4.0, (str.isdigit, str.isupper, str.islower)),
    "hex, short": (re.compile(r"[0-9A-Fa-f]+"), 20, 3.0, (str.isdigit, str.isalpha)),
    "base64, short": (re.compile(r"[A-Za-z0-9+/_=-]+"), 20, 3.8, (str.isdigit, str.isupper, str.islower)),
    "lower and digits": (re.compile(r"[a-z0-9]+"), 20, 3.6, (str.isdigit, str.islower)),
    "upper and digits": (re.compile(r"[A-Z0-9]+"), 20, 3.5, (str.isdigit, str.isupper)),
    "letters": (re.compile(r"[A-Za-z]+"), 20, 3.75, (str.isupper, str.islower)),
    "lower": (re.compile(r"[a-z]+"), 20, 3.7, ()),
    "upper": (re.compile(r"[A-Z]+"), 20, 3.7, ()),
}

#: What looks random but is no secret: placeholders, alphabets, UUIDs. A match stands for the part between separators it lies in.
ALLOW = (
    r"(?i)example|sample|placeholder|changeme|dummy|xxxx|0{8}",
    r"(?i)abcdefghij|0123456789|qwertyuiop",
    r"(?i)(?<![0-9a-f])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-f])",
)

#: Separators of paths and assignments, and the longest part between them that a placeholder makes one as a whole.
_SEPARATORS, PLACEHOLDER_CHARS = "/=", 64

SPAN = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
)


def entropy_windows(run: str, window: int, least: float, needs: Sequence = ()) -> list[tuple[int, int]]:
    """Merged spans of the windows of ``run`` with at least ``least`` bits per character and a character of each need.

    The counts change by one character in and one out as the window moves, and with them the sum of n log2 n.
    """
    if len(run) < window:
        return []
    term = [0.0] + [n * log2(n) for n in range(1, window + 2)]
    counts: dict[str, int] = {}
    total, found = 0.0, []
    held = [0] * len(needs)
    for place, char in enumerate(run):
        n = counts.get(char, 0)
        total += term[n + 1] - term[n]
        counts[char] = n + 1
        for k, need in enumerate(needs):
            held[k] += need(char)
        start = place - window + 1
        if start > 0:
            gone = run[start - 1]
            n = counts[gone]
            total += term[n - 1] - term[n]
            counts[gone] = n - 1
            for k, need in enumerate(needs):
                held[k] -= need(gone)
        if start >= 0 and all(held) and log2(window) - total / window >= least:
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], place + 1)
            else:
                found.append((start, place + 1))
    return found


def allowed_zones(run: str, allow: Sequence[re.Pattern]) -> list[tuple[int, int]]:
    """Merged spans of ``run`` that matches of ``allow`` stand for: the part between separators, or the match alone if that part
    is longer than a placeholder, such as a blob."""
    found = []
    for start, end in sorted(m.span() for pattern in allow for m in pattern.finditer(run)):
        low = max(run.rfind(c, max(0, start - PLACEHOLDER_CHARS), start) for c in _SEPARATORS) + 1
        ends = [at for c in _SEPARATORS if (at := run.find(c, end, end + PLACEHOLDER_CHARS)) >= 0]
        low = low or (0 if start <= PLACEHOLDER_CHARS else start - PLACEHOLDER_CHARS - 1)
        high = min(ends, default=min(len(run), end + PLACEHOLDER_CHARS + 1))
        if high - low <= PLACEHOLDER_CHARS:
            # With the separators beside it, so that no span takes them in.
            start, end = max(low - 1, 0), min(high + 1, len(run))
        if found and start <= found[-1][1]:
            found[-1] = (min(start, found[-1][0]), max(end, found[-1][1]))
        else:
            found.append((start, end))
    return found


def scan_text(text: str, allow: Sequence[re.Pattern] = ()) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text in code points, by start and then kind."""
    spans = []
    lower = text.lower()
    if any(hint in lower for hint in _ASSIGN_HINTS):
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    # Neither kind can start outside a run of the candidates' characters, so each run is searched alone.
    candidates = list(_CANDIDATE.finditer(text))
    for run in candidates:
        for kind, pattern, least in (("access", _ACCESS, 20), ("hex", _HEX, 24)):
            spans += [(kind, *m.span()) for m in pattern.finditer(text, *run.span()) if len(m[0]) >= least]
    taken = sorted((start, end) for _, start, end in spans)
    for run in candidates:
        zones = allowed_zones(run[0], allow)
        # What lies between the zones: a window in none of these overlaps a zone.
        between = zip([0, *(end for _, end in zones)], [*(start for start, _ in zones), len(run[0])])
        windows = {
            (run.start() + part.start() + start, run.start() + part.start() + end)
            for a, b in between
            for chars, width, least, needs in CLASSES.values()
            for part in chars.finditer(run[0], a, b)
            for start, end in entropy_windows(part[0], width, least, needs)
        }
        # In this order a window lies within an earlier span if it ends before the farthest of those ends.
        kept, reach, at = [], 0, 0
        for start, end in sorted(windows, key=lambda w: (w[0], -w[1])):
            while at < len(taken) and taken[at][0] <= start:
                reach = max(reach, taken[at][1])
                at += 1
            if end > reach:
                kept.append((start, end))
                reach = end
        spans += [("entropy", *span) for span in kept]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def spans_of(text: Column, allow: Sequence[str] = ALLOW) -> Column:
    """An array of (kind, start, end) for a column of texts."""

    def prepare():
        patterns = [re.compile(p) for p in allow]

        def of(value: str | None) -> list[dict]:
            return [{"kind": k, "start": a, "end": b} for k, a, b in scan_text(value or "", patterns)]

        return of

    return row_function(T.ArrayType(SPAN), prepare)(text)


def find_secrets(docs: DataFrame, allow: Sequence[str] = ALLOW) -> DataFrame:
    """``docs`` with ``secret_spans``: the secrets of each text, by start and then kind.

    Three kinds are patterns: ``assign``, ``access``, ``hex``. ``entropy`` adds the windows of long candidate strings whose
    characters, within one class, are as mixed as random ones, unless the window overlaps what ``allow`` stands for or
    another span holds the window. A null or empty text has none; equal rows get equal spans. Other
    columns stay; one named ``secret_spans`` is replaced.
    """
    return docs.withColumn("secret_spans", spans_of(F.col("text"), allow))


def redact(docs: DataFrame, mask: str = "[secret]", allow: Sequence[str] = ALLOW) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask``; there ``n_chars``, if there is one, is counted anew.

    Overlapping spans become one mask. Rows without secrets, with empty or null texts stay as they are.
    """

    def prepare():
        patterns = [re.compile(p) for p in allow]

        def of(value: str | None) -> str | None:
            out, at = [], 0
            for _, start, end in scan_text(value or "", patterns):
                if end <= at:
                    continue
                if start >= at:
                    out += [value[at:start], mask]
                at = end
            return "".join([*out, value[at:]]) if out else value

        return of

    new = free_name(docs, "_masked")
    out = docs.withColumn(new, row_function(T.StringType(), prepare)(F.col("text")))
    changed = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        same = F.col(new).eqNullSafe(F.col("text"))
        changed["n_chars"] = F.when(same, F.col("n_chars")).otherwise(F.char_length(new).cast(kind))
    return out.withColumns(changed).select(columns_of(docs))


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """One row per document with counts, a hash of the pattern spans, and all spans as text."""
    found = find_secrets(docs.select("doc_id", "text"))
    spans = F.col("secret_spans")

    def of_kind(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        of_kind("assign").alias("n_assign"),
        of_kind("access").alias("n_access"),
        of_kind("hex").alias("n_hex"),
        F.sha2(listed(F.filter(spans, lambda s: s["kind"] != "entropy")), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
        of_kind("entropy").alias("n_entropy"),
    )
