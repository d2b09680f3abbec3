"""Quality rules: counts of words, symbols and repeats, and bands of compression ratios."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Sequence

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.llm.common import row_function

#: (least length in bytes, least ratio, largest ratio): a text's bytes over its zstandard bytes. Short texts carry the
#: frame's overhead, long ones have more to repeat.
BANDS = (
    (0, 0.0, 2.0),
    (100, 0.7, 2.4),
    (300, 1.1, 2.6),
    (1_000, 1.4, 2.9),
    (3_000, 1.6, 3.3),
    (10_000, 1.7, 3.8),
    (50_000, 1.7, 4.5),
)
LEVEL, CHUNK, MOST_BAD_CHUNKS = 3, 4096, 0.2
_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\r\x0b\x0c"

RESULT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField(n, T.DoubleType()) for n in ("ratio", "bad_chunks")]
    + [T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")]
)


def repeated_words(words: Sequence[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words which occurs at least twice, the first time included."""
    if len(words) <= width:
        return 0
    joined = b" ".join(words)
    starts, at = [], 0
    for word in words:
        starts.append(at)
        at += len(word) + 1
    starts.append(at)
    windows = [joined[a : b - 1] for a, b in zip(starts, starts[width:])]
    if len(set(windows)) == len(windows):
        return 0
    seen, covered, upto = Counter(windows), 0, 0
    for place, window in enumerate(windows):
        if seen[window] > 1:
            covered += place + width - max(place, upto)
            upto = place + width
    return covered


def duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    return len(lines) - len(set(lines))


def in_band(length: int, ratio: float, bands: Sequence[tuple[int, float, float]] = BANDS) -> bool:
    _, least, most = bands[bisect_right([b[0] for b in bands], length) - 1]
    return least <= ratio <= most


def verdict(text: str | None, compress, bands: Sequence[tuple[int, float, float]] = BANDS, chunk: int = CHUNK) -> dict:
    text = text or ""
    data = text.encode()
    words = data.split()
    n = len(words)
    repeats = repeated_words(words)
    ratio = len(data) / len(compress(data)) if data else 0.0
    chunks = [data[at : at + chunk] for at in range(0, len(data), chunk)]
    # A single chunk is the whole text. The last one, shorter than the others, has the band for its own length.
    ratios = [ratio] if len(chunks) == 1 else [len(c) / len(compress(c)) for c in chunks]
    bad = sum(len(c) for c, r in zip(chunks, ratios) if not in_band(len(c), r, bands))
    bad_chunks = bad / len(data) if data else 0.0
    failed = n < 10 or 100 * repeats > 20 * n
    return {
        "n_words": n,
        "word_chars": len(text) - sum(map(text.count, _SPACES)),
        "n_symbols": sum(map(text.count, _SYMBOLS)),
        "n_dup_lines": duplicate_lines(text),
        "n_repeat_words": repeats,
        "ratio": ratio,
        "bad_chunks": bad_chunks,
        "base_failed": failed,
        "kept": not failed and in_band(len(data), ratio, bands) and bad_chunks <= MOST_BAD_CHUNKS,
    }


def rules_of(text: Column, bands: Sequence[tuple[int, float, float]] = BANDS, chunk: int = CHUNK) -> Column:
    def prepare():
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        return lambda value: verdict(value, compress, bands, chunk)

    return row_function(RESULT, prepare)(text)


def quality_rules(docs: DataFrame, bands: Sequence[tuple[int, float, float]] = BANDS, chunk: int = CHUNK) -> DataFrame:
    """Each document's counts, compression ratio and verdict.

    ``base_failed``: under 10 words, or over a fifth of them in 5-word windows that repeat. ``kept``: not failed,
    the whole text's ratio lies in the band for its length (too high: repetitive; too low: incompressible), and at most
    a fifth of its bytes, ``bad_chunks``, lie in chunks of ``chunk`` bytes outside theirs (the last one may be shorter and
    has the band for its own length; a text of one chunk at most is that chunk). A null text counts as empty: no words, ratio 0, failed.
    Equal rows get equal verdicts; other columns than doc_id and text are not used.
    """
    return docs.select("doc_id", rules_of(F.col("text"), bands, chunk).alias("_rules")).select("doc_id", "_rules.*")
