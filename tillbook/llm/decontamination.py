"""Benchmark decontamination: edit matching by pigeonhole pieces, verified with Myers' bit-parallel distance."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.llm.common import row_function, words_of

#: Edits allowed, as a share of an item's characters.
ERROR_RATE = 0.08
#: Shorter items would be found by chance with edits or within words: they are sought as they are, between word borders.
LEAST_CHARS = 20
#: Benchmark characters that are sought in one pass over the documents.
BLOCK_CHARS = 1_000_000

HIT = T.StructType(
    [T.StructField("item", T.IntegerType())] + [T.StructField(n, T.LongType()) for n in ("distance", "start", "end")]
)


def normalized(text: str | None) -> str:
    """A-Z in lower case, white space as single spaces."""
    return b" ".join(words_of(text)).decode()


@dataclass(frozen=True)
class Item:
    """What is sought; ``bounded`` if only between word borders."""

    text: str
    budget: int
    bounded: bool = False

    def pieces(self) -> Iterator[tuple[int, str]]:
        """(start, piece): one piece more than the budget has edits, so that one at least is left whole."""
        parts = self.budget + 1
        for k in range(parts):
            start, end = len(self.text) * k // parts, len(self.text) * (k + 1) // parts
            yield start, self.text[start:end]


def item_of(text: str | None, rate: float = ERROR_RATE, least: int = LEAST_CHARS) -> Item | None:
    text = normalized(text)
    if len(text) < least:
        return Item(text, 0, True) if text else None
    return Item(text, int(len(text) * rate))


#: Scripts that put no spaces between words, or endings right after them: Thai to Myanmar, Khmer, Hangul, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u1100-\u11ff\u3040-\u30ff\u3130-\u318f\u31f0-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")


def at_borders(text: str, start: int, end: int) -> bool:
    """Whether no word goes on across either end."""

    def within_word(before: str, after: str) -> bool:
        both = all(c.isalnum() or unicodedata.category(c)[0] == "M" for c in (before, after))
        return both and not _UNSPACED.match(before) and not _UNSPACED.match(after)

    return not (start > 0 and within_word(text[start - 1], text[start])) and not (
        end < len(text) and within_word(text[end - 1], text[end])
    )


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to any substring of the text, where the first such substring ends).

    One column of the distance table is two bit vectors of the pattern's length (where it rises, where it falls), and each character
    of the text moves on all rows at once.
    """
    m = len(pattern)
    if not m:
        return 0, 0
    every, top = (1 << m) - 1, 1 << (m - 1)
    match: dict[str, int] = {}
    for place, char in enumerate(pattern):
        match[char] = match.get(char, 0) | 1 << place
    rise, fall, distance = every, 0, m
    best, at = m, 0
    for place, char in enumerate(text, 1):
        eq = match.get(char, 0)
        diagonal = (((eq & rise) + rise) ^ rise) | eq | fall
        right_up = fall | ~(diagonal | rise) & every
        right_down = rise & diagonal
        if right_up & top:
            distance += 1
        elif right_down & top:
            distance -= 1
        right_up = right_up << 1 & every
        right_down = right_down << 1 & every
        rise = right_down | ~((diagonal | fall) | right_up) & every
        fall = right_up & (diagonal | fall)
        if distance < best:
            best, at = distance, place
    return best, at


def locate(item: Item, window: str) -> tuple[int, int, int] | None:
    """(distance, start, end) of the best occurrence within the budget, or None. The start comes from the same search backwards."""
    distance, end = myers(item.text, window)
    if distance > item.budget:
        return None
    _, back = myers(item.text[::-1], window[:end][::-1])
    return distance, end - back, end


def windows(starts: list[int], item: Item, length: int) -> list[tuple[int, int]]:
    """Where to verify: around each start that a piece hints at, overlapping windows made one."""
    out: list[tuple[int, int]] = []
    for start in sorted(starts):
        low, high = max(0, start - item.budget), min(length, start + len(item.text) + item.budget)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


class Finder:
    """Seeks a block of items in texts: an automaton of all pieces, then verification of the places they point to."""

    def __init__(self, items: Sequence[Item]):
        self.items = items
        places: dict[str, list[tuple[int, int]]] = {}
        for number, item in enumerate(items):
            for start, piece in item.pieces():
                places.setdefault(piece, []).append((number, start))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[dict]:
        """The best occurrence of each item in the text, in code points of the text as it is."""
        if not self.items:
            return []
        flat = normalized(text)
        hints: dict[int, set[int]] = {}
        for last, (size, found) in self.automaton.iter(flat):
            for number, start in found:
                hints.setdefault(number, set()).add(last + 1 - size - start)
        hits = []
        for number in sorted(hints):
            item = self.items[number]
            if item.bounded:  # the hint is the whole item
                size = len(item.text)
                exact = [start for start in hints[number] if at_borders(flat, start, start + size)]
                if exact:
                    hits.append((number, 0, min(exact), min(exact) + size))
                continue
            spans = [
                (distance, low + start, low + end)
                for low, high in windows(list(hints[number]), item, len(flat))
                for distance, start, end in [locate(item, flat[low:high]) or (item.budget + 1, 0, 0)]
                if distance <= item.budget
            ]
            if spans:
                distance, start, end = min(spans)
                hits.append((number, distance, start, end))
        if not hits:
            return []
        place = original_places(text)
        return [{"item": n, "distance": d, "start": place(a), "end": place(b - 1) + 1 if b > a else place(a)} for n, d, a, b in hits]


def original_places(text: str):
    """From a place in the normalized text to the place in the text itself."""
    begins, origin, at = [], [], 0
    for word in re.finditer(r"[^\x20\x09-\x0D]+", text):
        begins.append(at)
        origin.append(word.start())
        at += len(word[0]) + 1

    def place(normal: int) -> int:
        word = max(bisect_right(begins, normal) - 1, 0)
        return origin[word] + normal - begins[word]

    return place


def hits_of(text: Column, items: list[Item], spark) -> Column:
    sent = spark.sparkContext.broadcast([(item.text, item.budget, item.bounded) for item in items])
    return row_function(T.ArrayType(HIT), lambda: Finder([Item(*parts) for parts in sent.value]))(text)


def item_blocks(benchmark: DataFrame, block_chars: int, rate: float, least: int) -> Iterator[list[tuple]]:
    """(item_id, Item) lists of at most about ``block_chars`` characters (an item counts ``LEAST_CHARS`` at least), each
    distinct (item_id, text) once. The driver holds one block at a time."""
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.greatest(F.length("text"), F.lit(LEAST_CHARS))), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        found = [(row["item_id"], item_of(row["text"], rate, least)) for row in rows]
        yield sorted(((i, item) for i, item in found if item), key=lambda x: (x[0] is None, x[0] or 0, x[1].text))


def contamination(
    docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, least: int = LEAST_CHARS, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(doc_id, item_id, distance, start, end) for each document and each benchmark item that occurs in it within the error budget.

    Letter case of A-Z and white space don't count. The budget is ``rate`` times the item's characters; of several occurrences the
    closest, then the first is given, as code points of the document's text. Items of under ``least`` characters count only without
    edits and between word borders (in scripts without spaces, anywhere).

    A document whose text is null or empty has no row; a null item_id stays null; repeated documents each get their rows, repeated
    items count once. Texts are searched whole, however long; one text is held by one task. Other columns than those named are not
    used. The benchmark is sought in blocks of bounded size, one pass over the documents for each.
    """
    out = None
    spark = docs.sparkSession
    own = docs.select("doc_id", "text")
    for block in item_blocks(benchmark, block_chars, rate, least):
        ids = F.array(*[F.lit(item_id).cast("long") for item_id, _ in block]) if block else F.array().cast("array<long>")
        hits = own.select("doc_id", F.explode(hits_of(F.col("text"), [item for _, item in block], spark)).alias("h"))
        found = hits.select(
            "doc_id", F.get(ids, F.col("h.item")).alias("item_id"), "h.distance", "h.start", "h.end"
        )
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, least: int = LEAST_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents, all columns as they are, in which no benchmark item occurs.

    Null and empty texts hold none and stay; of repeated rows all stay or all go. An empty benchmark keeps every document.
    """
    spark = docs.sparkSession
    for block in item_blocks(benchmark, block_chars, rate, least):
        if block:
            docs = docs.where(F.size(hits_of(F.col("text"), [item for _, item in block], spark)) == 0)
    return docs
