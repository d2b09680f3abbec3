"""Language identification by Bayesian fusion of a page's text, declared language, address suffix and host."""

from __future__ import annotations

import html as html_text
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.llm.common import among_first, hash_place, likely_members, row_function, stored

#: Labelled documents of a language that the text model is fitted to at most.
TRAIN_ROWS = 5_000
#: Byte trigrams are hashed to 2**BITS places.
BITS = 14
#: Weight of a trigram's log likelihood: trigrams overlap and don't vary freely.
TEXT_WEIGHT = 0.2
#: Pages that the next wider level counts for, when a host or domain is smoothed.
SMOOTHING = 5.0
#: Pages added to each cell of the tables of declared languages and suffixes.
CELL = 0.5
#: Text posteriors are summed as whole millionths, so that sums don't depend on their order.
UNIT = 1_000_000

_MARKUP = re.compile(r"<(?:(!--)|(script|style|noscript|template)\b)?", re.IGNORECASE)
_CLOSING = {
    name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style", "noscript", "template")
}
_DECLARING = re.compile(r"<(html|meta)\b", re.IGNORECASE)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([a-z]{2,3})(?![a-z])", re.IGNORECASE)
_NAMED = re.compile("content-language", re.IGNORECASE)
_CONTENT = re.compile(r"content\s*=\s*[\"']?([a-z]{2,3})(?![a-z])", re.IGNORECASE)
_WORD_BYTES = bytes(b if 97 <= b < 123 or b >= 128 else 32 for b in range(256))


# --- Text -------------------------------------------------------------------------------------


def visible_text(page: str | None) -> str:
    """The text outside of tags, comments, scripts and the like. What is opened and not closed is a tag, or else text.

    One scan forwards: a closing mark that isn't found is not sought again.
    """
    page, parts, at, lacking = page or "", [], 0, set()

    def past(closing: str, start: int) -> int:
        """Where the next closing mark ends, or -1."""
        if closing in lacking:
            return -1
        if closing in _CLOSING:
            found = _CLOSING[closing].search(page, start)
            end = found.end() if found else -1
        else:
            found = page.find(closing, start)
            end = found + len(closing) if found >= 0 else -1
        if end < 0:
            lacking.add(closing)
        return end

    start = 0
    while opened := _MARKUP.search(page, start):
        end = past("-->" if opened[1] else opened[2].casefold(), opened.end()) if opened[1] or opened[2] else -1
        if end < 0:
            end = past(">", opened.start() + 1)
        if end < 0:
            start = opened.start() + 1
            continue
        parts.append(page[at : opened.start()])
        at = start = end
    return html_text.unescape(" ".join([*parts, page[at:]]))


def declared_language(page: str | None) -> str | None:
    """The primary subtag, of two or three letters, that the markup declares first: ``lang`` of html, or a content-language.

    Of the html and of the meta tags that open before the same ``>`` the first says all that a later one could.
    """
    page, at = page or "", 0
    while opened := _DECLARING.search(page, at):
        at = page.find(">", opened.end())
        at = len(page) if at < 0 else at
        tried = set()
        for tag in _DECLARING.finditer(page, opened.start(), at):
            kind = tag[1].lower()
            if kind in tried:
                continue
            tried.add(kind)
            named = tag if kind == "html" else _NAMED.search(page, tag.end(), at)
            found = named and (_LANG if kind == "html" else _CONTENT).search(page, named.end(), at)
            if found:
                return found[1].lower()
    return None


def trigrams(text: str | None) -> np.ndarray:
    """Places of the byte trigrams of the words, lower-cased, each between spaces. A text without letters has none."""
    words = (text or "").lower().encode().translate(_WORD_BYTES).split()
    if not words:
        return np.zeros(0, np.uint32)
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    return ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


@dataclass(frozen=True)
class TextModel:
    """Log likelihoods of the trigram places (rows) in each language (columns)."""

    languages: list[str]
    logs: np.ndarray


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> TextModel:
    """A trigram model from the ``lang`` of at most ``rows`` documents of each language, those whose ids hash to the first places.

    The size of each language gives the share of places to look at, so that about twice ``rows`` ids of a language
    are sorted, however many documents it has. Documents without lang, id or text are not learned from.
    """
    order = Window.partitionBy("lang").orderBy(hash_place("doc_id"), "doc_id")
    known = docs.select("doc_id", "lang").where("doc_id is not null and lang is not null").distinct()
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    chosen = (
        known.join(sizes, "lang")
        .where(among_first("doc_id", rows, F.col("n")))
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= rows)
        .select("doc_id", "lang")
    )
    chosen = stored(chosen, "langid-sample")
    likely = likely_members(docs.select("doc_id", "lang", "text"), chosen, "doc_id")
    sample = likely.join(chosen, ["doc_id", "lang"], "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                own = sums.setdefault(lang, np.zeros(1 << BITS, np.int64))
                own += np.bincount(trigrams(text), minlength=1 << BITS)
            if len(sums) > 64:
                yield from emit(sums)
                sums = {}
        yield from emit(sums)

    def emit(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, n in sums.items():
            place = np.flatnonzero(n)
            columns = [pa.array([lang] * len(place), pa.string()), pa.array(place.astype(np.int32)), pa.array(n[place])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "place", "n"])

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, place int, n long")
    sums = counted.groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sums["lang"].unique())
    counts = np.full((1 << BITS, len(languages)), CELL)
    for at, lang in enumerate(languages):
        own = sums[sums["lang"] == lang]
        counts[own["place"].to_numpy(), at] += own["n"].to_numpy()
    return TextModel(languages, np.log(counts / counts.sum(axis=0)))


def text_evidence(page: str | None, logs: np.ndarray, weight: float = TEXT_WEIGHT) -> list[float]:
    """Weighted log likelihoods, the largest being 0. Without text all are 0."""
    total = weight * logs[trigrams(visible_text(page))].sum(axis=0)
    return (total - total.max()).tolist() if len(total) else []


# --- Fusion -----------------------------------------------------------------------------------

_SEEN = T.StructType(
    [
        T.StructField("declared", T.StringType()),
        T.StructField("logs", T.ArrayType(T.DoubleType())),
        T.StructField("q", T.ArrayType(T.LongType())),
    ]
)


def host_of(url: Column) -> Column:
    """The host of an absolute URL in lower case, without user and port; null if there is none."""
    authority = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://([^/?#\s]*)", 1)
    host = F.regexp_extract(authority, r"^(?:[^@]*@)?([^:@]+)", 1)
    return F.when(host != "", F.rtrim(host, F.lit(".")))


def evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """What each page shows: page_id, host, domain, suffix, declared, ``logs``, and ``q``, the text's own posterior in millionths."""
    sent = pages.sparkSession.sparkContext.broadcast(model.logs)

    def prepare():
        logs = sent.value

        def of(page: str | None) -> dict:
            own = text_evidence(page, logs)
            return {"declared": declared_language(page), "logs": own, "q": np.floor(softmax(own) * UNIT + 0.5).astype(int).tolist()}

        return of

    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), row_function(_SEEN, prepare)(F.col("html")).alias("s"))
    labels = F.split("host", r"\.")
    last = F.element_at(labels, -1)
    return (
        seen.select("page_id", "host", "s.*")
        .withColumn("domain", F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2), "."))
        .withColumn("suffix", F.when(~last.rlike("^[0-9]+$") & (F.size(labels) > 1), last))
    )


def softmax(logs: list[float] | np.ndarray) -> np.ndarray:
    odds = np.exp(np.asarray(logs, float) - max(logs, default=0.0))
    return odds / odds.sum()


def _sums(seen: DataFrame, size: int, *keys: str) -> DataFrame:
    """Text posteriors summed by key, as one array. Each key is combined in the map tasks."""
    name = "by_" + (keys[0] if keys else "all")
    return seen.groupBy(*keys).agg(F.array(*[F.sum(F.col("q")[i]) for i in range(size)]).alias(name))


def identify(pages: DataFrame, docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per page: page_id, lang, posterior, text_lang (the text alone), declared, host.

    The posterior of a language is the product of
      the host's prior: its pages' text posteriors, smoothed by its domain's, and those by those of all pages;
      the likelihoods of the declared language and of the suffix, from their joint counts with the text posteriors;
      the text's weighted trigram likelihood.
    A page never counts as evidence for itself: its own share is taken out of every count. What a page lacks (text,
    declaration, host, suffix) has no say; a page without anything gets the prior of all pages. Of equal languages the
    first by name is taken. Repeated rows each get a row. Without any labelled document lang and
    posterior are null. Other columns than those named are not used.

    Counts are grouped aggregates over all pages. Domain and suffix follow from the host, so their counts join the host's; a host
    with a third of all pages is one row there, and adaptive execution splits the pages' side. Declared languages
    have three letters at most, so their table has fewer than 20,000 rows and is broadcast.
    """
    spark = pages.sparkSession
    model = fit(docs, rows)
    size = len(model.languages)
    if not size:
        none = F.lit(None)
        return pages.select(
            "page_id",
            none.cast("string").alias("lang"),
            none.cast("double").alias("posterior"),
            none.cast("string").alias("text_lang"),
            none.cast("string").alias("declared"),
            host_of(F.col("url")).alias("host"),
        )
    seen = stored(evidence(pages, model), "langid-evidence")
    total = _sums(seen, size).first()["by_all"]
    totals = np.array([n or 0 for n in total], np.int64)
    hosts = _sums(seen.where("host is not null"), size, "host", "domain", "suffix")
    domains = _sums(seen.where("host is not null"), size, "domain")
    suffixes = _sums(seen.where("suffix is not null"), size, "suffix")
    declared = _sums(seen.where("declared is not null"), size, "declared")
    n_suffix, n_declared = _distinct(seen, "suffix"), _distinct(seen, "declared")
    known = hosts.join(domains, "domain").join(suffixes, "suffix", "left").drop("domain", "suffix")
    joined = seen.join(known, "host", "left").join(F.broadcast(declared), "declared", "left")

    def prepare():
        def of(page: dict) -> list[float]:
            q = np.array(page["q"], np.int64)

            def others(counts) -> np.ndarray:
                """The counts of the languages in pages other than this one, at least 0."""
                return np.maximum(np.asarray(counts, np.int64) - q, 0) / UNIT

            def all_others(counts) -> float:
                return max(int(np.sum(counts)) - int(q.sum()), 0) / UNIT

            elsewhere = others(totals)
            prior = (elsewhere + 1) / (all_others(totals) + size)
            for name in ("by_domain", "by_host"):
                if page[name] is not None:
                    prior = (others(page[name]) + SMOOTHING * prior) / (all_others(page[name]) + SMOOTHING)
            logs = page["logs"] + np.log(prior)
            for name, kinds in (("by_suffix", n_suffix), ("by_declared", n_declared)):
                if page[name] is not None:
                    logs = logs + np.log((others(page[name]) + CELL) / (elsewhere + CELL * max(kinds, 1)))
            return softmax(logs).tolist()

        return of

    page = F.struct("q", "logs", "by_host", "by_domain", "by_suffix", "by_declared")
    names = F.array(*[F.lit(name) for name in model.languages])
    fused = joined.withColumn("fused", row_function(T.ArrayType(T.DoubleType()), prepare)(page))
    has_text = F.array_min("logs") < 0

    def first_of(values: Column) -> Column:
        return F.get(names, F.array_position(values, F.array_max(values)).cast("int") - 1)

    return fused.select(
        "page_id",
        first_of(F.col("fused")).alias("lang"),
        F.array_max("fused").alias("posterior"),
        F.when(has_text, first_of(F.col("logs"))).alias("text_lang"),
        "declared",
        "host",
    )


def _distinct(seen: DataFrame, name: str) -> int:
    return seen.agg(F.count_distinct(name)).first()[0]
