"""License scans: word k-gram hashes joined to template positions, voted on by offset diagonal, merged and verified."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.llm.common import row_function

#: Words of a k-gram.
WIDTH = 3
#: Share of a template's words, and of the words of the span, that must match.
LEAST_SCORE = 0.8

# Phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Notices of public licences and their labels. The phrases above are templates too.
TEMPLATES = (
    *((label, phrase) for phrase, label in BASE.items()),
    ("mit", "Released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    (
        "cc-by-nc",
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    (
        "cc-by-sa",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl-3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    (
        "gpl-2",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    ),
    (
        "lgpl-3",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    (
        "lgpl-2.1",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    ),
    (
        "agpl-3",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "bsd-3",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission",
    ),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for "
        "any purpose, including commercial applications, and to alter it and redistribute it freely",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    (
        "boost",
        "Distributed under the Boost Software License, Version 1.0",
    ),
    (
        "epl-2",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    ),
    (
        "cc0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    ),
    (
        "cc-by-nd",
        "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License",
    ),
    (
        "cc-by-nc-sa",
        "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    ),
    (
        "cc-by-nc-nd",
        "This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    ),
    ("artistic-2", "This program is free software; you can redistribute it under the terms of the Artistic License 2.0"),
    ("public-domain", "This work has been dedicated to the public domain and may be used without restriction"),
)

# Words are letters, digits and everything beyond ASCII, A-Z in lower case.
_WORD_BYTES = bytes(
    b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256)
)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: Stands for a document itself among its k-grams, so that one without a match keeps its row.
_ITSELF = np.int64(0x5DEECE66D)

_SCAN = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")]
    + [T.StructField("base_labels", T.ArrayType(T.StringType()))]
)
_SCANNED = T.StructType([T.StructField("scan", _SCAN), T.StructField("grams", T.ArrayType(T.LongType()))])
SPAN = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def license_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split() if text else []


def rolling_hashes(words: Sequence[bytes], width: int = WIDTH) -> np.ndarray:
    """A signed 64-bit hash of every run of ``width`` words. Words are taken as equal if their XXH64 is."""
    if len(words) < width:
        return np.zeros(0, np.int64)
    hashes = np.array([xxhash.xxh64_intdigest(word) for word in words], np.uint64)
    rolled = np.zeros(len(words) - width + 1, np.uint64)
    for place in range(width):
        rolled = (rolled ^ hashes[place : place + len(rolled)]) * _MIX[place % len(_MIX)]
        rolled ^= rolled >> np.uint64(29)
    return rolled.view(np.int64)


def base_places(words: Sequence[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a base phrase's words stand one after another."""
    joined = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in BASE.items():
        needle = f" {phrase} ".encode()
        word = last = 0
        at = joined.find(needle)
        while at >= 0:
            word, last = word + joined.count(b" ", last, at), at
            found.append((word, label))
            at = joined.find(needle, at + 1)
    return found


def scan_text(text: str | None, width: int = WIDTH) -> dict:
    words = license_words(text)
    places = base_places(words)
    return {
        "scan": {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min((p for p, _ in places), default=None),
            "last_word": max((p for p, _ in places), default=None),
            "base_labels": sorted({label for _, label in places}),
        },
        "grams": np.append(rolling_hashes(words, width), _ITSELF),
    }


@dataclass(frozen=True)
class Template:
    label: str
    words: int

    @property
    def gap(self) -> int:
        """Words put in or left out between diagonals that can still be one occurrence: as many as the score lets a span have
        beyond the template's words, and fewer than set two repeats apart."""
        return int(self.words * (1 - LEAST_SCORE) / LEAST_SCORE + 1e-9)

    @property
    def near(self) -> int:
        """As many of them as leave no doubt."""
        return min(3, self.words // 4)


def template_positions(spark: SparkSession, width: int = WIDTH, templates=TEMPLATES) -> DataFrame:
    """(gram, template, position) of every k-gram of every template; the document's own mark is template -1."""
    rows = [(int(_ITSELF), -1, 0)]
    for number, (_, text) in enumerate(templates):
        grams = rolling_hashes(license_words(text), width).tolist()
        rows += [(gram, number, place) for place, gram in enumerate(grams)]
    return spark.createDataFrame(rows, "gram long, template int, position int")


def merge_diagonals(hits: Sequence[tuple[int, int, list[int]]], templates: Sequence[Template], width: int = WIDTH) -> list[tuple]:
    """Spans (label, start, end, score) from (template, diagonal, positions matched on it).

    A diagonal is where the template would start in the document. Neighbouring ones are one occurrence with words put in or
    left out; of the ways to join those up to ``gap`` apart, the best stays. A span holds if enough of the template's words, and
    of its own words, are matched. Of overlapping spans with different labels the one that matches best stays. The time is that of
    sorting the hits, however often a text repeats a notice.
    """
    by_template: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for template, diagonal, positions in hits:
        by_template[template].append((diagonal, positions))
    found = []
    for number, diagonals in by_template.items():
        template = templates[number]
        clusters: list[list[tuple[int, list[int]]]] = []
        for diagonal, positions in sorted(diagonals):
            if clusters and diagonal - clusters[-1][-1][0] <= template.near:
                clusters[-1].append((diagonal, positions))
            else:
                clusters.append([(diagonal, positions)])
        # Clusters that are one occurrence with more words put in or left out: every row of them whose span can still hold
        # is scored, so that a stray match nearby is left out again.
        spans: set[tuple[str, int, int, float]] = set()
        for first in range(len(clusters)):
            own: set[int] = set()
            seen: set[int] = set()
            for place in range(first, len(clusters)):
                if place > first and clusters[place][0][0] - clusters[place - 1][-1][0] > template.gap:
                    break
                own.update(p + k for _, positions in clusters[place] for p in positions for k in range(width))
                seen.update(d + p + k for d, positions in clusters[place] for p in positions for k in range(width))
                start, end = min(seen), max(seen) + 1
                score = min(len(own), len(seen)) / max(template.words, end - start)
                if score >= LEAST_SCORE:
                    spans.add((template.label, start, end, score))
                if end - start > template.words / LEAST_SCORE:
                    break
        taken: list[tuple[int, int]] = []
        for span in sorted(spans, key=lambda s: (-s[3], s[1] - s[2], s)):
            # Those taken don't overlap and ascend, so the neighbours tell.
            at = bisect_left(taken, span[1:3])
            if (at == 0 or taken[at - 1][1] <= span[1]) and (at == len(taken) or span[2] <= taken[at][0]):
                taken.insert(at, span[1:3])
                found.append(span)
    kept: list[tuple] = []
    reach: dict[int, str] = {}
    for span in sorted(set(found), key=lambda s: (-s[3], s[1] - s[2], s)):
        if all(reach.get(word, span[0]) == span[0] for word in range(span[1], span[2])):
            reach.update(dict.fromkeys(range(span[1], span[2]), span[0]))
            kept.append(span)
    return sorted(kept, key=lambda s: (s[1], s[2], s[0]))


def find_licenses(docs: DataFrame, width: int = WIDTH, templates=TEMPLATES) -> DataFrame:
    """One row per document: doc_id, ``scan`` (counts and base phrases) and ``spans`` (label, start, end in words, score).

    Every rolling k-gram of every document is joined to the templates' positions. Their table is a fixed list of a few hundred rows,
    so it is broadcast and the documents' k-grams are not shuffled; votes are counted by document and diagonal in the map
    tasks. A document is known by its id and two hashes of its text: repeated rows are looked at as one and then given out again. A null or
    empty text has no words, no spans, and null for first_word and last_word.
    """
    spark = docs.sparkSession
    known = [Template(label, len(license_words(text))) for label, text in templates]
    scanned = row_function(_SCANNED, lambda: lambda text: scan_text(text, width))(F.col("text"))
    h1, h2 = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
    rows = docs.select("doc_id", h1.alias("h1"), h2.alias("h2"), scanned.alias("s"))
    grams = rows.select("doc_id", "h1", "h2", "s.scan", F.posexplode("s.grams").alias("place", "gram"))
    matched = grams.join(F.broadcast(template_positions(spark, width, templates)), "gram")
    diagonal = F.when(F.col("template") >= 0, F.col("place") - F.col("position"))
    voted = (
        matched.groupBy("doc_id", "h1", "h2", "template", diagonal.alias("diagonal"))
        .agg(F.collect_set("position").alias("positions"), F.count("*").alias("votes"), F.first("scan").alias("scan"))
    )
    itself = F.col("template") < 0
    votes = F.collect_list(F.when(~itself, F.struct("template", "diagonal", "positions")))
    together = voted.groupBy("doc_id", "h1", "h2").agg(
        votes.alias("hits"), F.max(F.when(itself, F.col("votes"))).alias("copies"), F.first("scan").alias("scan")
    )

    def prepare():
        def of(hits: list[dict]) -> list[dict]:
            spans = merge_diagonals([(h["template"], h["diagonal"], h["positions"]) for h in hits], known, width)
            return [dict(zip(("label", "start", "end", "score"), span)) for span in spans]

        return of

    spans = row_function(T.ArrayType(SPAN), prepare)(F.col("hits"))
    each = together.withColumn("spans", spans).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    )
    return each.select("doc_id", "scan", "spans")


def digest(docs: DataFrame) -> DataFrame:
    """One row per document with the base counts, both kinds of labels, and the best span's score (0 without one).

    Null and empty texts have no words and labels; repeated rows each get their row. Texts are read whole, one by one task. Other columns
    than doc_id and text are not used.
    """

    def listed(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    base = F.col("scan.base_labels")
    own = F.transform("spans", lambda s: s["label"])
    scores = F.transform("spans", lambda s: s["score"])
    return find_licenses(docs).select(
        "doc_id",
        "scan.n_words",
        "scan.n_base",
        "scan.first_word",
        "scan.last_word",
        listed(base).alias("base_labels"),
        listed(F.concat(base, own)).alias("labels"),
        F.coalesce(F.array_max(scores), F.lit(0.0)).alias("score"),
    )
