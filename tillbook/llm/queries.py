"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillbook.llm import (
    decontamination,
    jaccard_join,
    langid,
    licenses,
    lm_scoring,
    merkle,
    packing,
    quality,
    resampling,
    secrets,
    simhash,
    toxicity,
    warc,
)
from tillbook.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.cross_entropy_difference(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(table(spark, folder, "documents"))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.digest(table(spark, folder, "documents"))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), added=True)


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_rules(table(spark, folder, "documents"))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "pages"), table(spark, folder, "documents"))


def op11_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, folder, "documents"))


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(table(spark, folder, "documents"))


def op13_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc,
    "op2_toxicity": op2_toxicity,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_secret_scan": op4_secret_scan,
    "op5_decontamination": op5_decontamination,
    "op6_simhash": op6_simhash,
    "op7_licenses": op7_licenses,
    "op8_packing": op8_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_language_id": op10_language_id,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_merkle": op12_merkle,
    "op13_resampling": op13_resampling,
}

SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS h FROM p),
        r AS (SELECT page_id, n, h, max(page_id) OVER (PARTITION BY h, n) AS top FROM d)
        SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
               CASE WHEN n >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND top <> page_id THEN top END AS refers_to
        FROM r
    """,
    "op3_lm_scoring": """
        WITH w AS (
            SELECT d.doc_id, d.row AS row, q.doc_id IS NOT NULL AS target, t.word, t.place
            FROM (SELECT doc_id, text, row_number() OVER () AS row FROM documents) d
            LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) q USING (doc_id),
            LATERAL (
                SELECT unnest(l) AS word, generate_subscripts(l, 1) AS place
                FROM (SELECT regexp_extract_all(
                    translate(d.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') AS l)
            ) t
        ),
        total AS (SELECT count(*)::DOUBLE AS b, count_if(target)::DOUBLE AS t FROM w),
        g AS (SELECT *, coalesce(lag(word) OVER (PARTITION BY row ORDER BY place), '') AS prev FROM w),
        own_word AS (SELECT row, word, count(*) AS n FROM w GROUP BY row, word),
        size AS (SELECT row, count(*) AS n FROM w GROUP BY row),
        words AS (
            SELECT word, count(*)::DOUBLE AS b, count_if(target)::DOUBLE AS t FROM w GROUP BY word
            UNION ALL SELECT '', count(*), count_if(target) FROM g WHERE prev = ''
        ),
        pairs AS (SELECT prev, word, count(*)::DOUBLE AS b, count_if(target)::DOUBLE AS t FROM g GROUP BY prev, word),
        own_pair AS (SELECT row, target::INT AS mine, prev, word, count(*) AS n FROM g GROUP BY row, target, prev, word),
        others AS (
            SELECT o.row, o.n AS times,
                   p.b - o.n AS pair_b, p.t - mine * o.n AS pair_t,
                   v.b - coalesce(ov.n, 1) AS context_b, v.t - mine * coalesce(ov.n, 1) AS context_t,
                   x.b - ow.n AS word_b, x.t - mine * ow.n AS word_t,
                   total.b - size.n AS rest_b, total.t - mine * size.n AS rest_t, 0.01 / total.b AS even
            FROM own_pair o JOIN pairs p USING (prev, word)
            JOIN words v ON v.word = o.prev LEFT JOIN own_word ov ON ov.row = o.row AND ov.word = o.prev
            JOIN words x ON x.word = o.word JOIN own_word ow ON ow.row = o.row AND ow.word = o.word
            JOIN size ON size.row = o.row, total
        ),
        single AS (
            SELECT *, CASE WHEN rest_b > 0 THEN 0.99 * word_b / rest_b ELSE 0 END + even AS single_b,
                   CASE WHEN rest_t > 0 THEN 0.99 * word_t / rest_t ELSE 0 END + even AS single_t
            FROM others
        ),
        loss AS (
            SELECT row, sum(times)::BIGINT AS n,
                   sum(-ln(CASE WHEN context_t > 0 THEN 0.7 * pair_t / context_t + 0.3 * single_t ELSE single_t END) * times) / sum(times) AS t,
                   sum(-ln(CASE WHEN context_b > 0 THEN 0.7 * pair_b / context_b + 0.3 * single_b ELSE single_b END) * times) / sum(times) AS b
            FROM single GROUP BY row
        )
        SELECT doc_id, coalesce(n, 0) AS n_words, round(coalesce(t, 0), 6) AS target_loss,
               round(coalesce(b, 0), 6) AS background_loss, round(coalesce(t - b, 0), 6) AS score
        FROM (SELECT doc_id, row_number() OVER () AS row FROM documents) d LEFT JOIN loss USING (row)
    """,
    "op11_jaccard_join": """
        WITH RECURSIVE d AS (
            SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') AS w
            FROM documents
        ),
        s AS (
            SELECT doc_id, row, CASE
                WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')]
                ELSE []::VARCHAR[] END AS shingles
            FROM d
        ),
        sizes AS (SELECT doc_id, row, coalesce(len(shingles), 0) AS n FROM s),
        tokens AS (SELECT row, unnest(shingles) AS token FROM s),
        numbered AS (SELECT row, dense_rank() OVER (ORDER BY token) AS token FROM tokens),
        shared AS (
            SELECT a.row AS a, b.row AS b, count(*) AS n FROM numbered a JOIN numbered b USING (token) WHERE a.row < b.row GROUP BY ALL
        ),
        links AS (
            SELECT shared.a, shared.b FROM shared JOIN sizes x ON x.row = a JOIN sizes y ON y.row = b
            WHERE 100 * shared.n >= 90 * (x.n + y.n - shared.n)
        ),
        both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reached AS (
            SELECT row AS a, row AS b FROM sizes
            UNION SELECT r.a, l.b FROM reached r JOIN both_ways l ON l.a = r.b
        )
        SELECT any_value(own.doc_id) AS doc_id, any_value(own.n) AS n_shingles, min(other.doc_id) AS component_id
        FROM reached JOIN sizes own ON own.row = a JOIN sizes other ON other.row = b
        GROUP BY reached.a
    """,
    "op12_merkle": """
        WITH RECURSIVE p AS (
            SELECT doc_id, lang, n_chars, list_transform([doc_id::VARCHAR, source, lang], lambda v: coalesce(octet_length(encode(v)) || ':' || v, '-')) AS head,
                   coalesce(octet_length(encode(text)) || ':' || text, '-') AS body
            FROM documents
        ),
        crc AS (
            -- The remainder of the crc32 of each doc_id, bit by bit.
            SELECT doc_id, list_reduce(
                list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                lambda crc, byte: list_reduce(
                    [xor(crc, byte), 1, 1, 1, 1, 1, 1, 1, 1],
                    lambda x, one: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS c
            FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
        ),
        leaves AS (
            SELECT p.doc_id, lang, sha256(array_to_string(head, '') || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || body) AS leaf,
                   sha256(array_to_string(head, '') || coalesce(length((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || body) AS plus,
                   n_chars IS NOT NULL AND coalesce(xor(c, 4294967295) % 7 = 0, FALSE) AS hit
            FROM p LEFT JOIN crc USING (doc_id)
        ),
        placed AS (
            SELECT doc_id, lang, leaf, CASE WHEN hit THEN plus ELSE leaf END AS own,
                   row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos
            FROM leaves
        ),
        below AS (
            SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY lang
            UNION ALL
            SELECT lang, level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], '')))
            FROM below WHERE len(nodes) > 1
        ),
        subroots AS (
            SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS pos
            FROM below WHERE len(nodes) = 1
        ),
        above AS (
            SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM subroots
            UNION ALL
            SELECT level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], '')))
            FROM above WHERE len(nodes) > 1
        ),
        root AS (SELECT nodes[1] AS root FROM above WHERE len(nodes) = 1),
        -- All trees as one list of levels for each language: its own, then those of the subroots.
        towers AS (
            SELECT b.lang, b.level, b.nodes, s.pos AS upper, FALSE AS top FROM below b JOIN subroots s ON b.lang IS NOT DISTINCT FROM s.lang WHERE len(b.nodes) > 1
            UNION ALL SELECT s.lang, a.level, a.nodes, s.pos, TRUE FROM above a, subroots s WHERE len(a.nodes) > 1
        ),
        steps AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY top, level) AS step, level, nodes, upper, top FROM towers),
        walk AS (
            SELECT row_number() OVER () AS row, doc_id, lang, leaf, pos, 0::BIGINT AS step, own AS digest, '' AS proof FROM placed
            UNION ALL
            SELECT row, doc_id, walk.lang, leaf, walk.pos, s.step,
                   sha256(CASE WHEN spot % 2 = 0 THEN digest || coalesce(nodes[spot + 2], '') ELSE nodes[spot] || digest END),
                   proof || coalesce(CASE WHEN spot % 2 = 0 THEN nodes[spot + 2] ELSE nodes[spot] END, '')
            FROM walk JOIN steps s ON s.lang IS NOT DISTINCT FROM walk.lang AND s.step = walk.step + 1,
                 LATERAL (SELECT CASE WHEN top THEN upper ELSE walk.pos END // (1 << s.level::INTEGER) AS spot) place
        ),
        ends AS (SELECT arg_max(walk, step) AS e FROM walk GROUP BY row)
        SELECT e.doc_id AS doc_id, e.leaf AS leaf, subroot, root, sha256(e.proof) AS proof_sha256, e.digest AS folded_root,
               e.digest = root AS verified
        FROM ends JOIN subroots s ON s.lang IS NOT DISTINCT FROM e.lang, root
    """,
}
