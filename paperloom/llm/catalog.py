"""Queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bilinear_lm, collocations, digests, exact_dedup, html_region, kneser_ney, langid, mixing, ngram_join, packing, pii_segments, quality_trees, whitening
from .common import read


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_region.extract(read(spark, sf_dir, "pages"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.fingerprints(read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs, public_tokenizers.path("piece_bpe_32k.model")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(read(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.drawn(read(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pii_segments.find(docs, pii_segments.learn(docs))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return bilinear_lm.score(docs, bilinear_lm.learn(docs))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_trees.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.learn(vectors))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return kneser_ney.judge(docs, kneser_ney.learn(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_fingerprints": op2_fingerprints,
    "op3_language_id": op3_language_id,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_source_mixing": op6_source_mixing,
    "op7_pii": op7_pii,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_quality_rules": op13_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
 row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
    "op11_phrase_collocations": r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
same AS (SELECT lang, piece, count(*) AS c FROM pieces GROUP BY lang, piece),
worded AS (SELECT lang, c, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM same),
placed AS (SELECT lang, c, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
starts AS (SELECT lang, c, list_slice(w, i, i + 4) AS g FROM placed),
edges AS (SELECT lang, g, sum(c) AS c FROM starts GROUP BY lang, g),
lengths AS (SELECT unnest(range(1, 6)) AS k),
f AS (SELECT lang, list_slice(g, 1, k) AS g, k, CAST(sum(c) AS HUGEINT) AS f FROM edges JOIN lengths ON k <= len(g) GROUP BY lang, list_slice(g, 1, k), k),
totals AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
often AS (SELECT * FROM f WHERE f >= 100),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM often WHERE k > 1),
scored AS (SELECT c.lang, c.g, c.k, c.f AS a, l.f AS l, r.f AS r, n, 1000 * c.f * n // (l.f * r.f) AS score, cut FROM cuts c
 JOIN often l ON l.lang = c.lang AND l.g = list_slice(c.g, 1, cut) JOIN often r ON r.lang = c.lang AND r.g = list_slice(c.g, cut + 1, c.k) JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
inner_parts AS (SELECT lang, f, g, k, unnest(range(2, k)) AS j FROM often WHERE k > 2),
carried AS (SELECT lang, list_slice(g, s, s + j - 1) AS g, max(f) AS most FROM (SELECT *, unnest(range(1, k - j + 2)) AS s FROM inner_parts) GROUP BY ALL),
kept AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM best b LEFT JOIN carried c ON c.lang = b.lang AND c.g = b.g WHERE c.most IS NULL OR c.most < b.a)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
""",
}
