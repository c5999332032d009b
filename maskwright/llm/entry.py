"""The queries of this package for the driver: thin forms over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, exact_dedup, jaccard_join, langid, licenses, media, merkle, mixing, packing, secrets, suffix_dedup, token_counts, tokens
from .common import documents


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir), words=4, percent=85).drop("key", "kept")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.text_to_media(documents(spark, sf_dir)))


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_files(documents(spark, sf_dir), tokenizer_path())


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also the text that is left; a character that a cut splits becomes U+FFFD."""
    out = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    return out.withColumn("kept_text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("matches")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secrets.scan(docs, secrets.fit(docs)).drop("found")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.crc32(F.col("doc_id").cast("string")) % 2 == 1
    tampered = F.when(~odd, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(documents(spark, sf_dir), ["doc_id", "source", "lang", "n_chars", "text"], now={"text": tampered}).drop("proof")


def piece_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op12_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.cross_tokens(documents(spark, sf_dir), tokenizer_path(), piece_path())


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), piece_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_mixing": op2_mixing,
    "op3_language_id": op3_language_id,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_media": op5_media,
    "op6_token_files": op6_token_files,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_license_scan": op9_license_scan,
    "op10_secret_scan": op10_secret_scan,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_cross_tokens": op12_cross_tokens,
    "op13_token_counts": op13_token_counts,
}

ORACLES: dict[str, str] = {
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """,
    "op11_merkle_manifest": """
        WITH RECURSIVE d AS (
            SELECT *, list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda b: [ord(b)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
                                  lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END, 4294967295::BIGINT) AS inverted_crc
            FROM documents
        ), now AS (
            SELECT *, CASE WHEN xor(inverted_crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS text_now FROM d
        ), parts AS (
            SELECT doc_id, source, coalesce(strlen(text) || ':' || text, '-') AS t, coalesce(strlen(text_now) || ':' || text_now, '-') AS t_now,
                   coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                   || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
            FROM now
        ), leaves AS (
            SELECT doc_id, source, sha256(head || t) AS leaf, sha256(head || t_now) AS leaf_now,
                   row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
            FROM parts
        ), nodes AS (
            SELECT 0 AS level, source, idx, leaf AS node, n FROM leaves
            UNION ALL
            SELECT level + 1, source, idx // 3, sha256(string_agg(node, '' ORDER BY idx)), (any_value(n) + 2) // 3
            FROM nodes WHERE n > 1 GROUP BY level, source, idx // 3
        ), steps AS (
            SELECT level, source, idx, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
                   coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
            FROM nodes WHERE n > 1 WINDOW w AS (PARTITION BY level, source, idx // 3 ORDER BY idx)
        ), subroots AS (
            SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
        ), tops AS (
            SELECT 0 AS level, idx, subroot AS node, n FROM subroots
            UNION ALL
            SELECT level + 1, idx // 3, sha256(string_agg(node, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, idx // 3
        ), top_steps AS (
            SELECT level, idx, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
                   coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
            FROM tops WHERE n > 1 WINDOW w AS (PARTITION BY level, idx // 3 ORDER BY idx)
        ), below AS (
            SELECT doc_id, source, 0 AS level, idx, leaf_now AS done, '' AS siblings FROM leaves
            UNION ALL
            SELECT b.doc_id, b.source, b.level + 1, b.idx // 3, sha256(s.before || b.done || s.after), b.siblings || s.before || s.after
            FROM below b JOIN steps s ON s.level = b.level AND s.source IS NOT DISTINCT FROM b.source AND s.idx = b.idx
        ), above AS (
            SELECT l.doc_id, 0 AS level, r.idx, l.done, l.siblings
            FROM (SELECT doc_id, source, arg_max(done, level) AS done, arg_max(siblings, level) AS siblings FROM below GROUP BY doc_id, source) l
            JOIN subroots r ON r.source IS NOT DISTINCT FROM l.source
            UNION ALL
            SELECT a.doc_id, a.level + 1, a.idx // 3, sha256(s.before || a.done || s.after), a.siblings || s.before || s.after
            FROM above a JOIN top_steps s ON s.level = a.level AND s.idx = a.idx
        ), ends AS (
            SELECT doc_id, arg_max(done, level) AS folded_root, arg_max(siblings, level) AS siblings FROM above GROUP BY doc_id
        )
        SELECT l.doc_id, l.leaf, r.subroot, t.node AS root, sha256(e.siblings) AS proof_sha256, e.folded_root, e.folded_root = t.node AS verified
        FROM leaves l JOIN subroots r ON r.source IS NOT DISTINCT FROM l.source JOIN ends e ON e.doc_id = l.doc_id JOIN tops t ON t.n = 1
    """,
}
