"""Queries of the numbered operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import exact_dedup, line_dedup, merkle, mixing, near_dedup, packing, quality, ranked_search, secrets, suffix_tree, token_attribution, topk, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op2_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_decisions(docs).select("doc_id", "n_lines", "n_removed", F.length("kept_text").alias("kept_chars"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op6_assignment_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op7_norm_sorted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"))


def op8_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_attribution.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_dart_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op10_golomb_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.manifest(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.suffix_tree_scores(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_compression_quality, op2_fuzzy_lines, op3_source_mixing, op4_hilbert_packing, op5_gru_toxicity, op6_assignment_secrets, op7_norm_sorted_topk, op8_token_attribution, op9_dart_near_dedup, op10_golomb_exact_dedup, op11_merkle_manifest, op12_suffix_tree, op13_ranked_search)}

ORACLES: dict[str, str] = {
    "op7_norm_sorted_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS vector,
                   row_number() OVER () AS own
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), scored AS (
            SELECT q.own, q.vec_id AS query_id, c.vec_id,
                   CAST(list_inner_product(q.vector, c.vector) AS BIGINT) AS score
            FROM v q JOIN v c ON q.own <> c.own
            WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op10_golomb_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS normal FROM documents
        )
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               coalesce(doc_id = max(doc_id) OVER same, false) AND row_number() OVER (PARTITION BY normal, doc_id) = 1 AS kept,
               sha256(normal) AS text_sha256
        FROM d WINDOW same AS (PARTITION BY normal)
    """,
    "op11_merkle_manifest": r"""
        WITH RECURSIVE crc AS (
            SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
        ), fields AS (
            SELECT doc_id, source, text, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
                       || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head,
                   list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                       lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])) AS h
            FROM documents, crc
        ), leaves AS (
            SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
                   CASE WHEN xor(h, 4294967295) % 5 = 0
                        THEN sha256(head || coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS altered
            FROM fields
        ), numbered AS (
            SELECT *, coalesce(altered, leaf) AS offered, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM leaves
        ), level AS (
            SELECT source, 0 AS l, place, n, leaf AS node FROM numbered
            UNION ALL
            SELECT source, l + 1, place // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY place)) FROM level WHERE n > 1 GROUP BY source, l, place // 16, (n + 15) // 16
        ), subroots AS (
            SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM level WHERE n = 1
        ), upper_level AS (
            SELECT 0 AS l, place, n, subroot AS node FROM subroots
            UNION ALL
            SELECT l + 1, place // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY place)) FROM upper_level WHERE n > 1 GROUP BY l, place // 16, (n + 15) // 16
        ), steps AS (
            SELECT a.source, a.l, a.place, a.n, coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS before, coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS after
            FROM level a JOIN level b ON a.source IS NOT DISTINCT FROM b.source AND a.l = b.l AND a.place // 16 = b.place // 16 WHERE a.n > 1 GROUP BY a.source, a.l, a.place, a.n
        ), upper_steps AS (
            SELECT a.l, a.place, coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS before, coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS after
            FROM upper_level a JOIN upper_level b ON a.l = b.l AND a.place // 16 = b.place // 16 WHERE a.n > 1 GROUP BY a.l, a.place
        ), fold AS (
            SELECT doc_id, source, leaf, row_number() OVER () AS own, 0 AS l, place, n, offered AS node, '' AS proof FROM numbered
            UNION ALL
            SELECT doc_id, f.source, leaf, own, f.l + 1, f.place // 16, (f.n + 15) // 16, sha256(before || node || after), proof || before || after
            FROM fold f JOIN steps s ON f.source IS NOT DISTINCT FROM s.source AND f.l = s.l AND f.place = s.place
        ), upper_fold AS (
            SELECT doc_id, leaf, own, subroot, 0 AS l, s.place, s.n, f.node, f.proof FROM fold f JOIN subroots s ON f.source IS NOT DISTINCT FROM s.source WHERE f.n = 1
            UNION ALL
            SELECT doc_id, leaf, own, subroot, f.l + 1, f.place // 16, (f.n + 15) // 16, sha256(before || node || after), proof || before || after
            FROM upper_fold f JOIN upper_steps s ON f.l = s.l AND f.place = s.place
        )
        SELECT doc_id, leaf, subroot, (SELECT node FROM upper_level WHERE n = 1) AS root, sha256(proof) AS proof_sha256, node AS folded_root,
               node = (SELECT node FROM upper_level WHERE n = 1) AS verified
        FROM upper_fold WHERE n = 1
    """,
    "op13_ranked_search": r"""
        WITH found AS (
            SELECT row_number() OVER () AS own, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), corpus AS (
            SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM found WHERE len(terms) > 0
        ), posting AS (
            SELECT own, doc_id, n, term, count(*) AS tf FROM (SELECT own, doc_id, len(terms) AS n, unnest(terms) AS term FROM found) GROUP BY own, doc_id, n, term
        ), frequency AS (
            SELECT term, count(*) AS df FROM posting GROUP BY term
        ), item AS (
            SELECT DISTINCT row, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT *, row_number() OVER () AS row FROM benchmark)
        ), weighted AS (
            SELECT row, item_id, term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM item JOIN frequency USING (term), corpus
        ), scored AS (
            SELECT row, item_id, own, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
            FROM weighted JOIN posting USING (term), corpus GROUP BY row, item_id, own, doc_id
        ), ranked AS (
            SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, doc_id NULLS LAST, own) AS INTEGER) AS rank FROM scored WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
}
