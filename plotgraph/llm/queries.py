"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, embed_dedup, knn, lexical, licenses, lines, mixing, quality, secrets, simhash, tokens, toxicity
from .common import fold, table


def op1_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern)
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def _labels(spark: SparkSession, sf_dir: str, column: str, modulus: int, held: int) -> DataFrame:
    return table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), modulus) != held).select("doc_id", F.col(column).alias("label"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.fit(spark))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.duplicate_lines(table(spark, sf_dir, "documents")).drop("text_hash", "n_rows")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _labels(spark, sf_dir, "toxic", 4, 2))
    return toxicity.score(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _labels(spark, sf_dir, "quality", 3, 1))
    return quality.score(docs, model).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.summary(rows, conversations.repair(conversations.damage(rows)))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_knn": op1_knn,
    "op2_bpe": op2_bpe,
    "op3_mixing": op3_mixing,
    "op4_token_counts": op4_token_counts,
    "op5_license_scan": op5_license_scan,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
    "op11_secrets": op11_secrets,
    "op12_conversations": op12_conversations,
    "op13_lexical": op13_lexical,
}

ORACLE_SQL: dict[str, str] = {
    "op1_knn": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v q JOIN v d ON q.vec_id % 100 = 0 AND d.vec_id <> q.vec_id
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op6_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
        ), ok AS (
            SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
            WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) / (a.norm * b.norm) >= 0.98
        ), reach(a, b) AS (
            SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a
        ), c AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(c.b, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(c.b, v.vec_id)) AS kept
        FROM v LEFT JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
    """,
    "op12_conversations": """
        WITH RECURSIVE bytes AS (
            SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
        ), hit AS (
            SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT))),
                lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS f FROM bytes
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
                CASE WHEN f = 1 THEN '' WHEN f = 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text
            FROM (SELECT *, unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) FROM hit WHERE f <> 0)
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged
        ), marked AS (
            SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
                CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM placed
        ), counted AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id
        ), put AS (
            SELECT * FROM (VALUES ('-', '-', '', 0, ''), ('s', 's', '', 0, ''), ('u', 'u', '', 0, ''), ('a', 'a', '', 0, ''), ('-', 'u', 'I', 5, 'user:'), ('-', 'a', 'II', 10, 'user:' || chr(10) || 'assistant:'),
                ('s', 'u', 'I', 5, 'user:'), ('s', 'a', 'II', 10, 'user:' || chr(10) || 'assistant:'), ('u', 'a', 'I', 5, 'assistant:'), ('a', 'u', 'I', 5, 'user:')) v(src, mid, letters, cost, lines)
        ), step AS (
            SELECT * FROM (VALUES ('-', 's'), ('-', 'u'), ('s', 'u'), ('a', 'u'), ('u', 'a')) v(mid, dst)
        ), walk AS (
            SELECT conv_id, 0::BIGINT AS i, '-' AS state, 0::BIGINT AS cost, '' AS audit, '' AS kept FROM counted
            UNION ALL
            SELECT conv_id, i, state, best.cost, best.audit, best.kept FROM (
                SELECT w.conv_id, w.i + 1 AS i, o.dst AS state, min({'cost': w.cost + p.cost + o.cost, 'audit': w.audit || p.letters || o.letter,
                    'kept': w.kept || CASE WHEN p.lines <> '' AND w.kept <> '' THEN chr(10) ELSE '' END || p.lines || CASE WHEN o.letter <> 'D' AND w.kept || p.lines <> '' THEN chr(10) ELSE '' END || o.line}) AS best
                FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1 JOIN put p ON p.src = w.state,
                LATERAL (SELECT p.mid AS dst, 'D' AS letter, 2 AS cost, '' AS line
                    UNION ALL SELECT dst, 'K', CASE WHEN m.fault = 't' THEN 5 ELSE 0 END, m.role || ':' || m.text FROM step WHERE step.mid = p.mid AND dst = m.initial AND m.fault NOT IN ('b', 'd')
                    UNION ALL SELECT dst, 'R', CASE WHEN m.fault = 't' THEN 6 ELSE 1 END, CASE dst WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || m.text FROM step WHERE step.mid = p.mid AND dst <> 's' AND m.fault NOT IN ('b', 'd')) o
                GROUP BY w.conv_id, w.i, o.dst)
        ), ended AS (
            SELECT w.conv_id, min({'cost': w.cost + p.cost, 'audit': w.audit || p.letters, 'kept': w.kept || CASE WHEN p.lines <> '' AND w.kept <> '' THEN chr(10) ELSE '' END || p.lines}) AS best
            FROM walk w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN put p ON p.src = w.state WHERE p.mid = 'a' OR (w.state = '-' AND p.mid = '-') GROUP BY w.conv_id
        )
        SELECT i.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
            coalesce(e.best.cost, 0) AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(e.best.kept, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM i.conv_id
    """,
    "op13_lexical": """
        WITH words AS (
            SELECT doc_id, row_number() OVER () AS d, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda t: t <> '') AS ts FROM documents
        ), asked AS (
            SELECT item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda t: t <> '')) AS term
            FROM (SELECT DISTINCT item_id, text FROM benchmark)
        ), repeats AS (
            SELECT item_id, term, count(*) AS times FROM asked GROUP BY 1, 2
        ), totals AS (
            SELECT count(*) FILTER (len(ts) > 0) AS n, sum(len(ts))::BIGINT AS l FROM words
        ), tf AS (
            SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(ts) AS term FROM words) WHERE term IN (SELECT term FROM repeats) GROUP BY 1, 2
        ), weight AS (
            SELECT term, CAST(floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY term
        ), damp AS (
            SELECT d, doc_id, 100 - 75 + ((75 * len(ts) * n) // l) AS m FROM words, totals
        ), scored AS (
            SELECT item_id, d, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM repeats JOIN weight USING (term) JOIN tf USING (term) JOIN damp USING (d) GROUP BY 1, 2
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM scored JOIN (SELECT d, doc_id FROM words) USING (d) WHERE score > 0 QUALIFY rank <= 10
    """,
}
