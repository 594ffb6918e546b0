"""One query per operator over its whole table, with check SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliopanel.llm import ball_search, bpe, chat_format, embedding_dedup, exact_dedup, html_extract, line_dedup, minhash_dedup, mixing, quality_crf, token_counts, warc, whitening
from heliopanel.llm.common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function
    return register


@query()
def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash_dedup.minhash_dedup(documents).select("doc_id", "component_id", "kept")


@query()
def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = quality_crf.train(documents, table(spark, sf_dir, "labels"))
    scored = quality_crf.score(documents, field)
    return scored.select("doc_id", quality_crf.training_split(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_lines", "n_good_lines")


@query(r"""
WITH split AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split),
windows AS (
    SELECT doc_id, pos, line, lead(line, 1) OVER w AS second, lead(line, 2) OVER w AS third
    FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (
    SELECT doc_id, pos, line, CAST(third IS NOT NULL AND (trim(line) <> '' OR trim(second) <> '' OR trim(third) <> '')
           AND row_number() OVER (PARTITION BY line, second, third ORDER BY doc_id NULLS LAST, pos) > 1 AS INTEGER) AS later
    FROM windows),
marked AS (
    SELECT doc_id, pos, line, max(later) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS covered
    FROM ranked),
kept AS (
    SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (covered = 0), '') AS cleaned,
           count(*) AS n_lines, sum(covered) AS n_removed FROM marked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE cleaned END AS text, CAST(n_lines AS INTEGER) AS n_lines, CAST(n_removed AS INTEGER) AS n_removed
FROM documents d JOIN kept k ON d.doc_id = k.doc_id
""")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without repeated three-line windows."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded and decoded again, as digests."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe.round_trip(documents, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), keep=("doc_id",))
    return decoded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


@query("""
WITH RECURSIVE usable AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
      AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM usable UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, coalesce(l.component_id, e.vec_id) AS component_id,
       e.vec_id = coalesce(l.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN least l ON e.vec_id = l.a LEFT JOIN counted c ON e.vec_id = c.a
""")
def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings within labels."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return embedding_dedup.embedding_dedup(vectors).select("vec_id", "n_links", "component_id", "kept")


@query()
def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract_text(pages).select("page_id", "url", "text", "n_chars")


@query(r"""
WITH chats AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
marked AS (
    SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS body,
           replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10)) AS name,
           coalesce(lag(role) OVER w <> role, true) AS opens
    FROM chats WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(body) + CASE WHEN opens THEN length('<|im_start|>') + length(name) + 1 + length('<|im_end|>') + 1
                                    ELSE length('<|im_sep|>') END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
""")
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats formatted and read back."""
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trick = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trick).alias("text"))
    return chat_format.chat_digests(chat_format.format_chats(chats.unionByName(extra)))


@query()
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.add_token_counts(documents, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query()
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document so that sources meet their target weights."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(documents).select("doc_id", "size", "source_size", "target", "taken")


@query(r"""
WITH squeezed AS (
    SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER r = 1 AS kept, sha256(norm) AS text_sha256
FROM squeezed
WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
       r AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST)
""")
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts by content sort."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(documents).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query(r"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
ranked AS (SELECT page_id, payload, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS first FROM payloads)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM ranked
""")
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives and read back."""
    found = warc.archived(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        F.col("refers_to").cast("long").alias("refers_to"))


@query()
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings projected on their four largest components, each of variance one."""
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query(r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
sought AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM sought) GROUP BY doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM counts, corpus GROUP BY term),
scores AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
    FROM counts JOIN sought USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), corpus GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER r AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
WINDOW r AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER r <= 50
""")
def op11_ball_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item."""
    return ball_search.lexical_search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
