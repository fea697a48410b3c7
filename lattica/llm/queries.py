"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, language, near_dedup, quality, repeats, secrets, sharding, token_store, warc
from .common import table


def op4_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through WARC archives with segmented records and revisits."""
    return warc.archive_and_read(spark, table(spark, sf_dir, "pages"))


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; it is read there and never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the line labelling for every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_induced_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that are covered by 200-byte strings found elsewhere, removed."""
    return repeats.without_repeats(table(spark, sf_dir, "documents"), depth=200)


def op3_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by error-correcting output codes."""
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs), carry=["doc_id"])
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document through a content-addressed store, read back from its files."""
    return token_store.store_and_read(spark, table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every document, and the bytes decoded from its ids."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op6_simhash_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of benchmark items: the best window of each pair."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("_id").alias("doc_id"), "item_id", "similarity", "start", "n_words", "distance")


def op8_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on 2-word shingles at similarity 0.8."""
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards of equal row counts by a hypergeometric communication matrix."""
    out = sharding.shard_rows(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16, carry=["doc_id"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with the weak parts that complementary parts support."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_line_crf": op1_line_crf,
    "op2_induced_repeats": op2_induced_repeats,
    "op3_ecoc_language": op3_ecoc_language,
    "op4_warc_segments": op4_warc_segments,
    "op5_token_store": op5_token_store,
    "op6_simhash_leaks": op6_simhash_leaks,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_tensored_minhash": op8_tensored_minhash,
    "op9_hypergeometric_shards": op9_hypergeometric_shards,
    "op10_linked_secrets": op10_linked_secrets,
}

ORACLE_SQL: dict[str, str] = {
    "op2_induced_repeats": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
             w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d)),
             twice AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
             st AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w JOIN twice USING (m)),
             runs AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM st),
             spans AS (SELECT doc_id, k, min(i) AS s, max(i) + 200 AS e FROM runs GROUP BY 1, 2),
             cuts AS (SELECT doc_id, k, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY k), 0) AS a FROM spans),
             kept AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * a + 1, 2 * (s - a)), '' ORDER BY k) || substr(any_value(h), 2 * max(e) + 1) AS h
                      FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op8_tensored_minhash": """
        WITH RECURSIVE w AS (
               SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
             s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
             u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
             e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2, a.n, b.n
                   HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
             r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
             m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)
    """,
    "op4_warc_segments": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
             m AS (SELECT payload_digest AS d, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < last THEN last END AS refers_to
        FROM p LEFT JOIN m ON payload_digest = d AND payload_bytes >= 1000
    """,
}
