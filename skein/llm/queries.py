"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import (
    decontaminate,
    html_text,
    jaccard_join,
    licenses,
    mixing,
    near_dedup,
    packing,
    prefix_trie,
    quality,
    sql,
    toxicity,
    url_filter,
    vector_codes,
    warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and benchmark item that overlap."""
    return decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives and read back."""
    manifest = warc.write(_table(spark, sf_dir, "pages"))
    records = warc.read(manifest.select("path", "length"), payloads=False)
    return records.select(
        warc.page_of("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_of("refers_to").alias("refers_to"),
    )


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of each page."""
    return html_text.extracted(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of each document."""
    out = quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot of each document in the mixture; targets are the sources' rows to the power 0.7."""
    out = mixing.scheduled(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "rank", "block", "slot", "on_target")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of each document."""
    return licenses.scanned(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed rows of token ids of all documents."""
    return packing.packed(_table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of each document."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def _fold(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each document, learned from the rows that aren't held out; rows without doc_id are neither."""
    docs = _table(spark, sf_dir, "documents")
    weights = toxicity.model(docs, _table(spark, sf_dir, "labels"), _fold("doc_id") != 0)
    out = toxicity.scored(docs, weights)
    return out.select(
        "doc_id",
        F.coalesce(_fold("doc_id") == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        "worst_at",
        "worst_sentence",
    )


#: Titles of pages that the list of URLs is drawn from.
_JUNK = "<title>[^<]*(###|%%%|[*][*][*])"


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on each page's URL; listed are the URLs of pages whose title is strewn with signs."""
    pages = _table(spark, sf_dir, "pages")
    out = url_filter.judged(pages, pages.where(F.col("html").rlike(_JUNK)).select("url"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product code of each vector and its error."""
    return vector_codes.compressed(_table(spark, sf_dir, "embeddings"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of each document under links of similar shingle sets."""
    return jaccard_join.joined(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations with subtree totals."""
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_warc": op2_warc,
    "op3_html": op3_html,
    "op4_quality": op4_quality,
    "op5_mixing": op5_mixing,
    "op6_licenses": op6_licenses,
    "op7_packing": op7_packing,
    "op8_minhash": op8_minhash,
    "op9_toxicity": op9_toxicity,
    "op10_url_filter": op10_url_filter,
    "op11_vector_codes": op11_vector_codes,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    **sql.SQL,
    "op2_warc": """
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, sha1(coalesce(html, '')) AS hex,
                  octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
     f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(((CAST('0x' || substr(p.hex, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS INT), 1)), '')
         AS payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (hex)
""",
    "op10_url_filter": """
WITH u AS (SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
           FROM pages),
     p AS (SELECT page_id, html,
                  translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
     c AS (SELECT *, CASE WHEN host <> '' THEN
                  regexp_replace(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '^(www|m)[.]', '') ||
                  regexp_replace(regexp_replace(path, '[.]html$', ''), '/+$', '') END AS canon FROM p),
     listed AS (SELECT DISTINCT canon FROM c WHERE canon IS NOT NULL AND regexp_matches(html, '<title>[^<]*(###|%%%|[*][*][*])')),
     r AS (SELECT *, CASE
         WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM c)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM r
""",
}
