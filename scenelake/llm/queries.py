"""The registered queries of this subpackage: thin, over whole tables, with their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.llm import warc
from scenelake.llm.ann import search
from scenelake.llm.bpe import decode, encode
from scenelake.llm.common import table
from scenelake.llm.exact_dedup import exact_duplicates
from scenelake.llm.html_text import extract
from scenelake.llm.language_id import held_out, identify, learn
from scenelake.llm.licences import oracle as licence_sql
from scenelake.llm.licences import scan
from scenelake.llm.packing import pack
from scenelake.llm.simhash import near_duplicates
from scenelake.llm.substring_dedup import remove_repeats


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs)
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that are left once repeated passages are gone."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_removed",
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, encoded and decoded again."""
    path = public_tokenizers.path("word_bpe_49k.json")
    found = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return found.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    found = search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
    return found.select(
        F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score"
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written to packages and read back.

    Digests of responses are computed anew from the payloads that were read."""
    found = warc.read(warc.write(table(spark, sf_dir, "pages")))
    own = F.sha2(F.col("payload"), 256)
    return found.select(
        F.col("id").alias("page_id"),
        "payload_bytes",
        F.coalesce(own, "payload_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    found = extract(table(spark, sf_dir, "pages"))
    return found.select(
        F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document that stays for its text."""
    found = exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in the packed sequences."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = pack(table(spark, sf_dir, "documents"), path)
    return found.select(
        F.col("id").alias("doc_id"),
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        F.col("sequence").alias("sequence_id"),
        "offset",
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's canonical digest, the licence that it is and the notices in it."""
    found = scan(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "digest",
        "licence",
        F.array_join("notices", ",").alias("notices"),
        "n_notice_lines",
        "n_reserved_lines",
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline, whose script lies beside the package."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_language_id": op1_language_id,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_bpe": op3_bpe,
        "op4_ann": op4_ann,
        "op5_warc": op5_warc,
        "op6_html_text": op6_html_text,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_packing": op8_packing,
        "op9_simhash": op9_simhash,
        "op10_licences": op10_licences,
        "pipeline": pipeline,
    }


SQL = {
    "op10_licences": licence_sql("documents"),
    "op5_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
""",
    "op7_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS rn FROM n)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size, rn = 1 AS kept, text_sha256
FROM r WINDOW w AS (PARTITION BY text_sha256 ORDER BY rn)
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
