"""The registered queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerframe.llm.bpe import bpe_encode, token_digests
from ledgerframe.llm.chat import ordered_conversations
from ledgerframe.llm.exact_dedup import exact_dedup
from ledgerframe.llm.licenses import scan_licenses
from ledgerframe.llm.packing import pack
from ledgerframe.llm.personal import find_personal, personal_digests
from ledgerframe.llm.quality import judge
from ledgerframe.llm.secrets import find_secrets
from ledgerframe.llm.shared import shared_path
from ledgerframe.llm.simhash import simhash_groups
from ledgerframe.llm.spelling import spelling_variants
from ledgerframe.llm.toxicity import learn, score_toxicity
from ledgerframe.llm.warc import read_archives, write_archives
from ledgerframe.llm.whitening import by_component, whiten


def _table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def vocabulary_path() -> str:
    """The path of the byte-level vocabulary; the file comes with a package that every machine has."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_digests(bpe_encode(docs, vocabulary_path(), decoded_column="decoded"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(_table(spark, sf_dir, "documents"), vocabulary_path())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents")).drop("n_lines", "n_stop_words", "n_plain_words")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, learn(docs, _table(spark, sf_dir, "labels")))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_conversations(_table(spark, sf_dir, "conversations"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archives(_table(spark, sf_dir, "pages"), path)
    records = read_archives(spark, path)
    page = lambda c: F.col(c).cast("long")
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op11_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_digests(find_personal(_table(spark, sf_dir, "documents")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_component(whiten(_table(spark, sf_dir, "embeddings")))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_bpe": op2_bpe,
    "op3_packing": op3_packing,
    "op4_simhash": op4_simhash,
    "op5_quality": op5_quality,
    "op6_chat": op6_chat,
    "op7_toxicity": op7_toxicity,
    "op8_secrets": op8_secrets,
    "op9_warc": op9_warc,
    "op10_licenses": op10_licenses,
    "op11_personal": op11_personal,
    "op12_whitening": op12_whitening,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": """
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents),
        h AS (SELECT doc_id, sha256(t) AS text_sha256 FROM d)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM h WINDOW w AS (PARTITION BY text_sha256)""",
    "op9_warc": """
        WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) || '0' AS x FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS last FROM d)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST(((CAST('0x' || substr(x, (5 * i) // 4 + 1, 2) AS INTEGER) >> CAST(3 - (5 * i) % 4 AS INTEGER)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> last THEN last END AS refers_to
        FROM m""",
}
