"""The subpackage's registered queries, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, line_dedup, packing, quality, sharding, simhash_dedup, substring_dedup, suffix_dedup, url_filter


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


#: The rules of the URL query.
RULES = [url_filter.Rule("allow", "org/"), url_filter.Rule("block", "example.org/es/"), url_filter.Rule("block", "example.org/en/1"), url_filter.Rule("allow", "com/fr/"), url_filter.Rule("block", "com/de/")]


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = line_dedup.line_dedup(_documents(spark, sf))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(_documents(spark, sf))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_simhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash_dedup.simhash_dedup(_documents(spark, sf)).select("doc_id", "fingerprint", "component_id")


def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.find_contamination(_documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


def op5_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf), tokenizer_path())


def op6_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    out = fingerprints.edited_pairs(_documents(spark, sf))
    return out.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op7_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.filter_urls(spark.read.parquet(f"{sf}/pages.parquet"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = substring_dedup.substring_dedup(_documents(spark, sf))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op9_hilbert_shards(spark: SparkSession, sf: str) -> DataFrame:
    out = sharding.hilbert_shards(_documents(spark, sf))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op10_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return quality.score_quality(_documents(spark, sf), labels=spark.read.parquet(f"{sf}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_line_dedup, op2_suffix_dedup, op3_simhash_dedup, op4_decontamination, op5_best_fit_packing, op6_fingerprints, op7_url_filter, op8_substring_dedup, op9_hilbert_shards, op10_quality_classifier)
    }


#: Windows of 20 words, as their words joined by one space; a window's later copies cover their words.
_OP8 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS j FROM d),
s AS (SELECT doc_id, ws, unnest(range(len(ws) - 19)) AS i FROM d WHERE len(ws) >= 20),
r AS (SELECT doc_id, i, ROW_NUMBER() OVER (PARTITION BY array_to_string(ws[i + 1 : i + 20], ' ') ORDER BY doc_id, i) AS nth FROM s),
g AS (SELECT w.doc_id, w.j, w.word, COALESCE(MAX(CASE WHEN r.nth > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY w.doc_id ORDER BY w.j ROWS 19 PRECEDING), 0) AS gone FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.i = w.j),
k AS (SELECT doc_id, COUNT(*) AS n_words, CAST(SUM(gone) AS BIGINT) AS n_removed, COALESCE(string_agg(word, ' ' ORDER BY j) FILTER (gone = 0), '') AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, COALESCE(n_words, 0) AS n_words, COALESCE(n_removed, 0) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

#: Strings of 100 bytes, as 200 hexadecimal digits.
_OP2 = """
WITH d AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, unnest(range(len(h) // 2)) AS j, unnest(regexp_extract_all(h, '..')) AS x FROM d),
s AS (SELECT doc_id, unnest(range(len(h) // 2 - 99)) AS j, unnest(list_transform(range(len(h) // 2 - 99), lambda i: md5(substr(h, 2 * i + 1, 200)))) AS w FROM d WHERE len(h) >= 200),
r AS (SELECT doc_id, j, ROW_NUMBER() OVER (PARTITION BY w ORDER BY doc_id, j) AS nth FROM s),
g AS (SELECT b.doc_id, b.j, b.x, COALESCE(MAX(CASE WHEN r.nth > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY b.doc_id ORDER BY b.j ROWS 99 PRECEDING), 0) AS gone FROM b LEFT JOIN r ON r.doc_id = b.doc_id AND r.j = b.j),
e AS (SELECT *, gone > LAG(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY j) AS opens FROM g),
k AS (SELECT doc_id, COUNT(*) AS n_bytes, CAST(SUM(gone) AS BIGINT) AS n_removed, CAST(COUNT(*) FILTER (opens) AS BIGINT) AS n_spans, COALESCE(string_agg(x, '' ORDER BY j) FILTER (gone = 0), '') AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, COALESCE(n_bytes, 0) AS n_bytes, COALESCE(n_removed, 0) AS n_removed, COALESCE(n_spans, 0) AS n_spans, sha256(unhex(COALESCE(kept, ''))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """The two exact removals.  The others hash with XXH64, tokenise, fit models or sort along a curve, which SQL cannot say; tests/llm compares
    them with brute force."""
    return {"op2_suffix_dedup": _OP2, "op8_substring_dedup": _OP8}
