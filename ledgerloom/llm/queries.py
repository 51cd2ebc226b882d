"""The queries of this subpackage, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read_table, shared_dir
from .media import decode_media, encode_texts, store_media
from .mixing import taken_words, word_count
from .packing import CAPACITY, pack, pieces
from .simhash import near_duplicates
from .sketch import neighbour_likeness
from .substring_dedup import remove_repeated_windows
from .suffix_dedup import remove_repeated_bytes
from .token_counts import token_counts
from .token_files import read_positions, token_digests, write_token_files
from .toxicity import toxicity

VOCABULARY = "word_bpe_49k.json"


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = store_media(encode_texts(read_table(spark, sf_dir, "documents")), f"{shared_dir(spark)}/media")
    found = decode_media(kept)
    first = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return found.select(*first, "width", "height", "frames", "thumbnail_hash")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, read_table(spark, sf_dir, "labels"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens"
    write_token_files(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path(VOCABULARY))
    return token_digests(read_positions(spark, path, "ids"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_windows(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(read_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), CAPACITY))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return taken_words(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_bytes(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_likeness(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_media, op2_toxicity, op3_token_files, op4_substring_dedup, op5_token_counts, op6_simhash, op7_packing, op8_mixing, op9_suffix_dedup, op10_sketch)}


OP4_SQL = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
placed AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM texts WHERE len(words) >= 13),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS sequence FROM placed),
earliest AS (SELECT sequence, min(doc_id) AS first_id FROM windows GROUP BY sequence),
repeated AS (SELECT w.doc_id, w.i FROM windows w JOIN earliest e ON w.sequence = e.sequence WHERE e.first_id < w.doc_id),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM repeated),
single AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM texts),
kept AS (SELECT s.doc_id, count(*) AS n_words, count(c.p) AS n_removed, string_agg(CASE WHEN c.p IS NULL THEN s.word END, ' ' ORDER BY s.p) AS kept
  FROM single s LEFT JOIN covered c ON s.doc_id = c.doc_id AND s.p = c.p GROUP BY s.doc_id)
SELECT t.doc_id, CAST(coalesce(k.n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL of op4. Images, tokenizers, learned scores, XXH64, components, packing, schedules and sketches have no SQL form,
    and byte strings of every place are too many for it on whole tables; all are tested against plain versions."""
    return {"op4_substring_dedup": OP4_SQL}
