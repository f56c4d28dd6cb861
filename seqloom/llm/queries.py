"""The registered queries of the text-corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup as line_dedup_op
from . import imatch, mixing, vafile
from .bpe_codec import bpe_decode, bpe_encode
from .common import table
from .katz import katz_scores
from .langid import identify_languages, learn_languages, remainder
from .mincut_html import extract_text, learn_blocks
from .order_minhash import near_duplicates
from .token_counts import token_counts


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.digest(imatch.fingerprints(table(spark, sf_dir, "documents")))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe_encode(table(spark, sf_dir, "documents"), byte_bpe_path())
    both = bpe_decode(
        ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids"),
        byte_bpe_path(),
        keep=("doc_id", "n_tokens", "ids_sha256"),
    )
    return both.select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def op4_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) == 2)


def op5_mincut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, weights=learn_blocks(pages)).withColumn("n_chars", F.length("text").cast("long"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = learn_languages(docs.where(~held_out))
    found = identify_languages(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "spans")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), byte_bpe_path())


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vafile.exact_top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))  # whole documents move; the digest is made where they arrive
    return mixed.select("doc_id", "source", "lang", "n_chars", F.sha2("text", 256).alias("text_sha256"), "n_copies", "copy", "mix_key")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup_op.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_order_minhash": op1_order_minhash,
    "op2_imatch": op2_imatch,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_katz_scores": op4_katz_scores,
    "op5_mincut_html": op5_mincut_html,
    "op6_language_id": op6_language_id,
    "op7_token_counts": op7_token_counts,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_mix_sources": op9_mix_sources,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_imatch": imatch.ORACLE_SQL,
    "op8_exact_top_k": vafile.ORACLE_SQL,
    "op9_mix_sources": mixing.ORACLE_SQL,
    "op10_line_dedup": line_dedup_op.ORACLE_SQL,
}
